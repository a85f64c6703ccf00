"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk_chars`` is cut into overlapping windows, which are dealt out and
pre-tokenised in parallel.  The pre-token pattern looks only to the right of its position, so once
two scans share a boundary they agree from there on.  Two neighbouring windows are therefore joined
at the first boundary that both have inside their overlap, and each window encodes the pre-tokens
between its two joins.  Where no boundary is shared (one pre-token covers the whole overlap) the
windows are merged before encoding.  Texts of one window need no joining.

Defined results: a null or empty text has no ids; a null id is kept; each input row gives one output row (rows
equal in id and text included); further columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, lean

#: Characters that a match may look at beyond its own end (the longest contraction has three).
LOOKAHEAD = 4
#: Distinct pre-tokens whose ids a task remembers.
CACHE_PIECES = 200_000


class _Pieces(dict):
    """pre-token -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = np.asarray(self.encoding._encode_single_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file, which has to lie at ``path`` on every node."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def _pieces(path: str, pattern: str) -> _Pieces:
    """Of one task: a worker that has nothing to do holds none."""
    return _Pieces(_encoding(path, pattern))


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def boundaries(pattern, text: str) -> list[int]:
    """Starts of the pre-tokens of ``text``, and its end."""
    out = [m.start() for m in pattern.finditer(text)]
    out.append(len(text))
    return out


def windows(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(number, window, is last) of a text; neighbours share ``overlap`` characters."""
    step, k, at = chunk - overlap, 0, 0
    while True:
        last = at + chunk >= len(text)
        yield k, text[at : at + chunk], last
        if last:
            return
        k, at = k + 1, at + step


def encode(docs: DataFrame, rank_path: str, pattern: str, chunk_chars: int = 32768, overlap: int = 1024, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of documents(doc_id, text); ids are little-endian unsigned 32-bit integers in one binary.

    ``decoded`` adds the column of :func:`decode`, from the ids and in the same worker.
    """
    if not LOOKAHEAD < overlap <= chunk_chars // 2:
        raise ValueError("overlap must be above the lookahead and at most half a chunk")
    docs = id_text(docs)
    short = docs.where(F.length("text") <= chunk_chars)
    long = docs.where(F.length("text") > chunk_chars)
    return _encode_short(short, rank_path, pattern, decoded).unionByName(_encode_long(long, rank_path, pattern, chunk_chars, overlap, decoded))


def _decoder(rank_path: str):
    """ids -> the concatenated bytes of their tokens."""
    token = _vocabulary(rank_path).__getitem__
    return lambda ids: b"".join(map(token, np.frombuffer(ids, dtype="<u4").tolist()))


def _encode_short(docs: DataFrame, rank_path: str, pattern: str, decoded: bool) -> DataFrame:
    def run(batches):
        find, pieces = regex.compile(pattern).findall, _pieces(rank_path, pattern)
        for batch in batches:
            ids = [b"".join(map(pieces.__getitem__, find(t.as_py()))) for t in batch.column(1)]
            out = {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())}
            if decoded:
                out["decoded"] = pa.array(map(_decoder(rank_path), ids), pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(lean(run), "doc_id long, ids binary" + ", decoded binary" * decoded)


def _encode_long(docs: DataFrame, rank_path: str, pattern: str, chunk: int, overlap: int, decoded: bool) -> DataFrame:
    step = chunk - overlap
    # rows equal in id and text become one with a count, so (doc_id, key) names a text
    texts = docs.groupBy("doc_id", F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))

    def cut(batches):
        names = ["doc_id", "key", "copies", "k", "window", "last"]
        for batch in batches:
            for doc_id, key, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                for k, window, last in windows(text, chunk, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([key]), pa.array([copies], pa.int64()), pa.array([k], pa.int32()), pa.array([window], pa.string()), pa.array([last])], names)

    def scan(batches):
        """Boundaries near both ends: heads relative to this window, tails relative to the next one."""
        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for k, window, last in zip(batch.column("k").to_pylist(), batch.column("window").to_pylist(), batch.column("last").to_pylist()):
                b = boundaries(compiled, window)
                heads.append([x for x in b if 0 < x <= overlap] if k else [])
                tails.append([] if last else [x - step for x in b if step < x <= len(window) - LOOKAHEAD])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*batch.schema.names, "heads", "tails"])

    def encode_groups(batches):
        compiled, pieces = regex.compile(pattern), _pieces(rank_path, pattern)
        for batch in batches:
            ids = []
            for parts, begin, end in zip(batch.column("parts").to_pylist(), batch.column("begin").to_pylist(), batch.column("end").to_pylist()):
                text = parts[0]["window"] + "".join(p["window"][overlap:] for p in parts[1:])
                stop = len(text) if end is None else (len(parts) - 1) * step + step + end
                found = []
                for m in compiled.finditer(text, begin):
                    if m.start() >= stop:
                        break
                    found.append(pieces[m.group()])
                ids.append(b"".join(found))
            out = {c: batch.column(c) for c in ("doc_id", "key", "copies", "grp")} | {"ids": pa.array(ids, pa.binary())}
            if decoded:
                out["decoded"] = pa.array(map(_decoder(rank_path), ids), pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    rows = texts.mapInArrow(lean(cut), "doc_id long, key string, copies long, k int, window string, last boolean")
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    scanned = rows.repartition(int(n), "key", "k").mapInArrow(lean(scan), "doc_id long, key string, copies long, k int, window string, last boolean, heads array<int>, tails array<int>")
    w = Window.partitionBy("doc_id", "key").orderBy("k")
    joined = scanned.withColumn("begin", F.array_min(F.array_intersect("heads", F.coalesce(F.lag("tails").over(w), F.array().cast("array<int>")))))
    joined = joined.withColumn("end", F.lead("begin").over(w)).withColumn("grp", F.count("begin").over(w))
    groups = joined.groupBy("doc_id", "key", "copies", "grp").agg(
        F.array_sort(F.collect_list(F.struct("k", "window"))).alias("parts"),
        F.coalesce(F.max("begin"), F.lit(0)).alias("begin"),  # only the first of a group has one
        F.max_by("end", "k").alias("end"),
    )
    pieces = groups.mapInArrow(lean(encode_groups), "doc_id long, key string, copies long, grp long, ids binary" + ", decoded binary" * decoded)
    made = ["ids", *["decoded"] * decoded]
    whole = pieces.groupBy("doc_id", "key", "copies").agg(*(F.expr(f"listagg({c}) WITHIN GROUP (ORDER BY grp)").alias(c) for c in made))
    return whole.select("doc_id", *made, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).drop("one")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """Adds ``decoded``, the concatenated bytes of the tokens in ``ids``."""
    at = encoded.columns.index("ids")

    def run(batches):
        one = _decoder(rank_path)
        for batch in batches:
            out = [one(x.as_buffer()) if x.is_valid else b"" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(lean(run), f"{schema}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(
        "doc_id",
        (F.coalesce(F.octet_length("ids"), F.lit(0)) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce("ids", F.lit(b"")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
