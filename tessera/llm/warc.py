"""A deterministic sharded WARC writer, and its reader.

Records are ordered by page id, payload digest and a hash of the URL.  The order is cut into blocks of ``4 * roll_bytes``
of uncompressed content, a sum over the sorted keys that does not depend on partitions.  One task sorts one block, makes every
record a gzip member, and starts a new file whenever the next member would take the file beyond ``roll_bytes`` of compressed size.
Record ids derive from page id and digest, and the date is a parameter, so the same pages give the same bytes in every file.
The first key of every block is held by the driver, as Spark itself holds the bounds of a range partitioning.

Payloads are shuffled once and compressed once.  Which records are revisits is worked out on keys alone; those
rows join the payloads' shuffle and precede the page they speak of.  Digests of more than a thousandth of all rows
(a thousand at most) are broadcast, so that no task gets all rows of one payload.

Spark's committer writes each file under a temporary name; the files then move to their final
names, and the manifest, written last, lists names, records and sizes.  Readers take only what a manifest
lists, so a lost executor or driver leaves no half-written archive.  Members travel through the text
writer in runs of ``CHUNK`` bytes; it writes a string's bytes as they are, and the separator it needs after each run is an
empty gzip member, which readers of multi-member files skip.

Records with equal payloads (digest and length) of at least ``least_bytes`` form a group: the one with the largest page id is
the response, all others are revisits of it.

Defined results: a null html is an empty payload; a null url is an empty target; rows with a null page id are written
and read back with a null id, and refer or are referred to only if no other row of their group has an id; rows equal in id and
payload are the response each; rows equal in id, payload and url share a block; very long payloads are a member each, in a
file of their own if need be; further columns are ignored; an empty table gives an empty archive with a manifest.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stage, matched, stage


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


#: After a run of members, as one character for each byte.
_SEPARATOR = _member(b"").decode("latin-1")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_url: str, date: str) -> bytes:
    """One WARC/1.1 record, headers regenerated from its content."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m.group()):02X}', refers_url)}")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}|{digest}')}>")
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, link, digest, payload): link is a hash of the URL, digest the SHA-1 in bytes."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return named.select("page_id", "url", F.xxhash64("url").alias("link"), F.unhex(F.sha1("payload")).alias("digest"), "payload")


def _judged(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, link, digest, size, revisit, first, first_url) of every row: first is the page that a revisit refers to."""
    keys = stage(rows.select("page_id", "url", "link", "digest", F.octet_length("payload").cast("long").alias("size")), "keys")
    groups = keys.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = stage(groups.select("digest", "size", F.col("top.page_id").alias("first"), F.col("top.url").alias("first_url"), "copies"), "groups")
    met = matched(keys, groups, ["digest", "size"], "copies")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return stage(met.select("page_id", "link", "digest", "size", revisit.alias("revisit"), "first", "first_url"), "judged")


def _order(page_id: int | None, digest: bytes, link: int) -> tuple:
    """Null ids first, as Spark sorts them."""
    return (page_id is not None, page_id or 0, digest, link)


def _block_starts(judged: DataFrame, block_bytes: int) -> list[tuple]:
    """The first key of every block of the sorted order."""

    def number(batches):
        at = 0
        for batch in batches:
            sizes = batch.column("weight").to_numpy()
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - sizes, pa.int64())], [*batch.schema.names, "before"])
            at = int(ends[-1]) if len(ends) else at

    # sums of the sorted order: inside a range partition, then over the partitions' totals (one row each)
    weight = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size")) + 512
    spread = judged.select("page_id", "digest", "link", weight.cast("long").alias("weight")).repartitionByRange("page_id", "digest", "link").sortWithinPartitions("page_id", "digest", "link", "weight")
    ordered = stage(spread.mapInArrow(number, "page_id long, digest binary, link long, weight long, before long").withColumn("part", F.spark_partition_id()), "ordered")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("part").agg(F.sum("weight").alias("total")).select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("start"))
    block = F.floor((F.col("start") + F.col("before")) / block_bytes)
    first = ordered.join(F.broadcast(offsets), "part").groupBy(block.alias("block")).agg(F.min(F.struct("page_id", "digest", "link")).alias("key"))
    starts = sorted({_order(r["key"]["page_id"], bytes(r["key"]["digest"]), r["key"]["link"]) for r in first.collect()})
    drop_stage(ordered)
    return starts


#: Compressed bytes of one row of the text writer.
CHUNK = 1_000_000


def _packer(roll_bytes: int, date: str):
    """Sorted rows of blocks to (block, file, records, place, members): a file's runs of members, once the file is whole."""

    def run(batches):
        block, file, of, told = None, 0, None, None
        size, records, runs, open_run, in_run = 0, 0, [], [], 0

        def close():
            nonlocal file, size, records, runs, open_run, in_run
            if records:
                if open_run:
                    runs.append(b"".join(open_run))
                for place, members in enumerate(runs):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (block, file, records, place)] + [pa.array([members], pa.binary())], ["block", "file", "records", "place", "members"])
                file += 1
            size, records, runs, open_run, in_run = 0, 0, [], [], 0

        for batch in batches:
            columns = [batch.column(c) for c in ("block", "page_id", "url", "digest", "payload", "first", "first_url")]
            for at, page, url, digest, payload, first, first_url in zip(*columns):
                at, page, digest, payload = at.as_py(), page.as_py(), digest.as_py(), payload.as_py()
                if at != block:
                    yield from close()
                    block, file, of = at, 0, None
                if payload is None:  # what is known of the rows that follow
                    of, told = (page, digest), (first.as_py(), first_url.as_py())
                    continue
                name = base64.b32encode(digest).decode()
                if of == (page, digest):
                    data = _member(record(page, url.as_py(), payload, name, "revisit", *told, date))
                else:
                    data = _member(record(page, url.as_py(), payload, name, "response", None, "", date))
                if records and size + len(data) > roll_bytes:
                    yield from close()
                open_run.append(data)
                in_run += len(data)
                size += len(data)
                records += 1
                if in_run >= CHUNK:
                    runs.append(b"".join(open_run))
                    open_run, in_run = [], 0
        yield from close()

    return run


def write(pages: DataFrame, path: str, roll_bytes: int = 16_000_000, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> list[dict]:
    """Write pages(page_id, url, html) below ``path`` and return the manifest's entries."""
    rows = _payloads(pages)
    judged = _judged(rows, least_bytes)
    starts = _block_starts(judged, 4 * roll_bytes)
    told = judged.where("revisit").select("page_id", F.lit(None).cast("string").alias("url"), "link", "digest", F.lit(None).cast("binary").alias("payload"), "first", "first_url").distinct()
    both = rows.withColumns({"first": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")}).unionByName(told)

    def place(batches):
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "link")))
            at = [bisect.bisect_right(starts, _order(*k)) - 1 for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "block"])

    placed = both.mapInArrow(place, "page_id long, url string, link long, digest binary, payload binary, first long, first_url string, block int")
    # one task for each block; nulls sort first, so a revisit's row precedes its page
    blocks = placed.repartitionById(max(len(starts), 1), F.col("block")).sortWithinPartitions("block", "page_id", "digest", "link", F.col("payload").isNotNull(), "url")
    packed = blocks.mapInArrow(_packer(roll_bytes, date), "block long, file long, records long, place long, members binary").sortWithinPartitions("block", "file", "records", "place")
    scratch = f"{path}/_scratch-{uuid.uuid4().hex}"
    packed.select("block", "file", "records", F.col("members").cast("string").alias("value")).write.partitionBy("block", "file", "records").option("lineSep", _SEPARATOR).option("encoding", "ISO-8859-1").text(scratch)
    drop_stage(judged)
    return _commit(pages.sparkSession, path, scratch)


def _commit(spark: SparkSession, path: str, scratch: str) -> list[dict]:
    """Give the files their names, then write the manifest under a temporary name and rename it."""
    jvm = spark.sparkContext._jvm
    conf, file = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    fs = file(path).getFileSystem(conf)
    found = {}
    listing = fs.listFiles(file(scratch), True)
    while listing.hasNext():
        status = listing.next()
        at = re.search(r"/block=(\d+)/file=(\d+)/records=(\d+)/part-[^/]*$", status.getPath().toString())
        if at:
            block, number, records = map(int, at.groups())
            if (block, number) in found:
                raise RuntimeError(f"file {number} of block {block} was written twice")
            found[block, number] = (status.getPath(), records, status.getLen())

    def move(key: tuple[int, int]) -> dict:
        source, records, size = found[key]
        name = f"pages-{key[0]:06d}-{key[1]:03d}.warc.gz"
        if not fs.rename(source, file(f"{path}/{name}")):
            raise RuntimeError(f"{name} exists already")
        return {"file": name, "records": records, "bytes": size}

    with ThreadPoolExecutor(16) as pool:  # renames are many small requests to the file system
        out = list(pool.map(move, sorted(found)))
    fs.delete(file(scratch), True)
    temporary, final = file(f"{path}/.manifest.json.tmp"), file(f"{path}/manifest.json")
    stream = fs.create(temporary, True)
    stream.write(bytearray(json.dumps({"files": out}, sort_keys=True).encode()))
    stream.close()
    if not fs.rename(temporary, final):
        raise RuntimeError("a manifest exists already")
    return out


_HEADER = re.compile(rb"^([A-Za-z-]+): ?(.*)$", re.M)


#: Bytes given to the decompressor at once: what it hands back unused is copied.
_STEP = 16_384


def parse(data: bytes):
    """(headers, block) of every record of a multi-member file; the block digest is checked."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a member is cut short")
            piece = view[at : at + _STEP]
            parts.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        raw = b"".join(parts)
        if not raw:
            continue
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = {k.decode(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(head.replace(b"\r\n", b"\n"))}
        block = rest[: int(fields["Content-Length"])]
        if f"sha1:{digest32(block)}" != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError("a record is damaged")
        yield fields, block


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the archives that the manifest lists."""
    text = spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]
    names = [x["file"] for x in json.loads(text)["files"]]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    if not names:
        return spark.createDataFrame([], schema)

    def run(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None and digest32(payload) != digest:
                        raise ValueError("a payload is damaged")
                    length = len(payload) if payload is not None else int(h["X-Payload-Length"])
                    page, refers = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), h.get("WARC-Target-URI"), length, digest, h["WARC-Type"], refers and int(refers), payload))
                    size += length
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [s.split()[0] for s in schema.split(", ")])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [s.split()[0] for s in schema.split(", ")])

    files = spark.read.format("binaryFile").load([f"{path}/{n}" for n in names]).select("content")
    return files.mapInArrow(run, schema)
