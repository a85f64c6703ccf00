"""Scores of every chunk for every question, taken block by block where the texts are read.

Texts become blocks: postings of the asked terms, hashed vectors, paths.  What leaves a task is counts, maxima and the rows that can
still win; a pair of question and chunk never shuffles.  Questions, their terms and the answers are held by the driver, and
so grow with the set of questions only.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TOKEN, WORD, folded, keyword_terms, tokens, words
from .index import DIMENSIONS

K1, B = 1.5, 0.75
_TOKEN = re.compile(TOKEN.removeprefix("(?i)").encode())
_WORD = re.compile(WORD.removeprefix("(?i)").encode())
_STEM = re.compile(r"(?<=[^/.])(\.[^./]*)$")
#: Chunks of one block.
BLOCK = 512
#: Tokens whose hash a task remembers.
_REMEMBERED = 500_000


class _Codes(dict):
    """token -> (number of the asked term + 1) * DIMENSIONS + bucket."""

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, token: bytes) -> int:
        h = 0
        for c in token:
            h = (h * 131 + c) % 1_000_003
        if len(self) > _REMEMBERED:
            self.clear()
        code = self[token] = (self.terms.get(token, -1) + 1) * DIMENSIONS + h % DIMENSIONS
        return code


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers for each i."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def round9(x: np.ndarray) -> np.ndarray:
    """Nine decimals, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e9 + 0.5) / 1e9, x)


class Asked:
    """Questions in a form that tasks take: terms with their questions, words of the questions, vectors."""

    def __init__(self, queries: DataFrame, every: bool = False):
        terms = tokens(F.col("question")) if every else keyword_terms(F.col("question"))
        rows = queries.select("query_id", terms.alias("terms"), tokens(F.col("question")).alias("tokens"), F.array_distinct(words(F.col("question"))).alias("words")).collect()
        self.kind, self.ids = queries.schema["query_id"].dataType, [r["query_id"] for r in rows]
        self.n = len(rows)
        counts = [Counter(t.encode() for t in r["terms"] or ()) for r in rows]
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*counts)))} if rows else {}
        self.n_terms = np.array([max(1, len(c)) for c in counts], dtype=float)
        self.start, self.question, self.weight = self._by_key(len(self.terms), [(self.terms[t], q, c) for q, x in enumerate(counts) for t, c in x.items()])
        asked = [set(w.encode() for w in r["words"] or ()) for r in rows]
        self.words = {w: i for i, w in enumerate(sorted(set().union(*asked)))} if rows else {}
        self.n_words = np.array([max(1, len(x)) for x in asked], dtype=float)
        self.word_start, self.word_question, _ = self._by_key(len(self.words), [(self.words[w], q, 1) for q, x in enumerate(asked) for w in x])
        self.vectors, codes = np.zeros((self.n, DIMENSIONS)), _Codes({})
        for q, r in enumerate(rows):
            for t in r["tokens"] or ():
                self.vectors[q, codes[t.encode()]] += 1
        _unit(self.vectors)

    @staticmethod
    def _by_key(n: int, rows: list[tuple[int, int, int]]):
        rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
        return np.searchsorted(rows[:, 0], np.arange(n + 1)), rows[:, 1], rows[:, 2].astype(float)


def _unit(counts: np.ndarray) -> None:
    norm = np.sqrt((counts * counts).sum(axis=1))
    counts /= np.where(norm > 0, norm, 1.0)[:, None]


def blocks(chunks: DataFrame, asked: Asked, dense: bool, project: str | None = None) -> DataFrame:
    """(block): chunks(path, ordinal, project, root_label, mtime, text) in blocks, files together in each.  ``shown`` follows the project filter."""
    terms = asked.terms
    shown = F.coalesce(F.contains(folded(F.col("project")), F.lit(project.lower())), F.lit(False)) if project else F.lit(True)

    def run(batches):
        codes = _Codes(terms)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = [Counter(_TOKEN.findall((t or b"").lower())) for t in part.column("text").to_pylist()]
                sizes = np.array([len(c) for c in found])
                code = np.fromiter((codes[t] for c in found for t in c), np.int64, sizes.sum())
                tf = np.fromiter((n for c in found for n in c.values()), np.int64, sizes.sum())
                row = np.repeat(np.arange(len(found)), sizes)
                out = {"dl": np.bincount(row, tf, len(found))}
                if dense:
                    vectors = np.bincount(row * DIMENSIONS + code % DIMENSIONS, tf, len(found) * DIMENSIONS).reshape(-1, DIMENSIONS)
                    _unit(vectors)
                    out["vectors"] = vectors
                mine = code >= DIMENSIONS
                out |= {"row": row[mine].astype(np.int16), "term": (code[mine] // DIMENSIONS - 1).astype(np.int32), "tf": tf[mine].astype(np.int32)}
                out |= {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("ordinal", "mtime", "shown")}
                out |= {c: part.column(c).to_pylist() for c in ("path", "project", "root_label")}
                raw = pickle.dumps(out, 5)
                yield pa.RecordBatch.from_pydict({"size": pa.array([len(raw)], pa.int64()), "block": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())})

    # rows without a path count in the statistics and are never shown
    named = F.col("path").isNotNull()
    rows = chunks.select(F.coalesce("path", F.lit("")).alias("path"), F.col("ordinal").cast("int").alias("ordinal"), "project", F.when(named, F.col("root_label")).alias("root_label"), F.col("mtime").cast("double").alias("mtime"), (shown & named).alias("shown"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "size long, block binary")


def _read(batches):
    for batch in batches:
        for n, x in zip(batch.column("size").to_pylist(), batch.column("block"), strict=True):
            yield pickle.loads(pa.decompress(x.as_buffer(), n, "zstd"))


class Corpus:
    """What all scores need to know of the whole corpus: document frequencies, lengths, times, the folder of each root."""

    def __init__(self, made: DataFrame, asked: Asked):
        n_terms = len(asked.terms)

        def run(batches):
            df, n, total, lo, hi, roots = np.zeros(n_terms, np.int64), 0, 0, math.inf, -math.inf, {}
            for b in _read(batches):
                df += np.bincount(b["term"], minlength=n_terms)
                n, total = n + len(b["path"]), total + int(b["dl"].sum())
                times = b["mtime"][~np.isnan(b["mtime"])]
                lo, hi = float(times.min(initial=lo)), float(times.max(initial=hi))
                for path, root in set(zip(b["path"], b["root_label"], strict=True)):
                    if root is None:
                        continue
                    folder = path.split("/")[:-1]
                    low, high = roots.get(root, (folder, folder))
                    roots[root] = (min(low, folder), max(high, folder))
            keys = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *keys], pa.int32()), pa.array([n, *df[keys]], pa.int64()), pa.array([pickle.dumps((total, lo, hi, roots)), *[None] * len(keys)], pa.binary())], ["k", "n", "more"])

        self.df, self.n, total, self.lo, hi, roots = np.zeros(n_terms), 0, 0, math.inf, -math.inf, {}
        for r in made.mapInArrow(run, "k int, n long, more binary").groupBy("k").agg(F.sum("n").alias("n"), F.collect_list("more").alias("more")).collect():
            if r["k"] >= 0:
                self.df[r["k"]] = r["n"]
                continue
            self.n = r["n"]
            for t, a, z, found in map(pickle.loads, r["more"]):
                total, self.lo, hi = total + t, min(self.lo, a), max(hi, z)
                for root, (low, high) in found.items():
                    old = roots.get(root, (low, high))
                    roots[root] = (min(old[0], low), max(old[1], high))
        self.average = max(1.0, total / self.n if self.n else 1.0)
        self.range = max(1.0, hi - self.lo)
        self.idf = np.log(1 + (self.n - self.df + 0.5) / (self.df + 0.5))
        self.weight = asked.weight * np.repeat(self.idf, np.diff(asked.start))
        # the first place where the extremes differ ends what all folders share
        self.shared = {root: next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high))) for root, (low, high) in roots.items()}


class Scores:
    """Of one block: lexical, matched, similarity, overlap as arrays of questions by chunks, when they are asked for."""

    def __init__(self, b: dict, asked: Asked, corpus: Corpus):
        self.b, self.asked, self.corpus, self.n = b, asked, corpus, len(b["path"])
        counts = (asked.start[b["term"] + 1] - asked.start[b["term"]]) if len(b["term"]) else np.zeros(0, np.int64)
        pairs = _spread(asked.start[b["term"]], counts)
        tf, row = b["tf"].astype(float), b["row"].astype(np.int64)
        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * b["dl"][row] / corpus.average))
        self._cell = asked.question[pairs] * self.n + np.repeat(row, counts)
        self.lexical = round9(np.bincount(self._cell, corpus.weight[pairs] * np.repeat(gain, counts), asked.n * self.n)).reshape(asked.n, self.n)

    def coverage(self) -> np.ndarray:
        return np.bincount(self._cell, minlength=self.asked.n * self.n).reshape(self.asked.n, self.n) / self.asked.n_terms[:, None]

    def similarity(self) -> np.ndarray:
        """Summed dimension by dimension, so that every pass finds the same numbers."""
        q, v = self.asked.vectors, np.ascontiguousarray(self.b["vectors"].T)
        out, part = np.zeros((self.asked.n, self.n)), np.empty((self.asked.n, self.n))
        for d in range(v.shape[0]):
            np.multiply(q[:, d, None], v[d], out=part)
            out += part
        return round9(out)

    def overlap(self) -> np.ndarray:
        known, rows, keys = {}, [], []
        for i, (path, project, root) in enumerate(zip(self.b["path"], self.b["project"], self.b["root_label"], strict=True)):
            if root is None:
                continue
            if (path, project) not in known:
                below = _STEM.sub("", "/".join(path.split("/")[self.corpus.shared[root] :]))
                found = set(_WORD.findall(" ".join(x for x in (project, below) if x is not None).encode().lower()))
                known[path, project] = [self.asked.words[w] for w in found if w in self.asked.words]
            rows += [i] * len(known[path, project])
            keys += known[path, project]
        keys = np.array(keys, np.int64)
        counts = self.asked.word_start[keys + 1] - self.asked.word_start[keys]
        cell = self.asked.word_question[_spread(self.asked.word_start[keys], counts)] * self.n + np.repeat(np.array(rows, np.int64), counts)
        return np.bincount(cell, minlength=self.asked.n * self.n).reshape(self.asked.n, self.n) / self.asked.n_words[:, None]

    def age(self) -> np.ndarray:
        return (self.b["mtime"] - self.corpus.lo) / self.corpus.range


def extremes(made: DataFrame, asked: Asked, corpus: Corpus, dense: bool) -> dict[str, np.ndarray]:
    """By question: ``most`` (highest keyword score, 1 if there is none); with ``dense`` the ends of the similarities, ``lo`` and ``hi``."""

    def run(batches):
        most, lo, hi = np.zeros(asked.n), np.full(asked.n, math.inf), np.full(asked.n, -math.inf)
        for b in _read(batches):
            s = Scores(b, asked, corpus)
            most = np.maximum(most, s.lexical.max(axis=1, initial=0))
            if dense:
                x = s.similarity()
                lo, hi = np.minimum(lo, x.min(axis=1)), np.maximum(hi, x.max(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(asked.n), pa.int32()), *(pa.array(x, pa.float64()) for x in (most, lo, hi))], ["q", "most", "lo", "hi"])

    out = {"most": np.ones(asked.n), "lo": np.zeros(asked.n), "hi": np.zeros(asked.n)}
    for r in made.mapInArrow(run, "q int, most double, lo double, hi double").groupBy("q").agg(F.max("most").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        out["most"][r["q"]] = r["most"] or 1.0
        out["lo"][r["q"]], out["hi"][r["q"]] = r["lo"], r["hi"]
    return out


class Best:
    """For each group the first ``heads`` rows, and the best row of each of the first ``files`` paths; ties fall to path and ordinal."""

    def __init__(self, heads: np.ndarray, files: np.ndarray, least: np.ndarray | None = None):
        self.heads, self.files, self.held, self.waiting = heads, files, None, 0
        self.least = np.full(len(heads), -math.inf) if least is None else least

    def add(self, group: np.ndarray, score: np.ndarray, path: np.ndarray, ordinal: np.ndarray, more: np.ndarray) -> None:
        new = [group, score, path, ordinal, more]
        self.held = new if self.held is None else [np.concatenate(x) for x in zip(self.held, new, strict=True)]
        self.waiting += len(group)
        if self.waiting > 200_000:
            self.cut()

    def cut(self) -> None:
        if self.held is None or not self.waiting:
            return
        group, score, path, ordinal, _ = self.held
        names, code = np.unique(path, return_inverse=True)
        order = np.lexsort((ordinal, code, -score, group))
        group, score, code = group[order], score[order], code[order]
        starts = np.searchsorted(group, np.arange(len(self.heads)))
        place = np.arange(len(group)) - starts[group]
        first = np.zeros(len(group), bool)
        first[np.unique(group * len(names) + code, return_index=True)[1]] = True
        numbers = np.cumsum(first)
        number = numbers - np.where(starts[group] > 0, numbers[starts[group] - 1], 0)
        last = first & (number == self.files[group])
        self.least[group[last]] = np.maximum(self.least[group[last]], score[last])
        keep = (place < self.heads[group]) | (first & (number <= self.files[group]))
        self.held, self.waiting = [x[order][keep] for x in self.held], 0


def _runs(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal paths together, and where each of them begins."""
    code = np.unique(paths, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.diff(code[order], prepend=-1))


def _floor(scores: np.ndarray, order: np.ndarray, starts: np.ndarray, files: int) -> np.ndarray:
    """A score that the first ``files`` paths of each row reach; minus infinity where there are fewer."""
    if not 0 < files <= len(starts):
        return np.full(len(scores), -math.inf)
    best = np.maximum.reduceat(scores[:, order], starts, axis=1)
    return np.partition(best, len(starts) - files, axis=1)[:, len(starts) - files]


_FOUND = "p int, q int, path string, ordinal int, score double, coverage double"


def candidates(made: DataFrame, asked: Asked, corpus: Corpus, policies: list, ends: dict[str, np.ndarray]) -> DataFrame:
    """(p, q, path, ordinal, score, coverage): of every task, the chunks that can be among the first of a question (q) under a policy (p), by number."""
    heads = np.repeat([p.rerank_budget for p in policies], asked.n)
    files = np.repeat([p.rerank_budget + p.top_k for p in policies], asked.n)
    dense = any(p.fusion != "keyword" for p in policies)

    def run(batches):
        best = Best(heads, files)
        for b in _read(batches):
            s = Scores(b, asked, corpus)
            keyword, overlap, coverage, age = s.lexical / ends["most"][:, None], s.overlap(), s.coverage(), s.age()
            similarity = s.similarity() if dense else None
            paths = np.array(b["path"], dtype=object)
            order, starts = _runs(paths)
            for k, p in enumerate(policies):
                if p.fusion == "keyword":
                    relevance = keyword
                elif p.fusion == "raw":
                    relevance = p.dense_weight * (similarity + 1) / 2 + (1 - p.dense_weight) * keyword
                else:
                    lo, hi = ends["lo"][:, None], ends["hi"][:, None]
                    relevance = p.dense_weight * np.where(hi > lo, (similarity - lo) / np.where(hi > lo, hi - lo, 1.0), 0.0) + (1 - p.dense_weight) * keyword
                score = relevance + p.recency_weight * age + p.metadata_weight * overlap
                able = b["shown"][None, :] & ~np.isnan(score)
                if p.fusion == "keyword":  # no use for chunks without any match
                    able = able & ((s.lexical > 0) | (overlap > 0))
                score = np.where(able, score, -math.inf)
                mine = slice(k * asked.n, (k + 1) * asked.n)
                best.least[mine] = np.maximum(best.least[mine], _floor(score, order, starts, p.rerank_budget + p.top_k) - 1e-8)
                q, i = np.nonzero(able & (score >= best.least[mine, None] - 1e-8))
                best.add(q + k * asked.n, round9(score[q, i]), paths[i], b["ordinal"][i], coverage[q, i])
        best.cut()
        if best.held is not None:
            yield _found(best, asked.n)

    return made.mapInArrow(run, _FOUND)


def _found(best: Best, n: int) -> pa.RecordBatch:
    group, score, path, ordinal, coverage = best.held
    return pa.RecordBatch.from_arrays([pa.array(group // n, pa.int32()), pa.array(group % n, pa.int32()), pa.array(path, pa.string()), pa.array(ordinal, pa.int32()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64())], [x.split()[0] for x in _FOUND.split(", ")])


def nearest(made: DataFrame, asked: Asked, corpus: Corpus, head: int) -> DataFrame:
    """(q, path, ordinal, similarity, lexical): of every task, the ``head`` densest chunks of each question."""

    def run(batches):
        best = Best(np.full(asked.n, head), np.zeros(asked.n, np.int64))
        for b in _read(batches):
            s = Scores(b, asked, corpus)
            x, paths = s.similarity(), np.array(b["path"], dtype=object)
            if s.n >= head:
                best.least = np.maximum(best.least, np.partition(x, s.n - head, axis=1)[:, s.n - head])
            q, i = np.nonzero(x >= best.least[:, None])
            best.add(q, x[q, i], paths[i], b["ordinal"][i], s.lexical[q, i])
        best.cut()
        if best.held is not None:
            yield _found(best, asked.n)

    found = made.mapInArrow(run, _FOUND)
    return found.select("q", "path", "ordinal", F.col("score").alias("similarity"), F.col("coverage").alias("lexical"))


#: Bands of scores in which the rows above a cut are counted, and the chunks that are first taken for each question and score.
_BANDS, DEPTH = 2048, 256


def _bands(x: np.ndarray, low, high) -> np.ndarray:
    """Numbers of bands, higher for higher values."""
    return np.clip(np.floor((x - low) / (high - low) * _BANDS), 0, _BANDS - 1).astype(np.int64)


class _Ranks:
    """Both scores of rank fusion with their bands: similarities lie in -1..1, keyword scores below the sum of their terms' largest weights."""

    def __init__(self, asked: Asked, corpus: Corpus):
        self.asked, self.corpus = asked, corpus
        self.bound = np.maximum(1e-9, np.bincount(asked.question, corpus.weight * (K1 + 1), asked.n))[:, None]

    def of(self, b: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(values, bands, which of them count) by similarity and by keyword score."""
        s = Scores(b, self.asked, self.corpus)
        near = s.similarity()
        return [(near, _bands(near, -1.0, 1.0), np.ones(near.shape, bool)), (s.lexical, _bands(s.lexical, 0.0, self.bound), s.lexical > 0)], s


def _cuts(made: DataFrame, ranks: _Ranks, depth: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For both scores and every question the lowest band that its first ``depth`` chunks reach; how many chunks have a keyword score; the largest overlap."""
    n, deep = ranks.asked.n, np.tile(depth, 2)[:, None]

    def run(batches):
        counts, matched, most = np.zeros(2 * n * _BANDS, np.int64), np.zeros(n, np.int64), np.zeros(n)
        for b in _read(batches):
            both, s = ranks.of(b)
            able = (b["shown"] | every)[None, :]
            for k, (_, bands, counted) in enumerate(both):
                q, i = np.nonzero(counted & able)
                counts += np.bincount((k * n + q) * _BANDS + bands[q, i], minlength=len(counts))
            matched += both[1][2].sum(axis=1)
            most = np.maximum(most, s.overlap().max(axis=1))
        # a task's own chunks bound the cut from below
        by_band = counts.reshape(2 * n, _BANDS)
        above = np.cumsum(by_band[:, ::-1], axis=1)[:, ::-1] - by_band
        k, band = np.nonzero((by_band > 0) & (above < deep))
        extra = np.arange(n)
        columns = [np.concatenate([k, extra, extra]), np.concatenate([band, np.full(n, -1), np.full(n, -2)]), np.concatenate([by_band[k, band], matched, np.ceil(most * 1e12).astype(np.int64)])]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["k", "band", "n"])

    rows = made.mapInArrow(run, "k int, band int, n long").groupBy("k", "band").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    wanted = F.element_at(F.lit(np.tile(depth, 2).tolist()), F.col("k") + 1)
    before = F.sum("n").over(Window.partitionBy("k").orderBy(F.desc("band"))) - F.col("n")
    reached = rows.where("band >= 0").withColumn("open", before < wanted).where("open").groupBy("k").agg(F.min("band").alias("x"))
    found = reached.select("k", F.lit(0).alias("what"), F.col("x").cast("long").alias("x")).unionByName(rows.where("band < 0").select("k", "band", F.when(F.col("band") == -1, F.col("n")).otherwise(F.col("most")).alias("x")).withColumnRenamed("band", "what"))
    cuts, matched, most = np.full((2, n), _BANDS), np.zeros(n, np.int64), np.zeros(n)
    for r in found.collect():
        if r["what"] == 0:
            cuts[r["k"] // n, r["k"] % n] = r["x"]
        elif r["what"] == -1:
            matched[r["k"]] = r["x"]
        else:
            most[r["k"]] = r["x"] / 1e12
    return cuts, matched, most


def _reach(made: DataFrame, ranks: _Ranks, cuts: np.ndarray, depth: np.ndarray, every: bool) -> dict[str, list]:
    """q, path, ordinal, similarity, lexical, age, overlap, coverage of the first ``depth`` chunks of each question by either score."""
    n = ranks.asked.n
    kind = "k int, q int, path string, ordinal int, similarity double, lexical double, age double, overlap double, coverage double"

    def run(batches):
        held = [Best(depth, np.zeros(n, np.int64)) for _ in range(2)]
        for b in _read(batches):
            both, s = ranks.of(b)
            paths, overlap, coverage, age = np.array(b["path"], dtype=object), s.overlap(), s.coverage(), s.age()
            for k, (values, bands, counted) in enumerate(both):
                q, i = np.nonzero(counted & (b["shown"] | every)[None, :] & (bands >= cuts[k][:, None]))
                more = np.stack([both[0][0][q, i], both[1][0][q, i], age[i], overlap[q, i], coverage[q, i]], axis=1)
                held[k].add(q, values[q, i], paths[i], b["ordinal"][i], more)
        for k, x in enumerate(held):
            x.cut()
            if x.held is not None:
                q, _, path, ordinal, more = x.held
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), k), pa.int32()), pa.array(q, pa.int32()), pa.array(path, pa.string()), pa.array(ordinal, pa.int32()), *(pa.array(np.ascontiguousarray(c), pa.float64()) for c in more.T)], [x.split()[0] for x in kind.split(", ")])

    value = F.when(F.col("k") == 0, F.col("similarity")).otherwise(F.col("lexical"))
    place = F.row_number().over(Window.partitionBy("k", "q").orderBy(F.desc(value), "path", "ordinal"))
    first = made.mapInArrow(run, kind).withColumn("place", place).where(F.col("place") <= F.element_at(F.lit(depth.tolist()), F.col("q") + 1))
    return first.drop("k", "place").distinct().toArrow().to_pydict()


def _places(made: DataFrame, ranks: _Ranks, found: dict) -> np.ndarray:
    """The ranks of the found rows, by similarity and by keyword score, among all chunks; a row of two for each.

    Every task counts its chunks between the found ones of each question; equal scores fall to path and ordinal.
    """
    n, q = ranks.asked.n, np.array(found["q"], np.int64)
    names = list(zip(found["path"], found["ordinal"], strict=True))
    keys = sorted(set(names))
    number = {x: 2 * i + 1 for i, x in enumerate(keys)}
    own = np.array([number[x] for x in names], float)
    values = [np.array(found["similarity"], float), np.array(found["lexical"], float)]
    orders = [np.lexsort((own, -v, q)) for v in values]
    starts = np.searchsorted(q[orders[0]], np.arange(n + 1))
    # complex numbers are ordered by their first part, then by the second
    sought = [(-v + 1j * own)[o] for v, o in zip(values, orders, strict=True)]
    total = len(q) + n

    def run(batches):
        counts = np.zeros(2 * total, np.int64)
        for b in _read(batches):
            both, _ = ranks.of(b)
            mine = np.empty(len(b["path"]))
            for i, x in enumerate(zip(b["path"], b["ordinal"].tolist(), strict=True)):
                at = bisect_left(keys, x)
                mine[i] = 2 * at + (at < len(keys) and keys[at] == x)
            for k, (x, _, counted) in enumerate(both):
                for j in range(n):
                    if starts[j] < starts[j + 1]:
                        put = np.searchsorted(sought[k][starts[j] : starts[j + 1]], (-x[j] + 1j * mine)[counted[j]], side="right")
                        counts[k * total + starts[j] + j :][: starts[j + 1] - starts[j] + 1] += np.bincount(put, minlength=starts[j + 1] - starts[j] + 1)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(counts[full], pa.int64())], ["k", "n"])

    counts = np.zeros(2 * total, np.int64)
    for r in made.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    out = np.zeros((len(q), 2), np.int64)
    for k in range(2):
        for j in range(n):
            a, z = starts[j], starts[j + 1]
            # a row stands behind those counted up to it; it is itself counted after its own place
            out[orders[k][a:z], k] = np.cumsum(counts[k * total + a + j :][: z - a]) + 1
    return out


def ranked_candidates(made: DataFrame, asked: Asked, corpus: Corpus, policies: list, filtered: bool = False) -> DataFrame:
    """candidates() for reciprocal-rank fusion: the first chunks by either score, with their ranks among all chunks.

    A chunk that is not taken has worse ranks than all that are taken by that score.  If one could still win at the best
    age and with the most path words, more are taken for the question, until none can or all are taken.  ``filtered``: not all chunks are shown;
    the best one, to which the scores relate, may then be another.
    """
    ranks, n = _Ranks(asked, corpus), asked.n
    heads = np.repeat([p.rerank_budget for p in policies], n)
    files = np.repeat([p.rerank_budget + p.top_k for p in policies], n)
    # the largest sum of two shares is among the first rrf_k + 2 by either rank
    least = max(p.rrf_k for p in policies) + 2
    depth, rows = np.full(n, max(DEPTH, least)), []
    while depth.any():
        cuts, matched, overlaps = _cuts(made, ranks, depth, False)
        found = _reach(made, ranks, cuts, depth, False)
        own = len(found["q"])
        if filtered:
            few = np.minimum(depth, least)
            more = _reach(made, ranks, _cuts(made, ranks, few, True)[0], few, True)
            found = {c: x + more[c] for c, x in found.items()}
        places = _places(made, ranks, found)
        q, path, ordinal = np.array(found["q"], np.int64), np.array(found["path"], dtype=object), np.array(found["ordinal"], np.int32)
        lexical, age, overlap, coverage = (np.array(found[c], float) for c in ("lexical", "age", "overlap", "coverage"))
        places[:, 1] = np.where(lexical > 0, places[:, 1], matched[q] + 1)
        # the best ranks of a chunk that is not taken
        beyond, left = np.ones((n, 2)), depth > 0
        for j in np.flatnonzero(left):
            mine = np.flatnonzero(q[:own] == j)
            near, word = np.sort(places[mine, 0]), np.sort(places[mine[lexical[mine] > 0], 1])
            left[j] = len(near) >= depth[j]
            beyond[j] = [near[depth[j] - 1] + 1 if left[j] else 1, word[depth[j] - 1] + 1 if len(word) >= depth[j] else matched[j] + 1]
        best, rests = Best(heads, files), []
        for k, p in enumerate(policies):
            w, c = p.dense_weight, p.rrf_k
            relevance, most = w / (c + places[:, 0]) + (1 - w) / (c + places[:, 1]), np.zeros(n)
            np.maximum.at(most, q, relevance)
            most = np.where(most > 0, most, 1.0)
            score = relevance / most[q] + p.recency_weight * age + p.metadata_weight * overlap
            fine = np.flatnonzero(~np.isnan(score[:own]))
            best.add(k * n + q[fine], round9(score[fine]), path[fine], ordinal[fine], coverage[fine])
            rests.append((w / (c + beyond[:, 0]) + (1 - w) / (c + beyond[:, 1])) / most + max(0, p.recency_weight) + max(0, p.metadata_weight) * overlaps)
        best.cut()
        open_ = left & (np.stack(rests) >= best.least.reshape(-1, n) - 1e-8).any(axis=0)
        rows += [r for r in _found(best, n).to_pylist() if not open_[r["q"]]]
        depth = np.where(open_, depth * 4, 0)
    return made.sparkSession.createDataFrame(rows, _FOUND)
