"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

A text is its UTF-8 bytes, A-Z lower-cased as for the base, and an end.  Each symbol is decomposed into binary decisions
(end or not, then eight bits from the top); every decision has a tree of contexts, the preceding bytes up to ``depth``.
The weighted probability of a node mixes its Krichevsky-Trofimov estimate with the product of its children's, bottom-up; the
same weights give the predictive probability of every decision, top-down.  The log10 probability of a text is the sum over its
symbols (code length in bits per byte: minus log2, by length).

Every context of every text up to ``depth`` bytes is a node; nothing is pruned, so the model grows with the corpus.

1. Documents are counted to n-grams (context, symbol): ``n`` in training texts, ``met`` in all.  N-grams that only held-out texts
   hold count zero; a decision without counts has weighted probability one and predicts one half, by the same formula.
2. N-grams meet by the newest ``depth - 2`` bytes of their context.  At most 2^16 contexts share those, and they are worked
   through in runs of ``_RUN`` n-grams, which ends with one row for each such prefix.
3. Prefixes meet by their newest byte; the up to 65,536 (byte, decision) pairs that remain give the root on the driver.
4. The weights go back down the same two steps and give the log10 probability of every n-gram.
5. N-grams that make up at least 1/``common`` of all positions, at most ``common`` of them, are broadcast
   with it; all others meet theirs in a join.

Base score: add-one unigrams on words.  Counts are aggregated over the corpus.  Words that make up
at least 1/``head`` of all tokens, at most ``head`` of them, are broadcast; all others meet their counts in a join.

Defined results: null texts count as empty (one token, the end); without training documents all
counts are zero and the model is uniform; rows with a null id are training rows; texts equal byte for byte get equal scores up to
rounding; very long texts are counted and scored in pieces that keep their context; further columns are ignored; one row per input row.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, fraction_of_crc, id_text, stage

END = 256
#: Kinds of counted keys.
NGRAM, WORD = 0, 1
_END_WORD = xxhash.xxh3_64_intdigest(b" end ")  # no word holds a space


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


#: Bytes that are turned into n-grams at once.
_PIECE = 1_000_000


def _pieces(texts: list[bytes], depth: int):
    """Lists of (number of the text, context, bytes, last), of about ``_PIECE`` bytes each; longer texts are cut at its multiples."""
    part, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), _PIECE):
            body = t[at : at + _PIECE]
            if part and size + len(body) > _PIECE:
                yield part
                part, size = [], 0
            part.append((i, (bytes(depth) + t[max(at - depth, 0) : at])[-depth:], body, at + len(body) == len(t)))
            size += len(body)
    if part:
        yield part


def ngrams(pieces: list[tuple], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context << 9 | symbol) of every position, the end of a text included, and the positions of each piece.

    The newest byte of the context is on top; before a text lie zeros.
    """
    data = np.frombuffer(b"".join(c + t + b"\0" * last for _, c, t, last in pieces), dtype=np.uint8)
    sizes = np.array([len(t) + last for _, _, t, last in pieces], dtype=np.int64)
    ends = np.cumsum(sizes + depth)
    keep = np.ones(len(data), dtype=bool)
    for i in range(1, depth + 1):
        keep[ends - sizes - i] = False
    key = data.astype(np.int64)
    key[ends[[last for _, _, _, last in pieces]] - 1] = END
    wide = data.astype(np.int64)
    for i in range(1, depth + 1):
        key[i:] |= wide[: len(data) - i] << (9 + 8 * (depth - i))
    return key[keep], sizes


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def both_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n, met) of documents (text, held_out): n-grams of bytes and hashes of words; n over training documents, met over all."""

    def out(kind, keys, n, met):
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), kind, dtype=np.int32)), pa.array(keys[part]), pa.array(n[part]), pa.array(met[part])], ["kind", "key", "n", "met"])

    def run(batches):
        words, grams, size = {False: Counter(), True: Counter()}, [], 0
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            texts = batch.column("text")
            for value in (False, True):
                rows = np.flatnonzero(held == value)
                for at in range(0, len(rows), 500):  # texts are taken out of the batch a few at a time
                    some = [texts[int(i)].as_py().encode("utf-8", "replace").lower() for i in rows[at : at + 500]]
                    for part in _pieces(some, depth):
                        keys, n = np.unique(ngrams(part, depth)[0], return_counts=True)
                        grams.append((keys, n * (not value), n))
                        size += len(keys)
                    for t in some:
                        words[value].update(t.split())
                    words[value][None] += len(some)
                    if size > 2_500_000:
                        grams = [_summed(*(np.concatenate(x) for x in zip(*grams)))]
                        size = len(grams[0][0])
                        if size > 1_500_000:
                            yield from out(NGRAM, *grams[0])
                            grams, size = [], 0
                    if len(words[value]) > 400_000:
                        yield from told(words[value], value)
        if grams:
            yield from out(NGRAM, *_summed(*(np.concatenate(x) for x in zip(*grams))))
        for value in (False, True):
            yield from told(words[value], value)

    def told(words, held):
        hashes = np.fromiter((_END_WORD if w is None else xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
        n = np.fromiter(words.values(), dtype=np.int64, count=len(words))
        words.clear()
        yield from out(WORD, _signed(hashes), n * (not held), n)

    return docs.select("text", "held_out").mapInArrow(run, "kind int, key long, n long, met long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: the recurrence up to 8, then Stirling's series."""
    shift = np.zeros_like(x)
    y = x.astype(np.float64).copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    r = 1 / y
    r2 = r * r
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 / 1680)))


#: N-grams that are worked through at once.
_RUN = 200_000


class Nodes:
    """The nodes of one depth d, in order of key = decision << 8d | context.

    n0 and n1 count zeros and ones; weighted is the log weighted probability, stop the share of the node's own
    estimate in it, one the estimate that the next decision is a one.
    """

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None = None):
        self.key, self.n0, self.n1 = key, n0, n1
        a, b = n0.astype(np.float64), n1.astype(np.float64)
        own = _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)
        self.weighted = own if below is None else np.logaddexp(own, below) - math.log(2)
        self.stop = np.ones(len(own)) if below is None else np.exp(own - math.log(2) - self.weighted)
        self.one = (b + 0.5) / (a + b + 1)

    def down(self, so_far: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What nodes up to this depth give to the prediction, and the weight that passes on, from the same of the depth above."""
        return so_far + left * self.stop * self.one, left * (1 - self.stop)


def _above(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray) -> Nodes:
    """The parents of nodes in any order."""
    key, n0, n1, below = _summed(key >> 8, n0, n1, weighted)
    return Nodes(key, n0, n1, below)


def _up(nodes: Nodes) -> Nodes:
    return _above(nodes.key, nodes.n0, nodes.n1, nodes.weighted)


def _decided(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the n-gram, key of the node at full depth, one) of every decision of every n-gram."""
    context, symbol = keys >> 9, keys & 511
    body = np.flatnonzero(symbol != END)
    gram, decision, one = [np.arange(len(keys))], [np.zeros(len(keys), dtype=np.int64)], [symbol == END]
    for level in range(8):
        gram.append(body)
        decision.append((1 << level) + (symbol[body] >> (8 - level)))
        one.append((symbol[body] >> (7 - level) & 1).astype(bool))
    gram, one = np.concatenate(gram), np.concatenate(one)
    return gram, np.concatenate(decision) << (8 * depth) | context[gram], one


def _leaves(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[Nodes, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the full depth; and of every decision its n-gram, its node's place and whether it is a one."""
    gram, node, one = _decided(keys, depth)
    times = n[gram]
    key, n0, n1 = _summed(node, times * ~one, times * one)
    return Nodes(key, n0, n1), gram, np.searchsorted(key, node), one


def _runs(keys: np.ndarray, shift: int):
    """Slices of sorted keys of about ``_RUN``, cut only where key >> shift changes."""
    at = 0
    while at < len(keys):
        end = min(at + _RUN, len(keys))
        if end < len(keys):
            end = int(np.searchsorted(keys, (keys[end] >> shift << shift), "left"))
            if end <= at:
                end = int(np.searchsorted(keys, (keys[at] >> shift) + 1 << shift, "left"))
        yield slice(at, end)
        at = end


def _prefix_nodes(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[Nodes, Nodes]:
    """Nodes at depth - 1 and depth - 2 (at least one) of n-grams that hold all of their prefixes, by key."""
    parts = []
    for part in _runs(keys, 9 + 8):
        parts.append(_up(_leaves(keys[part], n[part], depth)[0]))
    key, n0, n1, weighted, stop, one = (np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "n0", "n1", "weighted", "stop", "one"))
    middle = object.__new__(Nodes)
    order = np.argsort(key)
    middle.key, middle.n0, middle.n1, middle.weighted, middle.stop, middle.one = (x[order] for x in (key, n0, n1, weighted, stop, one))
    return middle, _up(middle) if depth > 2 else middle


def _lists(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    at = pa.array(offsets.astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(v)) for v in values]


def _by_prefix(nodes: Nodes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the nodes by (prefix, decision), the distinct prefixes, and where each begins."""
    context = nodes.key & ((1 << bits) - 1)
    order = np.argsort(context, kind="stable")
    prefix, starts = np.unique(context[order], return_index=True)
    return order, prefix, np.append(starts, len(order))


def _prefixes(grams: DataFrame, depth: int) -> DataFrame:
    """(prefix, keys, n, met, decision, n0, n1, weighted): a row for each prefix with its n-grams and its node of every decision."""
    newest = max(depth - 2, 1)
    shift = 9 + 8 * (depth - newest)

    def whole(keys, n, met):
        _, top = _prefix_nodes(keys, n, depth)
        order, prefix, at = _by_prefix(top, 8 * newest)
        nodes = _lists(at, (top.key[order] >> 8 * newest).astype(np.int32), top.n0[order], top.n1[order], top.weighted[order])
        grams = _lists(np.append(np.searchsorted(keys >> shift, prefix), len(keys)), keys, n, met)
        return pa.RecordBatch.from_arrays([pa.array(prefix), *grams, *nodes], ["prefix", "keys", "n", "met", "decision", "n0", "n1", "weighted"])

    def run(batches):
        held = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([a, batch.column(c).to_numpy()]) for a, c in zip(held, ("key", "n", "met"))]
            if len(held[0]) > _RUN:
                cut = int(np.searchsorted(held[0], held[0][-1] >> shift << shift, "left"))
                if cut:
                    yield whole(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield whole(*held)

    schema = "prefix long, keys array<long>, n array<long>, met array<long>, decision array<int>, n0 array<long>, n1 array<long>, weighted array<double>"
    spread = grams.withColumn("prefix", F.shiftright("key", shift)).repartition("prefix").sortWithinPartitions("key").select("key", "n", "met")
    return stage(spread.mapInArrow(run, schema), "prefixes")


def _flat(batch: pa.RecordBatch, *columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The lengths of the lists of the first column, and the values of all of them."""
    lengths = np.diff(batch.column(columns[0]).offsets.to_numpy())
    return lengths, [batch.column(c).flatten().to_numpy() for c in columns]


def _branches(prefixes: DataFrame, depth: int, work, schema: str) -> DataFrame:
    """``work`` on the nodes of each newest byte: lists of nodes by depth, from that of the prefixes up to depth one."""
    newest = max(depth - 2, 1)

    def branch(batches):
        parts = []
        for batch in batches:
            lengths, (decision, n0, n1, weighted) = _flat(batch, "decision", "n0", "n1", "weighted")
            prefix = np.repeat(batch.column("prefix").to_numpy(), lengths)
            parts.append((decision.astype(np.int64) << (8 * newest) | prefix, n0, n1, weighted))
        if not parts:
            return
        key, n0, n1, weighted = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        levels = [(key[order], n0[order], n1[order], weighted[order])]
        above = []
        for d in range(newest - 1, 0, -1):
            nodes = _above(*levels[-1])
            above.append(nodes)
            levels.append((nodes.key, nodes.n0, nodes.n1, nodes.weighted))
        yield from work(levels, above)

    columns = prefixes.select("prefix", F.shiftright("prefix", 8 * (newest - 1)).alias("byte"), "decision", "n0", "n1", "weighted")

    def run(batches):
        held, of = [], None
        for batch in batches:
            bytes_ = batch.column("byte").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(bytes_)) + 1, len(bytes_))
            at = 0
            for end in cuts.tolist():
                if end == at:
                    continue
                if of is not None and bytes_[at] != of:
                    yield from branch(held)
                    held = []
                of = bytes_[at]
                held.append(batch.slice(at, end - at))
                at = end
        yield from branch(held)

    return columns.repartition("byte").sortWithinPartitions("byte").mapInArrow(run, schema)


def gram_scores(grams: DataFrame, depth: int) -> DataFrame:
    """(key, met, logp) of every n-gram (key, n, met), n its count in training: the log10 probability of its symbol after its context."""
    if not 2 <= depth <= 5:
        raise ValueError("depth is 2 to 5 bytes")
    spark, newest = grams.sparkSession, max(depth - 2, 1)
    prefixes = _prefixes(grams, depth)

    def first(levels, above):
        key, n0, n1, weighted = levels[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, n0, n1, weighted)], ["key", "n0", "n1", "weighted"])

    # at most 65,536 rows: 256 bytes of 256 decisions
    ones = [c.to_numpy() for c in _branches(prefixes, depth, first, "key long, n0 long, n1 long, weighted double").toArrow().columns]
    root = _above(*ones)
    known = np.sort(ones[0])
    so_far, left = root.down(np.zeros(len(root.key)), np.ones(len(root.key)))
    at = np.searchsorted(root.key, known >> 8)
    so_far, left = so_far[at], left[at]

    def back(levels, above):
        key = levels[-1][0]
        at = np.searchsorted(known, key)
        a, b = so_far[at], left[at]
        for nodes, lower in zip(reversed(above), [x[0] for x in reversed(levels[:-1])]):
            a, b = nodes.down(a, b)
            at = np.searchsorted(key, lower >> 8)
            a, b, key = a[at], b[at], lower
        context = key & ((1 << 8 * newest) - 1)
        order = np.argsort(context, kind="stable")
        prefix, starts = np.unique(context[order], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(prefix), *_lists(np.append(starts, len(order)), a[order], b[order])], ["prefix", "so_far", "left"])

    states = stage(_branches(prefixes, depth, back, "prefix long, so_far array<double>, left array<double>"), "states")

    def predict(batches):
        for batch in batches:
            sizes = np.cumsum(np.diff(batch.column("keys").offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _RUN, "right")))
                yield from predicted(batch.slice(at, end - at))
                at = end

    def predicted(batch):
        _, (keys, n, met) = _flat(batch, "keys", "n", "met")
        lengths, (decision, a, b) = _flat(batch, "decision", "so_far", "left")
        node = decision.astype(np.int64) << (8 * newest) | np.repeat(batch.column("prefix").to_numpy(), lengths)
        order, grams_in_order = np.argsort(node), np.argsort(keys)
        a, b, keys, n, met = a[order], b[order], keys[grams_in_order], n[grams_in_order], met[grams_in_order]
        middle, top = _prefix_nodes(keys, n, depth)
        if depth > 2:
            a, b = top.down(a, b)
            up = np.searchsorted(top.key, middle.key >> 8)
            a, b = a[up], b[up]
        a, b = middle.down(a, b)
        for part in _runs(keys, 9 + 8):
            leaves, gram, place, one = _leaves(keys[part], n[part], depth)
            up = np.searchsorted(middle.key, leaves.key >> 8)
            p = np.clip(leaves.down(a[up], b[up])[0], 1e-15, 1 - 1e-15)[place]
            logp = np.bincount(gram, weights=np.log10(np.where(one, p, 1 - p)), minlength=len(keys[part]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(met[part]), pa.array(logp)], ["key", "met", "logp"])

    both = prefixes.select("prefix", "keys", "n", "met", "decision").join(states, "prefix")
    out = stage(both.mapInArrow(predict, "key long, met long, logp double"), "grams")
    drop_stage(prefixes)
    drop_stage(states)
    return out


class _Table:
    """Values of int64 keys: a direct-mapped table for most of them, the sorted keys for those whose place another one has."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(int(len(keys)).bit_length() + 1, 4)
        self.at = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.zeros(1 << self.bits)
        place = self._place(keys)
        self.at[place], self.value[place] = keys, values

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, zero where it has none; and whether it has one."""
        place = self._place(keys)
        hit = self.at[place] == keys
        value = np.where(hit, self.value[place], 0.0)
        other = np.flatnonzero(~hit)
        if len(other) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            met = self.keys[at] == keys[other]
            value[other[met]] = self.values[at[met]]
            hit[other[met]] = True
        return value, hit


def score(docs: DataFrame, mod: int = 7, held_out: int = 2, depth: int = 5, common: int = 4_000_000, head: int = 1_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of documents(doc_id, text)."""
    spark = docs.sparkSession
    texts = id_text(docs).withColumn("held_out", F.coalesce(fraction_of_crc("doc_id", mod) == held_out, F.lit(False)))
    counted = stage(both_counts(texts, depth), "counts")
    known_grams = gram_scores(counted.where(F.col("kind") == NGRAM).select("key", "n", "met"), depth)
    positions = known_grams.agg(F.sum("met")).first()[0] or 0
    least_met = max(1, math.ceil(positions / common))
    often = known_grams.where(F.col("met") >= least_met).toArrow()
    order = np.argsort(often.column("met").to_numpy())  # of two n-grams for one place, the table keeps the later one
    head_grams = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy()[order] for c in ("key", "logp")))
    words = counted.where((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(1, math.ceil(total / head))
    top = words.where(F.col("n") >= least).toArrow()
    keys, n = top.column("key").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(keys)
    heads = spark.sparkContext.broadcast((keys[order], n[order]))
    scale = math.log10(total + distinct + 1)

    def run(batches):
        table, (head_keys, head_n) = _Table(*head_grams.value), heads.value

        def grams_of(texts):
            """Sum of log10 over the broadcast n-grams of each text, and the others of each text."""
            sums, missed = np.zeros(len(texts)), [[] for _ in texts]
            for part in _pieces(texts, depth):
                keys, sizes = ngrams(part, depth)
                value, hit = table.find(keys)
                ends = np.cumsum(sizes)
                for (i, *_), total in zip(part, np.add.reduceat(value, ends - sizes)):
                    sums[i] += total
                others = np.flatnonzero(~hit)
                for (i, *_), found in zip(part, np.split(keys[others], np.searchsorted(others, ends[:-1]))):
                    missed[i].append(found)
            return sums, [np.concatenate(x) for x in missed]

        head_log = np.log10(head_n + 1.0) - scale
        hashed = _Hashes()
        for batch in batches:
            column, tokens, known, base, logp, tail, times, others = batch.column("text"), [], [], [], [], [], [], []
            part, size = [], 0
            for i, t in enumerate(column):
                t = t.as_py().encode("utf-8", "replace").lower()
                part.append(t)
                size += len(t)
                if size > _PIECE or i == len(column) - 1:
                    sums, missed = grams_of(part)
                    logp.append(sums)
                    others += missed
                    part, size = [], 0
                w = t.split()
                h = np.fromiter(map(hashed.__getitem__, w), dtype=np.uint64, count=len(w))
                h, f = np.unique(np.append(h, np.uint64(_END_WORD)), return_counts=True)
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(head_keys, h), max(len(head_keys) - 1, 0))
                hit = head_keys[at] == h if len(head_keys) else np.zeros(len(h), dtype=bool)
                tokens.append(len(w) + 1)
                known.append(int(f[hit].sum()))
                base.append(float((f[hit] * head_log[at[hit]]).sum()))
                tail.append(h[~hit])
                times.append(f[~hit])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in tail])]).astype(np.int32))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tail, times)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[0].astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.int32)))]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in others])]).astype(np.int32))
            lists.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(others) if others else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(logp) if logp else [], pa.float64()), *lists], ["doc_id", "held_out", "n_tokens", "known", "base", "score", "tail", "times", "others"])

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<long>, times array<int>, others array<long>"
    rows = texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "scored")  # written once: a row's number stays the same
    rare = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("key"), F.col("x.times").alias("f"))
    met = rare.join(words.where(F.col("n") < least), "key").groupBy("row").agg(F.sum("f").alias("known_more"), F.sum(F.col("f") * F.log10(F.col("n") + 1.0)).alias("gained"))
    far = rows.select("row", F.explode("others").alias("key")).join(known_grams.where(F.col("met") < least_met), "key").groupBy("row").agg(F.sum("logp").alias("more"))
    unseen = rows.join(met, "row", "left").join(far, "row", "left").na.fill(0, ["known_more", "gained", "more"])
    tail_tokens = F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x)
    return unseen.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("known_more")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("gained") - tail_tokens * F.lit(scale)).alias("base_score"), (F.col("score") + F.col("more")).alias("score"))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value
