"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its own and of both neighbouring lines (shares of character classes,
word statistics, repetition, length).  A two-state chain (bad, good) labels the lines;
forward-backward marginals, weighted by the lines' lengths, add up to the document's share of good text,
which a two-parameter calibration turns into the score.

The chain is trained by maximum likelihood on a bounded sample of labelled documents (``sample``), each
line with its document's label; the loss of a document counts once, however many lines it has.  A document of more than
``lines`` lines is represented in training by eight evenly spaced runs of lines; executors turn the sample into numbers, so no
text comes to the driver.  Scoring covers all rows, all lines and all words.

Lines are turned into numbers ``_LINES`` at a time, and the chains of texts of like length run side by side, at most ``_CELLS``
lines at once; the chain of a text with more than ``_LONG`` lines runs as a scan over blocks of lines.  Every number of a line is
worked out from that line and its neighbours alone, so a text's score does not depend on the texts around it.

Defined results: null and empty texts are one empty line; without labelled documents every score is 0.5; very long texts, of
one line or of many, are scored whole; equal texts get equal scores; one row per input row; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction_of_crc, id_text
from .sampling import labelled

_CLASSES = ["upper", "lower", "digit", "space", "bar", "mark", "stop", "high"]
#: Class of each byte of UTF-8.
_CLASS_OF = np.full(256, 5, dtype=np.uint8)
for _name, _bytes in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", (9, 11, 12, 13, 32)), ("bar", (124,)), ("stop", b".,;:?'\"-"), ("high", range(128, 256))):
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)
_OWN = len(_CLASSES) + 6
WIDTH = 3 * _OWN + 3  # a constant, the features, is first, is last


def _words(line: str) -> tuple[float, float, float, float]:
    w = line.split()
    n = len(w)
    if not n:
        return 0.0, 1.0, 0.0, 0.0
    return float(n), len(set(w)) / n, sum(x.isupper() for x in w) / n, len(line) / n


#: Lines that are turned into numbers at once; lines of one group of chains; lines beyond which a chain is scanned.
_LINES, _CELLS, _LONG = 50_000, 200_000, 1024


def _repeated(lines: list[str]) -> np.ndarray:
    """Whether the same line, not an empty one, stood before."""
    seen: set[str] = set()
    out = np.zeros(len(lines))
    for i, x in enumerate(lines):
        if x:
            out[i] = x in seen
            seen.add(x)
    return out


def own_features(lines: list[str], again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x _OWN) of the lines themselves, and the bytes of each (one at least)."""
    data = np.frombuffer(("\n".join(lines) + "\n").encode("utf-8", "replace"), dtype=np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    starts = np.concatenate([[0], ends[:-1]])
    size = (ends - starts - 1).astype(np.float64)
    kind = _CLASS_OF[data]
    own = np.zeros((len(lines), _OWN))
    for k in range(len(_CLASSES)):
        own[:, k] = np.add.reduceat((kind == k).astype(np.int32), starts)
    own[:, _CLASSES.index("mark")] -= 1  # the line's own end
    own[:, : len(_CLASSES)] /= np.maximum(size, 1)[:, None]
    stats = np.array([_words(x) for x in lines])
    at = len(_CLASSES)
    own[:, at] = np.log1p(size) / 5
    own[:, at + 1] = np.log1p(stats[:, 0]) / 4
    own[:, at + 2] = stats[:, 1]
    own[:, at + 3] = stats[:, 2]
    own[:, at + 4] = np.minimum(stats[:, 3], 30) / 10
    own[:, at + 5] = again
    return own, np.maximum(size, 1)


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A constant, a line's features, those of the line before and of the line after (zeros beyond an end), is first, is last."""
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((len(own), 1)), own, before, after, first[:, None], last[:, None]], axis=1)


def _ends(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(int(counts.sum()), dtype=bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    return first, np.roll(first, -1)


def _potentials(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top = np.maximum(emit, 0)
    return np.exp(-top), np.exp(emit - top), top


def marginals(emit: np.ndarray, move: np.ndarray, counts: np.ndarray, training: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line; in training also the log partition of each chain and its expected moves (2 x 2).

    emit: log potential of good against bad for each line; move: 2 x 2 log potentials; counts: the lines of each chain.
    """
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    emit = np.clip(emit, -60, 60)
    good = np.empty(len(emit))
    logz, moves = np.zeros(len(counts)), np.zeros((len(counts), 2, 2))
    order = np.argsort(counts, kind="stable")
    m = np.exp(move)
    at = 0
    while at < len(order):
        if counts[order[at]] > _LONG and not training:
            for row in order[at:]:
                part = slice(starts[row], starts[row] + counts[row])
                good[part] = _scanned(emit[part], m)
            break
        to = at + 1
        while to < len(order) and (training or counts[order[to]] <= _LONG) and (to + 1 - at) * counts[order[to]] <= _CELLS:
            to += 1
        rows = order[at:to]
        at = to
        n, longest = counts[rows], int(counts[rows].max())
        p0, p1, level = np.ones((longest, len(rows))), np.ones((longest, len(rows))), np.zeros((longest, len(rows)))
        for t in range(longest):
            live = t < n
            p0[t, live], p1[t, live], level[t, live] = _potentials(emit[starts[rows[live]] + t])
        a0, a1, scale = np.empty_like(p0), np.empty_like(p0), np.ones_like(p0)
        for t in range(longest):
            x, y = p0[t], p1[t]
            if t:
                live = t < n
                x = np.where(live, (a0[t - 1] * m[0, 0] + a1[t - 1] * m[1, 0]) * x, a0[t - 1])
                y = np.where(live, (a0[t - 1] * m[0, 1] + a1[t - 1] * m[1, 1]) * y, a1[t - 1])
            scale[t] = x + y
            a0[t], a1[t] = x / scale[t], y / scale[t]
        b0, b1 = np.ones(len(rows)), np.ones(len(rows))
        for t in range(longest - 1, -1, -1):
            live = t < n
            g = a1[t] * b1 / (a0[t] * b0 + a1[t] * b1)
            good[starts[rows[live]] + t] = g[live]
            if t:
                x, y = p0[t] * b0, p1[t] * b1
                if training:
                    pair = np.stack([a0[t - 1], a1[t - 1]], axis=1)[:, :, None] * m[None] * np.stack([x, y], axis=1)[:, None, :]
                    pair /= pair.sum(axis=(1, 2), keepdims=True)
                    moves[rows[live]] += pair[live]
                x, y = x * m[0, 0] + y * m[0, 1], x * m[1, 0] + y * m[1, 1]
                b0, b1 = np.where(live, 2 * x / (x + y), b0), np.where(live, 2 * y / (x + y), b1)
        if training:
            logz[rows] = np.log(scale).sum(axis=0) + level.sum(axis=0)
    return good, logz, moves


def _forward(p0: np.ndarray, p1: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages of one chain, each pair adding up to one: products inside blocks side by side, then from block to block."""
    n = len(p0)
    width = max(int(np.sqrt(n)), 1)
    blocks = -(-n // width)
    full = np.zeros((2, 2, blocks * width))
    for i in (0, 1):
        for j, p in ((0, p0), (1, p1)):
            full[i, j, :n] = m[i, j] * p
        full[i, i, n:] = 1.0
    full[:, :, 0] = np.eye(2) * np.array([p0[0], p1[0]])  # the first line has no move
    full = full.reshape(2, 2, blocks, width)
    for t in range(1, width):
        a, b = full[..., t - 1], full[..., t].copy()
        for i in (0, 1):
            for j in (0, 1):
                full[i, j, :, t] = a[i, 0] * b[0, j] + a[i, 1] * b[1, j]
        full[..., t] /= full[..., t].max(axis=(0, 1))
    start = np.empty((2, blocks))
    x, y = 1.0, 1.0
    for k in range(blocks):
        start[:, k] = x, y
        e = full[:, :, k, -1]
        x, y = x * e[0, 0] + y * e[1, 0], x * e[0, 1] + y * e[1, 1]
        x, y = x / (x + y), y / (x + y)
    a0 = (start[0][:, None] * full[0, 0] + start[1][:, None] * full[1, 0]).ravel()[:n]
    a1 = (start[0][:, None] * full[0, 1] + start[1][:, None] * full[1, 1]).ravel()[:n]
    return a0 / (a0 + a1), a1 / (a0 + a1)


def _scanned(emit: np.ndarray, m: np.ndarray) -> np.ndarray:
    """P(good) of each line of one long chain."""
    p0, p1, _ = _potentials(emit)
    a0, a1 = _forward(p0, p1, m)
    b0, b1 = _forward(p0[::-1], p1[::-1], m.T)  # hold the line's own potential once more
    x, y = a0 * b0[::-1] / p0, a1 * b1[::-1] / p1
    return y / (x + y)


@dataclass
class Chain:
    weights: np.ndarray
    move: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    slope: float = 0.0
    offset: float = 0.0

    def emissions(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each line adds to its own log potential, to that of the line after it and to that of the line before it."""
        w = self.weights / self.spread
        out = []
        for at in (1, 1 + _OWN, 1 + 2 * _OWN):
            total = np.zeros(len(own))
            for k in range(_OWN):  # one feature at a time: a line's sum does not depend on the other lines
                total += own[:, k] * w[at + k]
            out.append(total)
        return tuple(out)

    def shares(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' P(good) for each text."""
        lines = [t.split("\n") for t in texts]
        counts = np.array([len(x) for x in lines], dtype=np.int64)
        again = np.concatenate([_repeated(x) for x in lines])
        flat = [x for text in lines for x in text]
        emit, passed, given, size = (np.empty(len(flat)) for _ in range(4))
        for at in range(0, len(flat), _LINES):
            part = slice(at, at + _LINES)
            own, size[part] = own_features(flat[part], again[part])
            emit[part], passed[part], given[part] = self.emissions(own)
        first, last = _ends(counts)
        w = self.weights / self.spread
        emit += w[0] - float((self.centre * w).sum())
        emit += np.where(first, w[-2], np.roll(passed, 1))
        emit += np.where(last, w[-1], np.roll(given, -1))
        good, _, _ = marginals(emit, self.move, counts, training=False)
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.add.reduceat(good * size, at) / np.add.reduceat(size, at)

    def scores(self, texts: list[str]) -> np.ndarray:
        share = np.clip(self.shares(texts), 1e-6, 1 - 1e-6)
        return np.round(1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.offset))), 9)


def _training_runs(text: str, lines: int) -> tuple[np.ndarray, np.ndarray, list[int], list[bool], list[bool]]:
    """Features and bytes of the lines of a text that train the chain, the lengths of their runs, and which runs begin or end the text."""
    all_ = text.split("\n")
    again, n = _repeated(all_), len(all_)
    size = lines // 8
    runs = [(0, n)] if n <= lines else [(i * (n - size) // 7, i * (n - size) // 7 + size) for i in range(8)]
    own, sizes = own_features([x for a, b in runs for x in all_[a:b]], np.concatenate([again[a:b] for a, b in runs]))
    return own, sizes, [b - a for a, b in runs], [a == 0 for a, _ in runs], [b == n for _, b in runs]


def train(chains: list[tuple], y: np.ndarray, rounds: int = 80, l2: float = 1e-3) -> Chain:
    """chains: _training_runs of each document; y: its label."""
    own, size = (np.concatenate([c[i] for c in chains]) for i in (0, 1))
    runs = np.array([len(c[2]) for c in chains])
    counts = np.array([n for c in chains for n in c[2]], dtype=np.int64)
    first, last = _ends(counts)
    x = with_neighbours(own, first, last)
    x[first, -2] = [b for c in chains for b in c[3]]  # a run's end inside a text is no end of the text
    x[last, -1] = [b for c in chains for b in c[4]]
    centre, spread = x.mean(axis=0), x.std(axis=0)
    centre[0] = 0
    spread[spread < 1e-6] = 1
    x = (x - centre) / spread
    of_run = np.repeat(np.arange(len(chains)), runs)
    lines_of = np.bincount(of_run, weights=counts)
    of_line = np.repeat(of_run, counts)
    label = y[of_line].astype(np.float64)
    weight = 1.0 / lines_of[of_line]
    theta = np.zeros(WIDTH + 4)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    told = np.zeros((2, 2))
    for r, n in zip(of_run, counts):
        told[y[r], y[r]] += (n - 1) / lines_of[r]
    for t in range(1, rounds + 1):
        good, _, moves = marginals(x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2), counts)
        g = np.concatenate([x.T @ ((good - label) * weight), ((moves / lines_of[of_run][:, None, None]).sum(axis=0) - told).ravel()]) / len(y)
        g += l2 * theta * np.concatenate([np.ones(WIDTH), np.full(4, 20.0)])
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        theta -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    chain = Chain(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy(), centre, spread)
    good, _, _ = marginals(x @ chain.weights, chain.move, counts)
    share = np.clip(np.bincount(of_line, weights=good * size) / np.bincount(of_line, weights=size), 1e-6, 1 - 1e-6)
    z = np.log(share / (1 - share))
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(500):
        d = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - target
        a, b = a - 0.05 * (d * z).mean(), b - 0.05 * d.mean() * 5
    chain.slope, chain.offset = float(max(a, 1e-3)), float(b)
    return chain


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, held_out: int = 2, sample: int = 2_400, lines: int = 512) -> Chain:
    """The chain and its calibration, from at most ``sample`` labelled documents outside the held-out fold, of at most ``lines`` lines each."""

    def run(batches):
        for batch in batches:
            rows = [_training_runs(t.as_py(), lines) for t in batch.column("text")]
            values = [[r[0].tobytes() for r in rows], [r[1].tobytes() for r in rows], *([r[i] for r in rows] for i in (2, 3, 4))]
            types = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array(v, t) for v, t in zip(values, types))], ["doc_id", "label", "own", "sizes", "runs", "first", "last"])

    chosen = labelled(docs, labels, "quality", mod, held_out, sample).select("doc_id", "label", "text")
    numbers = chosen.mapInArrow(run, "doc_id long, label int, own binary, sizes binary, runs array<int>, first array<boolean>, last array<boolean>")
    got = numbers.orderBy("doc_id").toArrow()
    y = (np.array(got.column("label").to_pylist(), dtype=np.int64) > 0).astype(np.int64)
    if not len(y):
        return Chain(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(WIDTH), np.ones(WIDTH))
    own = [np.frombuffer(x.as_buffer()).reshape(-1, _OWN) for c in got.column("own").chunks for x in c]
    sizes = [np.frombuffer(x.as_buffer()) for c in got.column("sizes").chunks for x in c]
    return train(list(zip(own, sizes, *(got.column(c).to_pylist() for c in ("runs", "first", "last")))), y)


def score(docs: DataFrame, chain: Chain, mod: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents(doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts, out, at = batch.column("text"), [], 0
            while at < len(texts):  # about four megabytes of text at once
                part, size = [], 0
                while at < len(texts) and (not part or size < 4_000_000):
                    part.append(texts[at].as_py())
                    size += len(part[-1])
                    at += 1
                out.append(chain.scores(part))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else [], pa.float64())], ["doc_id", "score"])

    out = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fraction_of_crc("doc_id", mod) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
