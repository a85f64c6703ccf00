"""Toxicity by weak supervision.

Many voters look at a document: lexicon voters (``voters`` word beginnings mined from the labelled sample) and pattern
voters (shouting, repeated marks, a word said over and over).  They vote on labelled and on unlabelled documents alike; where there is
an annotators' label it is one voter more, noisy like the others.  A generative label model estimates by expectation-maximisation how
often each voter fires on toxic and on other documents.  It also estimates the voters' correlations within each class
and discounts those that repeat one another.  A linear classifier over the ``features`` word beginnings that tell the classes apart most is
then trained on the posteriors of all these documents, but for those without a label or a vote, and scores every document.

Labels come from a bounded sample (``sample`` documents), unlabelled documents from another (``more`` documents), both by the hash of
the id and outside the held-out fold.  They reach the driver as hashes.  Everything else covers all rows and whole texts.

Defined results: null and empty texts get the classifier's score for no features; without any labelled
document every score is below 0.5; very long texts are scored whole, in memory in proportion to their distinct words; equal texts get
equal scores; one row per input row; further columns are ignored unless kept, and those to keep may not be called ``held_out``,
``score`` or ``predicted``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction_of_crc, hand_back, lean
from .sampling import labelled, unlabelled

#: Lengths of the word beginnings that are features.
LENGTHS = (3, 4, 5, 6)
_EDGES = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "¿¡«»“”’…"
CACHE_WORDS = 150_000


def beginnings(word: str) -> list[str]:
    w = word.strip(_EDGES)
    return [w[:n] for n in LENGTHS if len(w) >= n] or ([w] if w else [])


def feature_hashes(text: str) -> np.ndarray:
    """Distinct 32-bit hashes of all word beginnings."""
    found = {b for w in set(text.lower().split()) for b in beginnings(w)}
    return np.unique(np.fromiter((zlib.crc32(b.encode()) for b in found), dtype=np.uint32, count=len(found)))


def patterns(text: str) -> list[bool]:
    """Votes of the pattern voters."""
    words = text.split()
    letters = sum(map(str.isalpha, text))
    n = max(len(words), 1)
    return [
        letters > 20 and sum(map(str.isupper, text)) > 0.5 * letters,
        text.count("!!") > 0.2 * n,
        len(words) > 10 and len(set(words)) < 0.3 * n,
    ]


@dataclass
class Model:
    bias: float
    weights: dict[int, float]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def label_model(votes: np.ndarray, anchor: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of the toxic class for each row of ``votes`` (rows x voters, 0 or 1).

    ``anchor`` is the annotators' vote: 1, 0, or -1 where there is none.  The rates start from the rows that have one.  Each voter's log
    likelihood ratio is divided by one plus the sum of its positive correlations with the others inside
    a class, so that voters which fire together count once.
    """
    v = votes.astype(np.float64)
    told = anchor >= 0
    post = np.where(told, np.clip(anchor, 0.05, 0.95), 0.0)
    weight = told.astype(np.float64)  # rows without a label join once the rates are known
    for _ in range(rounds):
        one, other = post * weight, (1 - post) * weight
        prior = np.clip(one.sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)
        p1, p0 = (one @ v + 0.5) / (one.sum() + 1), (other @ v + 0.5) / (other.sum() + 1)
        share = np.zeros(v.shape[1])
        for of_class, p in ((one, p1), (other, p0)):
            centred = (v - p) * np.sqrt(of_class / max(of_class.sum(), 1e-9))[:, None]
            cov = centred.T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(corr, 0)
            share = np.maximum(share, corr.sum(axis=1))
        on, off = np.log(p1 / p0) / (1 + share), np.log((1 - p1) / (1 - p0)) / (1 + share)
        logit = np.log(prior / (1 - prior)) + v @ on + (1 - v) @ off
        # the annotators look at the text, not at the other voters: their rates stand alone
        y = (anchor == 1) & told
        a1 = (post[told] @ y[told] + 0.5) / (post[told].sum() + 1)
        a0 = ((1 - post[told]) @ y[told] + 0.5) / ((1 - post[told]).sum() + 1)
        logit += np.where(told, np.where(y, np.log(a1 / a0), np.log((1 - a1) / (1 - a0))), 0.0)
        post, weight = _sigmoid(logit), np.ones(len(v))
    return post


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, sample: int = 12_000, more: int = 2_000, voters: int = 96, features: int = 4_000) -> Model:
    """The classifier; at most ``sample`` labelled and ``more`` other documents outside the held-out fold are read, as hashes."""
    model = _fit(docs, labels, mod, held_out, sample, more, voters, features)
    hand_back()  # the sample is gone, and the driver runs on
    return model


def _fit(docs: DataFrame, labels: DataFrame, mod: int, held_out: int, sample: int, more: int, voters: int, features: int) -> Model:
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([feature_hashes(t).tobytes() for t in texts], pa.binary()), pa.array([patterns(t) for t in texts], pa.list_(pa.bool_()))], ["doc_id", "label", "hashes", "patterns"])

    known = labelled(docs, labels, "toxic", mod, held_out, sample).select("doc_id", "text", "label")
    rest = unlabelled(docs, labels, "toxic", mod, held_out, more).select("doc_id", "text", F.lit(-1).alias("label"))
    got = known.unionByName(rest).repartition("doc_id").mapInArrow(lean(run), "doc_id long, label int, hashes binary, patterns array<boolean>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")  # sums and folds do not depend on how rows arrive
    label = np.array(got.column("label").to_pylist(), dtype=np.int64)[order]
    anchor = np.where(label < 0, -1, label > 0)
    if not (anchor >= 0).any():
        return Model(-5.0, {})
    cells = [x.as_buffer() for c in got.column("hashes").chunks for x in c]
    sizes = [len(cells[i]) // 4 for i in order]
    col = np.concatenate([np.frombuffer(cells[i], dtype=np.uint32) for i in order])
    marks = np.array(got.column("patterns").to_pylist(), dtype=bool).reshape(len(sizes), -1)[order]
    del got, cells
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    names = np.unique(col)
    told = anchor >= 0
    n1 = int((anchor == 1).sum())
    n0 = int(told.sum()) - n1
    c1, c0 = np.zeros(len(names)), np.zeros(len(names))
    for at in range(0, len(col), 1_000_000):  # places of the names instead of the hashes, a part at a time
        part = slice(at, at + 1_000_000)
        col[part] = np.searchsorted(names, col[part])
        c1 += np.bincount(col[part][anchor[row[part]] == 1], minlength=len(names))
        c0 += np.bincount(col[part][anchor[row[part]] == 0], minlength=len(names))
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    # lexicon voters: beginnings that mark the toxic class; classifier features: those that tell most either way
    worth = odds * np.sqrt(c1)
    lexicon = np.argsort(-worth, kind="stable")[:voters]
    lexicon = lexicon[(c1[lexicon] >= 3) & (odds[lexicon] > 2)]
    telling = np.abs(odds) * np.sqrt(c1 + c0) * (c1 + c0 >= 3)
    kept = np.argsort(-telling, kind="stable")[: min(features, int((telling > 0).sum()))]
    votes = np.zeros((len(sizes), len(lexicon)), dtype=bool)
    place = np.full(len(names), -1, dtype=np.int32)
    place[lexicon] = np.arange(len(lexicon))
    hit = (place >= 0)[col]
    votes[row[hit], place[col[hit]]] = True
    votes = np.concatenate([votes, marks], axis=1)
    post = label_model(votes, anchor)
    # documents on which nobody votes teach the classifier nothing
    voted = np.flatnonzero(told | votes.any(axis=1))
    number = np.full(len(sizes), -1)
    number[voted] = np.arange(len(voted))
    place[:] = -1
    place[kept] = np.arange(len(kept))
    hit = (place >= 0)[col] & (number >= 0)[row]
    row, col, target = number[row[hit]], place[col[hit]].astype(np.int64), post[voted]
    w, b = _logistic(row, col, len(voted), len(kept), target)
    b -= _cut(row, col, len(kept), target, anchor[voted])
    return Model(float(b), {int(names[k]): float(x) for k, x in zip(kept, w) if abs(x) > 1e-4})


def _cut(row: np.ndarray, col: np.ndarray, m: int, target: np.ndarray, anchor: np.ndarray, folds: int = 3, dear: float = 3.0) -> float:
    """The logit that parts the labelled documents best, each scored by a classifier that has not seen it.

    A clean document above the cut costs ``dear`` times what a toxic one below costs; both count as shares of their class.
    """
    n = len(target)
    logit, fold = np.zeros(n), np.arange(n) % folds
    for k in range(folds):
        seen = fold[row] != k
        # documents of the fold keep their number but have no features and the mean target: they pull nowhere
        w, b = _logistic(row[seen], col[seen], n, m, np.where(fold == k, target[fold != k].mean(), target))
        z = np.bincount(row, weights=w[col], minlength=n) + b
        logit[fold == k] = z[fold == k]
    toxic, clean = np.sort(logit[anchor == 1]), np.sort(logit[anchor == 0])
    if not len(toxic) or not len(clean):
        return 0.0
    edges = np.sort(np.concatenate([toxic, clean]))
    cuts = np.concatenate([edges[:1] - 1, (edges[1:] + edges[:-1]) / 2, edges[-1:] + 1])
    cost = np.searchsorted(toxic, cuts) / len(toxic) + dear * (1 - np.searchsorted(clean, cuts) / len(clean))
    best = cuts[cost <= cost.min() + 1e-12]
    return float((best[0] + best[-1]) / 2)


def _logistic(row: np.ndarray, col: np.ndarray, n: int, m: int, y: np.ndarray, rounds: int = 200, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features at (row, col) by Adam over whole passes."""
    w, b = np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    mean, var, mean_b, var_b = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + b
        d = (_sigmoid(z) - y) / n
        g, gb = np.bincount(col, weights=d[row], minlength=m) + l2 * w, d.sum()
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        mean_b, var_b = 0.9 * mean_b + 0.1 * gb, 0.999 * var_b + 0.001 * gb * gb
        rate = 0.1 / (1 - 0.9**t)
        w -= rate * mean / (np.sqrt(var / (1 - 0.999**t)) + 1e-9)
        b -= rate * mean_b / (np.sqrt(var_b / (1 - 0.999**t)) + 1e-9)
    return w, b


class _Hits(dict):
    """word -> its features that have a weight."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = tuple(h for h in (zlib.crc32(b.encode()) for b in beginnings(word)) if h in self.weights)
        self[word] = found
        return found


def scorer(model: Model):
    hits, weights, bias = _Hits(model.weights), model.weights, model.bias

    def score(text: str) -> float:
        found = set()
        for x in map(hits.__getitem__, set(text.lower().split())):
            if x:
                found.update(x)
        z = bias + sum(weights[h] for h in sorted(found))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

    return score


def score(docs: DataFrame, model: Model, mod: int = 5, held_out: int = 0, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``keep`` adds further columns of documents as they are.

    Texts go to Python and only scores come back.
    """

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = scorer(model)
        for texts in parts:
            yield pa.array([one(t.as_py() or "") for t in texts], pa.float64())

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in keep or [] if c != "doc_id"], F.arrow_udf(lean(run), "double")(F.col("text")).alias("score"))
    fold = fraction_of_crc("doc_id", mod)
    return scored.select("doc_id", *(keep or []), F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
