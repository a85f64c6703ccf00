"""Personal data by weak supervision, as DataFrame operations only.

Candidates are the matches of the four base patterns, valid or not, and of looser shapes (an e-mail
address with ``[at]`` and ``[dot]``, a telephone number without its plus).  Five labelers vote yes, no
or nothing on each: a rule of its kind, a gazetteer (top-level names, reserved nets, issuer digits, country and area codes), cue words
for or against in the text before it, its edges (free or part of a longer token), and how regular its shape is.

The corpus is aggregated to counts of vote patterns, at most 4 * 3^5.  For each kind, expectation-maximisation on those counts
estimates the labelers' reliabilities and the share of true spans.  Every labeler has expected rates, and the data move
them from there with a fixed weight however many candidates there are; no labeler may end up speaking for the other class.  So
the classes cannot change places, and a pattern means much the same in a corpus with a hundred candidates or a million.

A logistic span classifier is trained on the posteriors of a bounded sample (about ``sample`` candidates of each kind and shape, by their hash).  Its features are
not the votes but the span and its context: lengths, digits, the first digit, separators, neighbouring characters, the words before and after.
Valid base matches always stay.  A looser candidate is added when the label model gives at least one half and the
classifier at least ``threshold``, it overlaps no base span and no rule of its kind has refused it.

Context is up to 24 code points on either side and ends at the neighbouring match of the same pattern.  Defined results: null
texts count as empty and have no spans; very long texts are searched whole; repeated rows are rows of their own; an
empty corpus has an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stage
from .spans import count_kind, find, joined, overlaps

KINDS = ["email", "ip", "card", "phone"]

# The base patterns.  Possessive repeats and the look-behinds change no match; they
# keep the time linear where a long run of one class has no match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
CUES = {
    "email": r"(?i)mail|contact|write|reach|courriel|correo",
    "ip": r"(?i)\bip\b|host|server|address|login|connect",
    "card": r"(?i)card|visa|master|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|\btel\b|call|mobile|fax|telefon|dial",
}
COUNTER_CUES = {
    "email": r"(?i)example|package|import|git",
    "ip": r"(?i)version|\bv\b|release|section|chapter|build",
    "card": r"(?i)isbn|order|invoice|serial|tracking|\bid\b|timestamp",
    "phone": r"(?i)isbn|order|invoice|serial|version|part|item|page|\bid\b|sku|case",
}
TOP_LEVEL = r"(?i)[.\])\x20](?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"
COUNTRY = r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
AREA = r"^(?:[2-9][02-9][0-9]|[2-9]1[02-9])"
ISSUER = r"^(?:3[47]|3[068]|4|5[1-5]|2[2-7]|6)"
RESERVED = r"^(?:0|10|127|255)\."

LABELERS = ["rule", "gazetteer", "cue", "edges", "shape"]
#: Expected rates of yes and no, for true spans and for others.
EXPECTED = {
    "rule": ((0.95, 0.03), (0.5, 0.48)),
    "gazetteer": ((0.7, 0.1), (0.25, 0.5)),
    "cue": ((0.5, 0.02), (0.05, 0.4)),
    "edges": ((0.9, 0.05), (0.6, 0.35)),
    "shape": ((0.9, 0.05), (0.6, 0.35)),
}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), -4, 4).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("1")).when(no, F.lit("0")).otherwise(F.lit("-"))


def _known(kind: str, strict: bool, value: Column) -> Column:
    if kind == "email":
        return _vote(value.rlike(TOP_LEVEL), ~value.rlike(TOP_LEVEL))
    if kind == "ip":
        return _vote(F.lit(False), value.rlike(RESERVED))
    if kind == "card":
        return _vote(digits(value).rlike(ISSUER), ~digits(value).rlike(ISSUER))
    if strict:
        return _vote(value.rlike(COUNTRY), ~value.rlike(COUNTRY))
    return _vote(F.lit(False), ~digits(value).rlike(AREA))


def _regular(kind: str, strict: bool, value: Column) -> Column:
    """Whether the separators of a span are the ones a person would write."""
    if kind == "email":
        return value.rlike(r"^[A-Za-z0-9]") & value.rlike(r"[A-Za-z]") if strict else value.rlike(r"[\[(]\w+[\])].*(?:[\[(]\w+[\])]|\.)")
    if kind == "ip":
        return ~value.rlike(r"(?:^|\.)0[0-9]")
    if kind == "card":
        return value.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4})+(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$")
    if strict:
        return ~value.rlike(r"[\x20().-]{4,}|\.\.|--")
    return value.rlike(r"^\(|^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$")


def _features(kind: str, strict: bool, s: Column) -> Column:
    """Places of the features that a span has, ``_WIDTH`` places for each kind."""
    value = s["value"]

    def side(x: Column) -> Column:
        return F.when(x == "", 0).when(x == " ", 1).when(x.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)

    def word(text: Column, pattern: str) -> Column:
        found = F.lower(F.regexp_extract(text, pattern, 1))
        return F.when(found == "", _WORDS).otherwise(F.pmod(F.xxhash64(found), F.lit(_WORDS)).cast("int"))

    groups = [
        (2, F.lit(int(strict))),
        (8, F.least(F.floor(F.length(value) / 4).cast("int"), F.lit(7))),
        (8, F.least(F.floor(F.length(digits(value)) / 2).cast("int"), F.lit(7))),
        (4, side(F.substring(s["before"], -1, 1))),
        (4, side(F.substring(s["after"], 1, 1))),
        *((2, value.contains(c).cast("int")) for c in ("(", "-", ".", " ")),
        (11, F.coalesce(F.substring(digits(value), 1, 1).try_cast("int"), F.lit(10))),
        (_WORDS + 1, word(s["before"], r"(\p{L}+)[^\p{L}]*$")),
        (_WORDS + 1, word(s["after"], r"^[^\p{L}]*(\p{L}+)")),
    ]
    at, places = KINDS.index(kind) * _WIDTH + 1, [F.lit(KINDS.index(kind) * _WIDTH)]
    for width, value_ in groups:
        places.append(F.lit(at) + value_)
        at += width
    return F.array(*places)


#: Buckets of neighbouring words; places of one kind's features.
_WORDS = 64
_WIDTH = 1 + 2 + 8 + 8 + 4 + 4 + 4 * 2 + 11 + 2 * (_WORDS + 1)


def _candidates(text: Column, kind: str, strict: bool) -> Column:
    """array<struct<kind, start, end, base, loose, votes, features>> of one pattern."""
    found = find(text, (PATTERNS if strict else LOOSE)[kind], context=24)
    if strict and kind == "card":  # short numbers are no candidates at all
        found = F.filter(found, lambda s: F.length(digits(s["value"])) >= 12)

    def one(s: Column) -> Column:
        ok = valid(kind, s["value"]) if strict else F.lit(False)
        rule = ok if strict or kind == "email" else digits(s["value"]).rlike("^[2-9]")
        glued = s["before"].rlike(r"[\p{L}\p{N}_/=]$") | s["after"].rlike(r"^[\p{L}\p{N}_/=]")
        regular = _regular(kind, strict, s["value"])
        votes = F.concat(
            _vote(rule, ~rule) if strict or kind == "phone" else F.lit("1"),
            _known(kind, strict, s["value"]),
            _vote(s["before"].rlike(CUES[kind]) & ~s["before"].rlike(COUNTER_CUES[kind]), s["before"].rlike(COUNTER_CUES[kind])),
            _vote(~glued, glued),
            _vote(regular, ~regular),
        )
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), ok.alias("base"), F.lit(not strict).alias("loose"), votes.alias("votes"), _features(kind, strict, s).alias("features"))

    return F.transform(found, one)


def label_model(counts: dict[str, int], rounds: int = 50, weight: float = 2.0) -> dict[str, float]:
    """Posterior of a true span for each vote pattern of one kind, from the patterns' counts.

    Two classes, independent labelers.  The expected rates count as much as ``weight`` times all candidates, and ten more.
    """
    if not counts:
        return {}
    total = sum(counts.values())
    prior_n = weight * total + 10
    expected = [[(yes, no, 1 - yes - no) for yes, no in EXPECTED[name]] for name in LABELERS]  # true spans, then others
    rates, share = [[list(r) for r in e] for e in expected], 0.5
    post: dict[str, float] = {}
    for _ in range(rounds):
        for votes in counts:
            logit = math.log(share / (1 - share))
            for (true, other), v in zip(rates, votes):
                at = "10-".index(v)
                logit += math.log(true[at] / other[at])
            post[votes] = 1 / (1 + math.exp(-min(max(logit, -30), 30)))
        mass = sum(counts[v] * p for v, p in post.items())
        share = min(max((mass + 0.5 * prior_n) / (total + prior_n), 1e-3), 1 - 1e-3)
        for j, e in enumerate(expected):
            for c, of_class in ((0, mass), (1, total - mass)):
                for at, v in enumerate("10-"):
                    seen = sum(n * (post[votes] if c == 0 else 1 - post[votes]) for votes, n in counts.items() if votes[j] == v)
                    rates[j][c][at] = (seen + prior_n * e[c][at]) / (of_class + prior_n)
            true, other = rates[j]
            for at, wrong in ((0, true[0] < other[0]), (1, true[1] > other[1])):  # yes speaks for true spans, no against them
                if wrong:
                    true[at] = other[at] = (true[at] + other[at]) / 2
    return post


def span_classifier(rows: list[tuple[list[int], float]], rounds: int = 300, l2: float = 1e-3) -> list[float]:
    """Weights of the features of a logistic regression on posterior labels."""
    width = _WIDTH * len(KINDS)
    if not rows:
        return [0.0] * width
    col = np.array([f for f, _ in rows])
    y = np.array([p for _, p in rows])
    w, mean, var = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[col].sum(axis=1), -30, 30)))
        g = np.bincount(col.ravel(), weights=np.repeat((p - y) / len(y), col.shape[1]), minlength=width) + l2 / len(y) * w
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        w -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-9)
    return w.tolist()


def find_personal_data(docs: DataFrame, threshold: float = 0.8, sample: int = 2_500) -> DataFrame:
    """(doc_id, base, added) for every row of documents(doc_id, text): arrays of struct<kind, start, end, ...>."""
    texts = id_text(docs)
    t = F.col("text")
    parts = [_candidates(t, k, True) for k in KINDS] + [_candidates(t, k, False) for k in LOOSE]
    rows = stage(texts.select("doc_id", F.concat(*parts).alias("candidates")), "pii")
    spans = rows.where(F.size("candidates") > 0).select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.*")
    # at most 2 * 4 * 3^5 rows come to the driver
    counts: dict[str, dict[str, int]] = {k: {} for k in KINDS}
    of_shape: dict[tuple[str, bool], int] = {}
    for r in spans.groupBy("kind", "loose", "votes").count().collect():
        counts[r["kind"]][r["votes"]] = counts[r["kind"]].get(r["votes"], 0) + r["count"]
        of_shape[r["kind"], r["loose"]] = of_shape.get((r["kind"], r["loose"]), 0) + r["count"]
    post = {(k, v): p for k in KINDS for v, p in label_model(counts[k]).items()}
    # a share of each kind and shape by the hash of the span, so that about ``sample`` of each come to the driver
    share = F.lit(0)
    for (kind, loose), n in of_shape.items():
        share = F.when((F.col("kind") == kind) & (F.col("loose") == loose), F.lit(min(1_000_000, -(-sample * 1_000_000 // n)))).otherwise(share)
    chosen = spans.where(F.pmod(F.xxhash64("doc_id", "start", "end"), F.lit(1_000_000)) < share)
    weights = span_classifier([(r["features"], post[r["kind"], r["votes"]]) for r in chosen.orderBy("doc_id", "start", "kind").select("kind", "votes", "features").collect()])
    likely = [f"{k}{v}" for (k, v), p in post.items() if p >= 0.5 and v[0] != "0"]
    chosen_votes = F.array(*map(F.lit, likely)) if likely else F.array().cast("array<string>")
    table = F.array(*map(F.lit, weights))
    score = lambda c: F.aggregate(c["features"], F.lit(0.0), lambda a, i: a + F.get(table, i))
    least = math.log(threshold / (1 - threshold))
    rows = rows.withColumn("base", F.filter("candidates", lambda c: c["base"]))
    added = F.filter("candidates", lambda c: c["loose"] & F.array_contains(chosen_votes, F.concat(c["kind"], c["votes"])) & (score(c) >= least) & ~overlaps(c, F.col("base")))
    return rows.select("doc_id", "base", F.when(F.size("candidates") > F.size("base"), added).otherwise(F.slice("candidates", 1, 0)).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
