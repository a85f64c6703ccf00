"""Secrets in texts by corpus-wide ownership frequency, as DataFrame operations only.

Candidates are the matches of three base patterns and of further token shapes.  The hash of every
candidate's value is aggregated over the whole corpus to the numbers of distinct repositories
and owners that hold it.  A value that more than ``most_owners`` owners hold, or more than ``most_repositories`` repositories whoever owns them, is a
copied example; one that stays with few of both looks live.  Base spans stay either way and carry the verdict; further candidates are added
only when they look live and, for long words, mix characters.

Only texts with candidates are shuffled, by row; values that hold over a thousandth of all candidates are broadcast with their verdict.

Defined results: null texts count as empty; a null source is an owner of its own; very long texts are searched whole; one row per
input row, repeated ids included; an empty corpus has an empty result; further columns are kept apart, and columns to keep may have any
name but those beginning with ``__secret``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matched, stage
from .spans import count_kind, find, joined, overlaps

KINDS = ["assign", "access", "hex"]

# The base patterns.  The minimum lengths of access and hex are part of the pattern
# because their matches are whole runs, so a shorter run cannot hide a longer match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}+", "hex": r"[0-9a-f]{32,}+"}
#: Further shapes: issued tokens with a prefix, signed web tokens, and long words of mixed characters.
FURTHER = {
    "prefixed": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+|glpat-[A-Za-z0-9_-]{16,}+)",
    "signed": r"\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{6,}+",
    "mixed": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{28,}+={0,2}",
}


def _hashed(found: Column, kind: str, base: bool, value) -> Column:
    def one(s: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), F.sha2(value(s), 256).alias("hash"))

    return F.transform(found, one)


def _candidates(text: Column) -> Column:
    def whole(s: Column) -> Column:
        return s["value"]

    def assigned(s: Column) -> Column:
        return F.regexp_extract(s["value"], ASSIGN, 2)

    def mixed(s: Column) -> Column:
        return s["value"].rlike("[0-9].*[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]")

    out = [_hashed(F.filter(find(text, ASSIGN), lambda s: F.length(assigned(s)) >= 8), "assign", True, assigned)]
    out += [_hashed(find(text, PATTERNS[k]), k, True, whole) for k in ("access", "hex")]
    for kind, pattern in FURTHER.items():
        found = find(text, pattern)
        out.append(_hashed(F.filter(found, mixed) if kind == "mixed" else found, kind, False, whole))
    return F.concat(*out)


def verdicts(spans: DataFrame, most_owners: int, most_repositories: int) -> DataFrame:
    """(hash, n, owners, repositories, copied) of every value of spans(hash, repo, owner); n counts its spans."""
    by_owner = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    of_value = by_owner.groupBy("hash").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    return of_value.withColumn("copied", (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories))


def scan(docs: DataFrame, repository: list[str] | None = None, owner: str = "source", most_owners: int = 2, most_repositories: int = 6, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, spans) for every row; spans is array<struct<kind, start, end, base, live>>.

    ``repository`` names the columns that together with the owner name a repository (default: source and lang).
    """
    repository = repository or ["source", "lang"]
    keep = keep or []
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *keep,
        F.concat_ws("\u0001", *map(name, repository)).alias("__secret_repo"),
        name(owner).alias("__secret_owner"),
        _candidates(F.coalesce("text", F.lit(""))).alias("__secret_found"),
        F.monotonically_increasing_id().alias("__secret_row"),
    )
    # written once: a row's number then stays the same whatever fails later
    found = stage(found, "secrets")
    spans = found.where(F.size("__secret_found") > 0).select(F.col("__secret_row").alias("row"), F.col("__secret_repo").alias("repo"), F.col("__secret_owner").alias("owner"), F.explode("__secret_found").alias("s")).select("row", "repo", "owner", "s", "s.hash")
    values = verdicts(spans, most_owners, most_repositories).select("hash", "n", "copied")
    judged = matched(spans.select("row", "s", "hash"), values, ["hash"], "n")
    by_row = judged.select("row", F.struct("s.kind", "s.start", "s.end", "s.base", (~F.col("copied")).alias("live")).alias("s")).groupBy(F.col("row").alias("__secret_of")).agg(F.array_sort(F.collect_list("s")).alias("__secret_all"))
    some = found.where(F.size("__secret_found") > 0).join(by_row, F.col("__secret_row") == F.col("__secret_of"))
    some = some.withColumn("__secret_base", F.filter("__secret_all", lambda s: s["base"])).withColumn("__secret_named", F.filter("__secret_all", lambda s: s["kind"] != "mixed"))
    added = F.filter("__secret_all", lambda s: ~s["base"] & s["live"] & ~overlaps(s, F.col("__secret_base")) & ((s["kind"] != "mixed") | ~overlaps(s, F.col("__secret_named"))))
    none = found.where(F.size("__secret_found") == 0)
    spans_type = some.select(F.concat("__secret_base", added).alias("spans")).schema["spans"].dataType
    return some.select("doc_id", *keep, F.concat("__secret_base", added).alias("spans")).unionByName(none.select("doc_id", *keep, F.array().cast(spans_type).alias("spans")))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by the name of its kind and verdict."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["live"].alias("live"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(F.lit("["), F.when(s["live"], F.lit("secret:")).otherwise(F.lit("example:")), s["kind"], F.lit("]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), mark)).otherwise(acc["out"]).alias("out"),
        )

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(order, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(count_kind(base, k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), [*KINDS, *FURTHER]).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
