"""Regex matches with their places, as columns: no Python runs on the executors.

``split`` gives the text between the matches and ``regexp_extract_all`` the matches; their lengths
in code points, added up, give every start and end.  Patterns must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches are gathered in blocks of this size, so that a text with very many stays linear.
_BLOCK = 64
_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def find(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<start, end, value, before, after>> of the leftmost non-overlapping matches of a Java regex.

    Places are code points, the end is exclusive; before and after hold up to ``context`` characters
    that lie between this match and its neighbours.
    """
    p = F.lit(pattern)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("full"), F.array().cast(f"array<{_SPAN}>").alias("last"))
    pairs = F.arrays_zip(gaps.alias("gap"), F.concat(hits, F.array(F.lit(None).cast("string"))).alias("value"), F.concat(F.slice(gaps, 2, F.size(gaps)), F.array(F.lit(None).cast("string"))).alias("next"))

    def tail(x: Column) -> Column:
        return F.substring(x, -context, context) if context else F.lit("")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), tail(x["gap"]).alias("before"), (F.substring(x["next"], 1, context) if context else F.lit("")).alias("after"))
        more = F.concat(acc["last"], F.array(span.cast(_SPAN)))
        whole = F.size(acc["last"]) >= _BLOCK - 1
        return F.when(x["value"].isNull(), acc).otherwise(
            F.struct(
                end.alias("at"),
                F.when(whole, F.concat(acc["full"], F.array(more))).otherwise(acc["full"]).alias("full"),
                F.when(whole, F.array().cast(f"array<{_SPAN}>")).otherwise(more).alias("last"),
            )
        )

    found = F.aggregate(pairs, empty, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["last"]))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, then end, comma-joined; spans hold kind, start and end."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("no"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(s: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
