"""Whether hits and the index still match their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .refresh import under_any

MARKERS = {"strong": "OK", "rebuilt": "NEW", "weak": "DRIFT", "stale": "GONE"}


def verdicts(hits: DataFrame, disk: DataFrame, refreshed_at: float, window: float = 1.0) -> DataFrame:
    """Adds verdict, reason and marker to hits(path, content_hash, indexed_at), from disk(path, content_hash)."""
    now = disk.select("path", F.lit(True).alias("__here"), F.col("content_hash").alias("__hash"))
    rows = hits.join(now, "path", "left")
    gone, other = F.col("__here").isNull(), ~F.col("content_hash").eqNullSafe(F.col("__hash"))
    fresh = F.abs(F.col("indexed_at") - refreshed_at) < window
    verdict = F.when(gone, "stale").when(other, "weak").when(fresh, "rebuilt").otherwise("strong")
    reason = F.when(gone, "its source is gone").when(other, "its source was changed after indexing").when(fresh, "indexed by the last refresh").otherwise("its source is as indexed")
    marker = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])
    return rows.withColumns({"verdict": verdict, "reason": reason}).withColumn("marker", F.coalesce(F.try_element_at(marker, F.col("verdict")), F.lit("?"))).drop("__here", "__hash")


def drift(index: DataFrame, disk: DataFrame, roots: list[str], uid: int, deep: bool = True) -> DataFrame:
    """(path, kind) findings of an audit.

    index(path, content_hash, byte_count, mtime); disk(path, content_hash, byte_count, mtime, uid, walked, refused).
    A ghost has no other finding; the others can meet on one file.  ``walked`` marks files that a refresh would take.
    """
    i = index.select("path", F.lit(True).alias("i"), F.col("content_hash").alias("ih"), F.col("byte_count").alias("ib"), F.col("mtime").alias("im"))
    d = disk.select("path", F.lit(True).alias("d"), F.col("content_hash").alias("dh"), F.col("byte_count").alias("db"), F.col("mtime").alias("dm"), "uid", "walked", "refused")
    rows = i.join(d, "path", "full_outer")
    both = F.col("i").isNotNull() & F.col("d").isNotNull()
    unreadable = both & F.col("dh").isNull() & F.lit(deep)
    changed = (F.col("ih") != F.col("dh")) if deep else (F.col("ib") != F.col("db")) | (F.abs(F.col("im") - F.col("dm")) >= 1e-6)
    kinds = F.array(
        F.when(F.col("i").isNotNull() & F.col("d").isNull() | unreadable, "ghost"),
        F.when(both & (F.col("uid") != uid), "ownership"),
        F.when(both & ~under_any(F.col("path"), roots), "orphan"),
        F.when(both & changed, "hash_drift" if deep else "changed"),
        F.when(F.col("i").isNull() & F.col("walked") & ~F.col("refused"), "unindexed"),
    )
    return rows.select("path", F.explode(F.array_compact(kinds)).alias("kind"))


def exit_code(findings: DataFrame) -> int:
    """0 without findings, 1 with any."""
    return 0 if findings.isEmpty() else 1


def first_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` paths of each kind with the kind's total, as a report shows them."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("kind")
    return findings.withColumns({"no": F.row_number().over(w.orderBy("path")), "total": F.count(F.lit(1)).over(w)}).where(F.col("no") <= n)
