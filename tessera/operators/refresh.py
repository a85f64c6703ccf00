"""Incremental maintenance: what changed between the index and the disk, and the next version of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SAME = 1e-6


def under_any(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def diff(known: DataFrame, seen: DataFrame, missing_roots: list[str] | None = None, missing_labels: list[str] | None = None, rechunk: bool = False) -> DataFrame:
    """(path, status, relabelled) from known and seen sources(path, content_hash, byte_count, mtime, project, root_label).

    added, reindexed, touched (same hash, other time), unchanged, removed, or orphan_kept where the root is missing.
    One full outer join gives all of them.
    """
    cols = ["content_hash", "byte_count", "mtime", "project", "root_label"]
    k = known.select("path", F.lit(True).alias("k_here"), *(F.col(c).alias(f"k_{c}") for c in cols))
    s = seen.select("path", F.lit(True).alias("s_here"), *(F.col(c).alias(f"s_{c}") for c in cols))
    same = (F.col("k_byte_count") == F.col("s_byte_count")) & (F.abs(F.col("k_mtime") - F.col("s_mtime")) < _SAME) & F.lit(not rechunk)
    kept = F.coalesce(F.col("k_root_label").isin(missing_labels or []), F.lit(False)) | under_any(F.col("path"), missing_roots or [])
    status = (
        F.when(F.col("k_here").isNull(), "added")
        .when(F.col("s_here").isNull(), F.when(kept, "orphan_kept").otherwise("removed"))
        .when(same, "unchanged")
        .when((F.col("k_content_hash") == F.col("s_content_hash")) & F.lit(not rechunk), "touched")
        .otherwise("reindexed")
    )
    moved = ~F.col("k_project").eqNullSafe(F.col("s_project")) | ~F.col("k_root_label").eqNullSafe(F.col("s_root_label"))
    out = k.join(s, "path", "full_outer").withColumn("status", status)
    return out.select("path", "status", (F.col("status").isin("unchanged", "touched") & moved).alias("relabelled"))


STATUSES = ["added", "reindexed", "touched", "unchanged", "removed", "orphan_kept", "relabelled"]


def counters(changes: DataFrame) -> DataFrame:
    """(status, files) with every status, zero included; relabelled counts unchanged files only."""
    names = F.array(*map(F.lit, STATUSES))
    is_it = (F.col("s") == F.col("status")) | ((F.col("s") == "relabelled") & F.col("relabelled") & (F.col("status") == "unchanged"))
    spread = changes.select("status", "relabelled", F.explode(names).alias("s"))
    counted = spread.groupBy("s").agg(F.count_if(is_it).alias("files"))
    every = changes.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(counted.withColumnRenamed("s", "status"), "status", "left").na.fill(0, ["files"])


def next_sources(known: DataFrame, seen: DataFrame, changes: DataFrame) -> DataFrame:
    """The sources table after a refresh: seen rows, and the known ones that are kept."""
    gone = changes.where(F.col("status") == "orphan_kept").select("path")
    return seen.unionByName(known.join(gone, "path", "left_semi"), allowMissingColumns=True)


def next_chunks(chunks: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The chunks table after a refresh: new ones of added and reindexed files, old ones of the rest."""
    out = changes.where(F.col("status").isin("added", "reindexed", "removed")).select("path")
    return chunks.join(out, "path", "left_anti").unionByName(fresh)


def missing_vectors(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(text_hash, text) of distinct texts that the cache has no vector for."""
    have = cache.where(F.col("model") == model).select("text_hash")
    return chunks.select("text_hash", "text").dropDuplicates(["text_hash"]).join(have, "text_hash", "left_anti")


def next_postings(old: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The postings after a refresh, as next_chunks."""
    return next_chunks(old, fresh, changes)


def store_vectors(cache: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """The cache with new(text_hash, model, embedding); where an entry exists only its time changes."""
    kept = use_vectors(cache, new, now)
    fresh = new.join(cache.select("text_hash", "model"), ["text_hash", "model"], "left_anti").withColumn("last_used", F.lit(now))
    return kept.unionByName(fresh.select(*kept.columns))


def use_vectors(cache: DataFrame, used: DataFrame, now: float) -> DataFrame:
    """The cache with a new time for the entries that used(text_hash, model) names."""
    marked = cache.join(used.select("text_hash", "model", F.lit(True).alias("__used")).distinct(), ["text_hash", "model"], "left")
    return marked.withColumn("last_used", F.when(F.col("__used"), F.lit(now)).otherwise(F.col("last_used"))).drop("__used")


def prune_vectors(cache: DataFrame, now: float, days: float = 14, held: DataFrame | None = None) -> DataFrame:
    """The cache without entries that nobody used for ``days``; those that held(text_hash) names stay."""
    recent = F.col("last_used") >= now - days * 86_400
    if held is None:
        return cache.where(recent)
    marked = cache.join(held.select("text_hash", F.lit(True).alias("__held")).distinct(), "text_hash", "left")
    return marked.where(recent | F.col("__held")).select(*cache.columns)


def manifest_digest(sources: DataFrame, groups: int = 256) -> DataFrame:
    """One row (digest): sha256 over the rows' hashes in path order, first inside ``groups`` of paths, then over the groups.

    Two levels keep any one array to a share of the rows, and the last one to ``groups`` entries.
    """
    row = F.sha2(F.concat_ws("\n", "path", "content_hash", F.col("byte_count").cast("string"), F.round(F.col("mtime") * 1e6).cast("long").cast("string"), "project", "root_label"), 256)
    by = sources.select(F.substring(F.sha2("path", 256), 1, 2 if groups == 256 else 1).alias("g"), "path", row.alias("h"))
    inner = by.groupBy("g").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    return inner.agg(F.sha2(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "\n"), F.lit("")), 256).alias("digest"))
