"""Retrieval metrics, intervals and checks of labelled queries."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ["recall_1", "recall_5", "recall_10", "mrr_10", "ndcg_10"]


def per_query(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, METRICS) for every labelled query; ranked(query_id, rank, path), qrels(query_id, path, grade)."""
    hits = qrels.join(ranked.where(F.col("rank") <= k), ["query_id", "path"], "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "path"))
    hits = hits.withColumn("__ideal", place)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    relevant = F.when(F.col("grade") >= 1, F.col("rank"))
    made = hits.groupBy("query_id").agg(
        F.min(relevant).alias("first"),
        F.coalesce(F.sum(gain / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(F.col("__ideal") <= k, gain / F.log2(F.col("__ideal") + 1))), F.lit(0.0)).alias("ideal"),
    )
    at = lambda n: F.when(F.col("first") <= n, 1.0).otherwise(0.0)
    return made.select("query_id", at(1).alias("recall_1"), at(5).alias("recall_5"), at(10).alias("recall_10"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr_10"), F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg_10"))


def means(metrics: DataFrame, category: str | None = None) -> DataFrame:
    """Means of all queries, and of each category under its name; ``category`` is 'overall' for the first."""
    out = [F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS)]
    if category is None:
        return metrics.agg(*out)
    # expands once and aggregates both levels in one shuffle
    both = metrics.withColumn("category", F.explode(F.array(F.lit("overall"), F.col(category))))
    return both.groupBy("category").agg(*out)


def _draws(spark, n: int, samples: int, seed: int) -> DataFrame:
    """(sample, pos): the resampled places, drawn by the driver; samples times n rows."""
    rng = random.Random(seed)
    rows = [(s, rng.randrange(n)) for s in range(samples) for _ in range(n)]
    return spark.createDataFrame(rows, "sample int, pos int")


def bootstrap(metrics: DataFrame, samples: int = 1000, seed: int = 20261003, confidence: float = 0.95) -> DataFrame:
    """(metric, low, high): percentile bootstrap over queries; all metrics share the draws."""
    return _interval(metrics.select("query_id", *METRICS), METRICS, samples, seed, lambda n: (max(0, math.ceil((1 - confidence) / 2 * n) - 1), min(n - 1, math.floor((1 - (1 - confidence) / 2) * n))))


def paired_delta(a: DataFrame, b: DataFrame, metric: str, samples: int = 1000, seed: int = 20261003) -> DataFrame:
    """One row: mean of a less b over shared queries, its interval, wins, losses, ties."""
    deltas = a.select("query_id", F.col(metric).alias("a")).join(b.select("query_id", F.col(metric).alias("b")), "query_id").select("query_id", (F.col("a") - F.col("b")).alias(metric))
    point = deltas.agg(F.round(F.avg(metric), 4).alias("mean_delta"), F.count_if(F.col(metric) > 0).alias("a_wins"), F.count_if(F.col(metric) < 0).alias("b_wins"), F.count_if(F.col(metric) == 0).alias("ties"), F.count(F.lit(1)).alias("n"))
    return point.crossJoin(_interval(deltas, [metric], samples, seed, lambda n: (int(0.025 * n), min(n - 1, int(0.975 * n)))))


def _interval(metrics: DataFrame, names: list[str], samples: int, seed: int, places) -> DataFrame:
    # one number for each query, in order of the ids; queries are a labelled set, held by one task
    w = Window.orderBy("query_id")
    numbered = metrics.withColumn("pos", F.row_number().over(w) - 1)
    n = numbered.count()
    if not n:
        return metrics.sparkSession.createDataFrame([(m, 0.0, 0.0) for m in names], "metric string, low double, high double")
    drawn = _draws(metrics.sparkSession, n, samples, seed).join(numbered, "pos").groupBy("sample").agg(*(F.avg(m).alias(m) for m in names))
    low, high = places(samples)
    picked = [F.struct(F.lit(m).alias("metric"), F.element_at(F.array_sort(F.collect_list(m)), low + 1).alias("low"), F.element_at(F.array_sort(F.collect_list(m)), high + 1).alias("high")) for m in names]
    return drawn.agg(F.array(*picked).alias("x")).select(F.explode("x").alias("x")).select("x.metric", F.round("x.low", 4).alias("low"), F.round("x.high", 4).alias("high"))


def latency(rows: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Nearest-rank p50 and p95, and mean."""
    aggregates = [F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), 2).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))]
    aggregates.append(F.round(F.avg(value), 2).alias("mean"))
    return rows.groupBy(by).agg(*aggregates) if by else rows.agg(*aggregates)


def query_problems(queries: DataFrame, qrels: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, problem) of labelled queries; queries(query_id, category), qrels(query_id, path, grade), files(path)."""
    twice = queries.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("duplicate id").alias("problem"))
    bare = queries.join(qrels, "query_id", "left_anti").select("query_id", F.lit("no labels").alias("problem"))
    loose = queries.where(F.coalesce("category", F.lit("")) == "").select("query_id", F.lit("missing category").alias("problem"))
    lost = qrels.join(files, "path", "left_anti").select("query_id", F.concat(F.lit("unknown path: "), "path").alias("problem"))
    odd = qrels.where(~F.col("grade").isin(1, 2)).select("query_id", F.concat(F.lit("grade not 1 or 2: "), "path").alias("problem"))
    return twice.unionByName(bare).unionByName(loose).unionByName(lost).unionByName(odd)


def manifest_problems(entries: DataFrame, files: DataFrame, tags: list[str]) -> DataFrame:
    """(path, problem) of entries(path, project, mtime, planted, overridden_by) against files(path)."""
    say = lambda rows, text: rows.select("path", F.lit(text).alias("problem"))
    missing = say(entries.join(files, "path", "left_anti"), "missing file")
    unlisted = say(files.join(entries, "path", "left_anti"), "unmanifested corpus file")
    twice = say(entries.groupBy("path").count().where("count > 1"), "listed twice")
    bare = say(entries.where(F.col("project").isNull() | (F.col("project") == "")), "missing field 'project'")
    undated = say(entries.where(F.col("mtime").isNull()), "missing field 'mtime'")
    tagged = say(entries.where(F.size(F.array_except("planted", F.array(*map(F.lit, tags)))) > 0), "unknown tags")
    newer = entries.select(F.col("path").alias("overridden_by"), F.col("mtime").alias("__newer")).distinct()
    over = entries.where("overridden_by is not null").join(newer, "overridden_by", "left")
    lost = say(over.where("__newer is null"), "override missing from manifest")
    late = say(over.where(F.col("mtime") >= F.col("__newer")), "not older than its override")
    out = missing
    for x in (unlisted, twice, bare, undated, tagged, lost, late):
        out = out.unionByName(x)
    return out


def paired_counts(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """One row: mean of a less b over shared queries, wins, losses, ties and their number."""
    d = a.select("query_id", F.col(metric).alias("a")).join(b.select("query_id", F.col(metric).alias("b")), "query_id").select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.round(F.avg("d"), 4).alias("mean_delta"), F.count_if(F.col("d") > 0).alias("a_wins"), F.count_if(F.col("d") < 0).alias("b_wins"), F.count_if(F.col("d") == 0).alias("ties"), F.count(F.lit(1)).alias("n"))


def cell_means(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(policy_id, n_queries, METRICS) of ranked(policy_id, query_id, rank, path), over all labelled queries."""
    cells = ranked.select("policy_id").distinct()
    # every cell answers for every label, so a query without hits counts as zero
    labels = qrels.crossJoin(F.broadcast(cells)).select(F.struct("policy_id", "query_id").alias("query_id"), "path", "grade")
    got = per_query(ranked.select(F.struct("policy_id", "query_id").alias("query_id"), "rank", "path"), labels)
    return got.groupBy("query_id.policy_id").agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def best_cell(means: DataFrame) -> DataFrame:
    """The one row with the best mrr_10, then recall_5, then the first policy_id."""
    return means.orderBy(F.desc("mrr_10"), F.desc("recall_5"), "policy_id").limit(1)
