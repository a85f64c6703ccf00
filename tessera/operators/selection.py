"""Selection under quotas: newest files of a root, or a balanced round over its projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded
from .gates import path_parts


def _up_to(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """Adds ``__in``: whether a row is among the first ``most`` of its root in ``order``, a struct that no two rows of a root share.

    The last of the first rows is found by a bounded search and every row is compared with it; roots are as many as the configuration names.
    """
    first = rows.select("root_label", order.alias("order")).withColumn("no", F.row_number().over(Window.partitionBy("root_label").orderBy("order"))).where(F.col("no") <= most)
    ends = first.groupBy("root_label").agg(F.max("order").alias("__end"))
    return rows.join(F.broadcast(ends), "root_label", "left").withColumn("__in", F.coalesce(order <= F.col("__end"), F.lit(False))).drop("__end")


def newest(sources: DataFrame, max_files: int) -> DataFrame:
    """Adds ``selected``: the newest ``max_files`` of each root (0: all), ties by path."""
    if not max_files:
        return sources.withColumn("selected", F.lit(True))
    return _up_to(sources, F.struct((-F.col("mtime")).alias("age"), "path"), max_files).withColumnRenamed("__in", "selected").select(*sources.columns, "selected")


def flags(below_root: Column) -> tuple[Column, Column]:
    """Whether a file locates others (a readme, agents, state or hand-off file near the root), and whether it is a doc or spec near it."""
    parts = path_parts(below_root)
    name, depth = folded(F.element_at(parts, -1)), F.size(parts)
    locator = (depth <= 2) & (name.isin("readme.md", "agents.md", "state.md") | F.contains(name, F.lit("handoff")) | F.contains(name, F.lit("next-push")))
    shallow = (depth <= 3) & (depth > 1) & F.coalesce(F.get(parts, depth - 2).isin("docs", "specs"), F.lit(False))
    return locator, shallow


def balanced(sources: DataFrame, max_files: int, per_project: int = 200) -> DataFrame:
    """Adds ``selected``: each project's best ``per_project`` files, dealt in rounds over the projects by name up to ``max_files`` a root.

    Locators come first (readme, agents, state, hand-offs near the root), then shallow docs, then the newest.
    A round-robin is the order by (place in the project, project).
    """
    locator, shallow = flags(F.col("below_root"))
    in_project = Window.partitionBy("root_label", "project").orderBy(~locator, ~shallow, F.desc("mtime"), "path")
    ranked = sources.withColumn("__place", F.row_number().over(in_project))
    fits = F.col("__place") <= per_project
    if not max_files:
        return ranked.withColumn("selected", fits).select(*sources.columns, "selected")
    # only rows inside their project's quota take part in the rounds
    order = F.struct("__place", "project")
    inside = _up_to(ranked.where(fits), order, max_files).withColumnRenamed("__in", "selected")
    return inside.unionByName(ranked.where(~fits).withColumn("selected", F.lit(False))).select(*sources.columns, "selected")


def over_budget(sources: DataFrame, max_files: int) -> DataFrame:
    """(root_label, files, max_files) of roots that hold more than ``max_files``."""
    return sources.groupBy("root_label").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") > max_files).withColumn("max_files", F.lit(max_files).cast("long"))


def first_owner(candidates: list[DataFrame]) -> DataFrame:
    """One owner for each resolved path: the first root, in order, that selects it."""
    out = candidates[0].where("selected")
    for more in candidates[1:]:
        out = out.unionByName(more.where("selected").join(out.select("path"), "path", "left_anti"))
    return out
