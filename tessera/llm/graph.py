"""Connected components as DataFrame iterations; nothing of the graph reaches the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, lean, stage

#: Edges that one task contracts at most; a graph of more is contracted by as many tasks as it needs.
EDGES_PER_TASK = 250_000


def _contract(edges: DataFrame, n: int, own: bool = False) -> DataFrame:
    """(u, v): each task replaces its edges by stars, every node linked with the smallest one it reaches inside the task; own: that node with itself too."""
    fields = edges.schema["u"].dataType

    def run(batches):
        parent = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out = [(x, root(x)) for x in parent]
        out = [(x, r) for x, r in out if own or x != r]
        for at in range(0, len(out), 50_000):
            u, v = zip(*out[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])

    return edges.repartition(max(1, -(-n // EDGES_PER_TASK))).mapInArrow(lean(run), f"u {fields.simpleString()}, v {fields.simpleString()}")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of the graph of ``edges`` (a, b): the smallest node reachable, for every node that has an edge.

    Tasks contract bounded shares of the edges, repeated ones too, to stars.  Unless one share was enough, large-star and
    small-star steps follow between rounds: both take a minimum that is computed before the shuffle and link
    neighbours to it, so a hub costs as many rows as it has edges.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), label)
    while True:
        n = e.count()
        if n <= EDGES_PER_TASK:
            new = stage(_contract(e, n, own=True), label)
            drop_stage(e)
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        local = stage(_contract(e, n), label)
        both = local.unionAll(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        # large-star: larger neighbours (and the node itself) go to the smallest neighbour
        large = both.join(low, both.u == low.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(low.select(F.col("n").alias("u"), F.col("m").alias("v")).where("u != v")).distinct()
        # small-star: smaller neighbours and the node itself go to the smallest neighbour
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(low2, large.u == low2.n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionAll(low2.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        new = stage(small, label)
        # stars: every node has one edge and no root has one
        one = new.groupBy("u").count().where("count > 1").limit(1).count() == 0
        stars = one and new.select("v").join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0
        drop_stage(e)
        drop_stage(local)
        e = new
        if stars:
            break
    return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def contract(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after the roots themselves were given roots by ``more`` (node, root)."""
    m = more.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return roots.join(m, "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
