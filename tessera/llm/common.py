"""Helpers shared by the corpus operators: shared storage, staged tables, input columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and everything runs in one process (local tests) a temporary folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN_ROOTS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Bytes of one Arrow batch while a staged table is made: rows with whole texts or sets are large.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_BATCH, None)  # None where the session has not set it
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """For plans that somebody else runs: Arrow batches of the session are bounded too, unless it has a bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


#: Bytes of input from which a task's worker hands memory back.
LEAN_BYTES = 1_000_000


def hand_back() -> None:
    """Give memory that this Python process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` for mapInArrow or an iterator of arrays: at its end the worker hands unused memory back to the system.

    Workers are kept for later tasks, and idle ones count against their executor like busy ones.  Tasks of a few rows take too
    little for that to be worth the time.
    """

    @functools.wraps(run)
    def released(batches):
        seen = 0

        def counted():
            nonlocal seen
            for batch in batches:
                seen += getattr(batch, "nbytes", LEAN_BYTES)
                yield batch

        try:
            yield from run(counted())
        finally:
            if seen >= LEAN_BYTES:
                hand_back()

    return released


def drop_stage(df: DataFrame) -> None:
    """Delete a table written by :func:`stage` that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        delete_path(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of plans that nothing refers to any more; Spark does so when the driver collects its garbage.

    The driver's own memory goes back with them: a long run of jobs else grows its heap.
    """
    hand_back()
    spark.sparkContext._jvm.System.gc()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; results that were not written yet can no longer be read."""
    delete_path(spark, f"{shared_root(spark)}/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) with null texts as empty ones; other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fraction_of_crc(col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod`` (the folds of the contracts)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def matched(rows: DataFrame, groups: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """Left join of rows with groups, which has one row for each value of ``keys`` and its number of rows in ``copies``.

    Values that more than a thousandth of all rows share are a thousand at most: they are broadcast, so that the rows of no
    value go to one task.  Null keys match nothing and stay where they are.
    """
    total = rows.count()
    hot = groups.where(F.col(copies) * 1000 > total).drop(copies)
    cold = groups.where(F.col(copies) * 1000 <= total).drop(copies)
    null = F.expr(" or ".join(f"`{k}` is null" for k in keys))
    some = rows.where(~null)
    parts = [rows.where(null), some.join(F.broadcast(hot), keys), some.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, "left")]
    columns = [*rows.columns, *(c for c in groups.columns if c not in (*keys, copies))]
    return parts[1].select(columns).unionByName(parts[2].select(columns)).unionByName(parts[0], allowMissingColumns=True)
