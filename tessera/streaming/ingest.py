"""Postings of new documents as a stream: every micro-batch appends its own, once.

A stream sees additions only; edits and deletions belong to the batch refresh, which stays authoritative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import postings


def ingest(documents: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start writing postings of a stream of (path, ordinal, text) below ``target``.

    Each batch is a folder of its own that a repeated batch overwrites, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_postings(spark, target: str) -> DataFrame:
    return spark.read.parquet(target).select("path", "ordinal", "term", F.col("tf"))
