"""A bounded sample of labelled documents, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction_of_crc, id_text


def labelled(docs: DataFrame, labels: DataFrame, column: str, mod: int, held_out: int, sample: int) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` documents outside the held-out fold.

    Fold: crc32 of the id as text, modulo ``mod``.  Rows are taken by the hash of their id, so the
    sample does not depend on how the tables are partitioned.  A document with several labels
    has the largest; null ids and labels are left out; of rows with the same id one text is taken.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    ids = ids.where(fraction_of_crc("doc_id", mod) != held_out)
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    # a document's label may lack its document (filtered before): only ids that exist count
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return id_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def unlabelled(docs: DataFrame, labels: DataFrame, column: str, mod: int, held_out: int, sample: int) -> DataFrame:
    """(doc_id, text) of at most ``sample`` documents outside the held-out fold that have no label, taken by the hash of their id."""
    told = labels.where(F.col(column).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(fraction_of_crc("doc_id", mod) != held_out).distinct()
    ids = ids.join(told, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return id_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
