"""A training-corpus pipeline: five stages, each on all that its predecessor kept.

toxicity            documents that the classifier rejects go
near_duplicates     one document of each near-duplicate group stays (five-word shingles, similarity 0.8)
decontamination     documents that hold a benchmark item go
secrets             secrets in the texts are replaced by a mark
bpe                 the texts as token ids: doc_id, n_tokens, ids_sha256, decoded_sha256

Null texts pass every filter as empty ones and rows with a null id pass the first; of rows equal in id and text one stays
after near_duplicates.  Empty tables give empty results.  All stages but the last return the
columns of documents, also where documents has more of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, contamination, minhash, secret_scan, toxicity
from tessera.llm.common import drop_shuffles, drop_stage, small_batches, stage, table


def _hidden(docs: DataFrame, visible: list[str]) -> tuple[DataFrame, list[str], list]:
    """documents with all but the visible columns under names that clash with nothing; those names; and the way back."""
    names = {c: c if c in visible else f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(c).alias(n) for c, n in names.items())), [n for n in names.values() if n.startswith("__c")], [F.col(n).alias(c) for c, n in names.items()]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    hidden, others, back = _hidden(docs, ["doc_id", "text"])
    return toxicity.score(hidden, model, keep=["text", *others]).where("predicted = 0").select(*back)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs, minhash.Forest(words=5, num=80, den=100))
    kept = found.where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.count(F.lit(1)).alias("__rows"))
    kept = stage(kept, "kept")
    for used in found._tessera_reads:
        drop_stage(used)
    drop_shuffles(spark)
    # texts shuffle once: repeated rows are known by their counts
    keyed = docs.withColumns({"__own_id": F.col("doc_id").cast("long"), "__own_key": F.xxhash64(F.coalesce("text", F.lit("")))})
    chosen = keyed.join(kept, F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__key")))
    return chosen.where("__rows = 1").unionByName(chosen.where("__rows > 1").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = contamination.contaminated(docs, table(spark, sf_dir, "benchmark"), by_text=True).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden, others, back = _hidden(docs, ["doc_id", "text", "lang", "source", "n_chars"])
    kept = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]
    found = secret_scan.scan(hidden, keep=[*kept, *others])
    marked = found.withColumn("text", secret_scan.redact(F.col("text"), F.col("spans")))
    if "n_chars" in kept:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        marked = marked.withColumn("n_chars", F.when(F.size("spans") > 0, length).otherwise(F.col("n_chars")))
    return marked.select(*back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: A trained classifier, hashes and token ids cannot be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        kept = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        drop_stage(docs)
        drop_shuffles(spark)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
