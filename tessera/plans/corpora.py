"""The provided tables seen as a corpus: paths, projects, times, chunks, questions and labels."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import windows

SIZE, STEP = 1600, 1420


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, below_root, project, root_label, file_type, mtime, byte_count, content_hash, lang, text)."""
    i = F.col("doc_id")
    ext = F.when(i % 3 == 0, ".md").when(i % 3 == 1, ".txt").otherwise(".markdown")
    below = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.lpad(i.cast("string"), 9, "0"), ext)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/corpus/"), below).alias("path"),
        below.alias("below_root"),
        F.concat(F.lit("corpus/"), "source").alias("project"),
        F.lit("corpus").alias("root_label"),
        ext.alias("file_type"),
        (1_700_000_000 + (i * 7919) % 1_000_003).cast("double").alias("mtime"),
        F.octet_length("text").cast("long").alias("byte_count"),
        F.sha2("text", 256).alias("content_hash"),
        "lang",
        "text",
    )


SOURCES_SQL = """sources AS (
  SELECT doc_id, '/corpus/' || below_root AS path, below_root, 'corpus/' || source AS project, 'corpus' AS root_label, ext AS file_type,
         (1700000000 + (doc_id * 7919) % 1000003)::DOUBLE AS mtime, strlen(text)::BIGINT AS byte_count, sha256(text) AS content_hash, lang, text
  FROM (SELECT *, source || '/' || lang || '/doc-' || lpad(doc_id::VARCHAR, 9, '0') || ext AS below_root
        FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '.markdown' END AS ext FROM documents)))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources cut into windows: (path, ordinal, text, project, root_label, mtime)."""
    made = F.posexplode(windows(F.col("text"), F.lit(SIZE), F.lit(STEP))).alias("ordinal", "piece")
    return sources(spark, sf_dir).select("path", "project", "root_label", "mtime", made).withColumnRenamed("piece", "text")


CHUNKS_SQL = (
    SOURCES_SQL
    + r""", chunks AS (
  SELECT path, project, root_label, mtime, (row_number() OVER (PARTITION BY path ORDER BY s) - 1)::INTEGER AS ordinal, piece AS text
  FROM (SELECT *, regexp_replace(substr(text, s::INT + 1, 1600), '^\s+|\s+$', '', 'g') AS piece
        FROM (SELECT *, unnest(range(0, length(text), 1420)) AS s FROM sources)) WHERE piece != '')"""
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, path, grade): 2 where a document holds the question's text, 1 where it holds its first forty characters only.

    A text that holds those forty characters holds the whole words among them: a question is compared only with the texts that have its first
    pair of words that is not at an end, and one without such a pair with every text.  Texts are read once and do not shuffle; the questions,
    a stated set, go along with the task.
    """
    asked = [(i, r["query_id"], r["question"]) for i, r in enumerate(questions(spark, sf_dir).where("question is not null").collect())]
    by_pair: dict[tuple[str, str], list[int]] = {}
    for i, _, text in asked:
        start = text[:40].split(" ")
        by_pair.setdefault((start[1], start[2]) if len(start) >= 4 else (), []).append(i)

    def run(batches):
        for batch in batches:
            found = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None:
                    continue
                words = text.split(" ")
                met = by_pair.keys() & {(), *zip(words, words[1:], strict=False)}
                for _, query, question in (asked[i] for pair in met for i in by_pair[pair]):
                    if question[:40] in text:
                        found.append({"query_id": query, "path": path, "grade": 2 if question in text else 1})
            yield pa.RecordBatch.from_pylist(found, schema)

    schema = pa.schema([("query_id", pa.int64()), ("path", pa.string()), ("grade", pa.int64())])
    made = sources(spark, sf_dir).select("path", "text").mapInArrow(run, "query_id long, path string, grade long")
    return made.withColumn("query_id", F.col("query_id").cast(questions(spark, sf_dir).schema["query_id"].dataType))


QRELS_SQL = """qrels AS (SELECT query_id, path, grade::BIGINT AS grade FROM (
  SELECT query_id, path, CASE WHEN contains(text, question) THEN 2 WHEN contains(text, substr(question, 1, 40)) THEN 1 END AS grade
  FROM sources CROSS JOIN questions) WHERE grade IS NOT NULL)"""
