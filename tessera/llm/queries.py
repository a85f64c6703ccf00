"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, contamination, ctw, minhash, nndescent, pii, quality, secret_scan, toxicity, warc
from .common import new_path, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Forest(words=3, num=85, den=100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_minhash": op2_minhash,
        "op3_nndescent": op3_nndescent,
        "op4_pii": op4_pii,
        "op5_quality": op5_quality,
        "op6_contamination": op6_contamination,
        "op7_toxicity": op7_toxicity,
        "op8_secrets": op8_secrets,
        "op9_warc": op9_warc,
        "op10_ctw": op10_ctw,
    }


def _shingles_sql(table_name: str, key: str) -> str:
    """(key, s): distinct five-word shingles of each row; a key that repeats is one set here, which the given tables do not have."""
    return rf"""SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x != '') AS w FROM {table_name}) WHERE len(w) >= 5"""


CONTAMINATION_SQL = f"""WITH d AS ({_shingles_sql('documents', 'doc_id')}), q AS ({_shingles_sql('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id)
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared FROM d JOIN q USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_contamination": CONTAMINATION_SQL}
