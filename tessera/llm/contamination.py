"""Benchmark items inside documents: size-partitioned MinHash containment search, native operations only.

Items are short and documents long, so their Jaccard similarity says little; what counts is the
share of an item's shingles that a document holds.  Items are partitioned by the power of two of
their shingle count.  An item's sketch holds its smallest shingle hashes (a bottom-k MinHash), and k is
set for the partition's upper size u as floor((1 - t) * u) + 1.  A document that holds a share t
or more of the item misses at most floor((1 - t) * n) of its n <= u shingles, so it holds one of the
sketch: no candidate is lost, and the search needs no bands over the whole documents, whose
number would have to grow with their length.  Candidates are verified by exact containment on all shingles.

Words are runs of letters and digits in lower case; a document or item with fewer words than a
shingle has none and takes no part.

Sketches and items are broadcast only if they have at most ``most_broadcast`` shingles; beyond that
the shingles are joined by a shuffle and candidates meet their texts again by a second one.

Defined results: null texts count as empty; one row for each pair of a distinct doc_id and a distinct item_id,
with the highest containment where ids repeat; null ids stay; very long texts are searched whole; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shingle_hashes(text: Column, size: int) -> Column:
    """array<long> of hashes of the ``size``-word shingles, by place, repeats included."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return F.when(F.size(h) >= size, each).otherwise(F.array().cast("array<bigint>"))

    # the outer transform only binds the array of words, so that a text is split once
    return F.element_at(F.transform(F.array(hashed), shingles), 1)


def item_sketches(items: DataFrame, size: int, percent: int) -> DataFrame:
    """(item_id, n, shingles, sketch) of items(item_id, text)."""
    sets = items.select("item_id", F.array_distinct(shingle_hashes(F.col("text"), size)).alias("shingles")).withColumn("n", F.size("shingles")).where("n > 0")
    upper = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")
    k = F.floor((100 - percent) * upper / 100).cast("int") + 1
    return sets.withColumn("sketch", F.slice(F.array_sort("shingles"), 1, F.least(k, F.col("n"))))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, most_broadcast: int = 1_000_000, by_text: bool = False) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) of documents that hold ``percent`` or more of an item's shingles.

    With ``by_text`` texts of one id are told apart: text_key, xxhash64 of the text (null: empty), follows doc_id.
    """
    sketches = item_sketches(items.select("item_id", "text"), size, percent)
    entries = sketches.select("item_id", F.explode("sketch").alias("hash"))
    small = sketches.select(F.explode("shingles").alias("s")).limit(most_broadcast + 1).count() <= most_broadcast
    whole = sketches.select(F.col("item_id").alias("of"), "n", "shingles")
    key = ["doc_id", "text_key"] if by_text else ["doc_id"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).select(*key, "text")
    if small:
        sets = texts.select(*key, F.array_distinct(shingle_hashes(F.col("text"), size)).alias("set"))
        pairs = sets.select(*key, "set", F.explode("set").alias("hash")).join(F.broadcast(entries), "hash").select(*key, "set", "item_id")
        pairs = pairs.join(F.broadcast(whole), F.col("item_id").eqNullSafe(F.col("of")))
    else:
        single = texts.select(*key, F.explode(F.array_distinct(shingle_hashes(F.col("text"), size))).alias("hash"))
        found = single.join(entries, "hash").select(*(F.col(c).alias(f"in_{c}") for c in key), "item_id").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("in_doc_id"))
        back = texts.join(found, same & (F.col("text_key") == F.col("in_text_key")) if by_text else same)
        pairs = back.join(whole, F.col("item_id").eqNullSafe(F.col("of"))).withColumn("set", F.array_distinct(shingle_hashes(F.col("text"), size)))
    shared = F.size(F.array_intersect("set", "shingles")).cast("long")
    checked = pairs.select(*key, "item_id", F.col("n").cast("long").alias("n_item"), shared.alias("n_shared"))
    checked = checked.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = checked.groupBy(*key, "item_id").agg(F.max_by(F.struct("n_item", "n_shared"), F.struct(F.col("n_shared") / F.col("n_item"), "n_shared")).alias("best"))
    return best.select(*key, "item_id", "best.n_item", "best.n_shared")
