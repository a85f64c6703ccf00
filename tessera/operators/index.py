"""Postings, corpus statistics and embeddings of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, words

KEYS = ["path", "ordinal"]
DIMENSIONS = 64


def postings(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(path, ordinal, term, tf, dl) of chunks(path, ordinal, text): dl is the number of tokens of the chunk.

    ``only`` (term) keeps its terms alone, before anything is shuffled.
    """
    cells = chunks.select(*KEYS, tokens(F.col("text")).alias("tokens")).select(*KEYS, F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    if only is not None:
        cells = cells.join(only, "term", "left_semi")
    return cells.groupBy(*KEYS, "term", "dl").agg(F.count(F.lit(1)).alias("tf")).select(*KEYS, "term", "tf", "dl")


def lengths(chunks: DataFrame) -> DataFrame:
    """(path, ordinal, dl): tokens of every chunk, those without any included."""
    return chunks.select(*KEYS, F.size(tokens(F.col("text"))).cast("long").alias("dl"))


def statistics(chunks: DataFrame) -> DataFrame:
    """One row (n_chunks, avgdl); the average is 1 for an empty corpus."""
    return lengths(chunks).agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bucket(term: Column) -> Column:
    """Polynomial hash of a token (base 131, modulo 1,000,003) to one of the dimensions."""
    folded = F.aggregate(F.split(term, ""), F.lit(0).cast("long"), lambda h, c: (h * 131 + F.ascii(c)) % 1_000_003)
    return (folded % DIMENSIONS).cast("int")


def hashed_vectors(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, vector): counts of hashed tokens at unit length; the zero vector for texts without tokens.

    The hash is taken once for each distinct term of a row, after counting.
    """
    terms = rows.select(*keys, F.explode(tokens(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    sums = terms.groupBy(*keys, bucket(F.col("term")).alias("b")).agg(F.sum("tf").alias("c"))
    by_row = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))
    norm = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("n"))
    made = by_row.withColumn("n", norm).select(*keys, vector.alias("vector"))
    zero = F.array_repeat(F.lit(0.0), DIMENSIONS)
    return rows.select(*keys).join(made, keys, "left").withColumn("vector", F.coalesce("vector", zero))


def dot(a: Column, b: Column) -> Column:
    # one sum of 64 products is too long a method for the JVM's compiler and ran five times slower than this fold
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalise(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    bound = F.transform(F.array(v), lambda x: F.struct(x.alias("x"), F.sqrt(dot(x, x)).alias("n")))
    return F.element_at(F.transform(bound, lambda s: F.when(s["n"] > 0, F.transform(s["x"], lambda c: c / s["n"])).otherwise(s["x"].cast("array<double>"))), 1)


def path_terms(sources: DataFrame) -> DataFrame:
    """(path, terms): words of the project label and of the path below the folder that all files of its root share."""
    folder = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    files = sources.select("path", "project", "root_label").distinct().withColumn("folder", folder)
    ends = files.groupBy("root_label").agg(F.min("folder").alias("lo"), F.max("folder").alias("hi"))
    # the first place where the extremes differ ends what all folders share
    differs = F.filter(F.sequence(F.lit(0), F.least(F.size("lo"), F.size("hi"))), lambda i: ~F.get("lo", i).eqNullSafe(F.get("hi", i)) | F.get("lo", i).isNull())
    common = ends.select("root_label", F.element_at(differs, 1).alias("shared"))
    below = F.array_join(F.slice(F.split("path", "/"), F.col("shared") + 1, F.size(F.split("path", "/"))), "/")
    stem = F.regexp_replace(below, r"(?<=[^/.])(\.[^./]*)$", "")
    return files.join(common, "root_label").select("path", F.array_distinct(words(F.concat_ws(" ", "project", stem))).alias("terms"))
