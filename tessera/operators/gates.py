"""Safety gates: the first failing one names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, glob_regex, secret_reason, stripped


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def suffix(path: Column) -> Column:
    """The last dotted ending of the file name, in lower case."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def silent(path: Column, below_root: Column, extensions: list[str]) -> Column:
    """Rows passed over without an entry in the rejection log."""
    hidden_below = F.exists(path_parts(below_root), lambda p: p.startswith("."))
    return ~suffix(path).isin([e.lower() for e in extensions]) | hidden_below


def path_reason(path: Column, denied_parts: list[str], fragments: list[str], globs: list[str], own_folder: str = "", allowed_hidden: str = ".openclaw") -> Column:
    """Why a path may not be read, or null."""
    parts = path_parts(path)
    denied = F.array_min(F.array_intersect(F.transform(parts, folded), F.array(*[F.lit(p.lower()) for p in denied_parts]).cast("array<string>")))
    name = folded(F.element_at(parts, -1))
    sensitive = F.lit(False)
    for x in fragments:
        sensitive = sensitive | F.contains(name, F.lit(x.lower()))
    globbed = F.lit(False)
    for g in globs:
        globbed = globbed | path.rlike(glob_regex(g))
    own = (path == own_folder) | path.startswith(own_folder + "/") if own_folder else F.lit(False)
    return (
        F.when(F.exists(parts, lambda p: p.startswith(".") & (p != allowed_hidden)), "hidden path segment")
        .when(denied.isNotNull(), F.concat(F.lit("denied path segment: "), denied))
        .when(sensitive, "sensitive filename")
        .when(globbed, "denied glob")
        .when(own, "self-ingestion")
    )


def size_reason(size: Column, most: int) -> Column:
    return F.when(size.isNull(), "unreadable metadata").when(size == 0, "empty file").when(size > most, F.lit(f"over {most} bytes"))


def content_reason(content: Column) -> Column:
    """Why a file's bytes are refused at indexing, or null; content is binary and null where it cannot be read."""
    text = F.try_validate_utf8(content.cast("string"))
    return (
        F.when(text.isNull(), "unreadable or not UTF-8")
        .when(secret_reason(text).isNotNull(), F.concat(F.lit("secret-shaped content: "), secret_reason(text)))
        .when(stripped(text) == "", "no text to index")
    )


def gate(listing: DataFrame, extensions: list[str], denied_parts: list[str], fragments: list[str], globs: list[str], max_file_bytes: int = 262_144, own_folder: str = "") -> DataFrame:
    """listing(path, below_root, size, ...) with ``reason``: null for files that may be read; silent rows are left out."""
    path = F.col("path")
    kept = listing.where(~silent(path, F.col("below_root"), extensions))
    return kept.withColumn("reason", F.coalesce(path_reason(path, denied_parts, fragments, globs, own_folder), size_reason(F.col("size"), max_file_bytes)))
