"""Chunkers as array folds: paragraphs packed to a limit, and Markdown sections that carry their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, chunk_id, sha256, stripped

_HEADING = rf"(?U)^(#{{1,6}}){SPACE}+(.*[^\s\x1c-\x1f]){SPACE}*$"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def windows(text: Column, size: Column, step: Column) -> Column:
    """Windows of ``size`` characters every ``step``, stripped, empty ones left out; the last may lie inside the one before."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, step)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda s: stripped(F.substr(text, s + 1, size))), lambda p: p != "")


def pack(text: Column, size: Column, overlap: int) -> Column:
    """array<string>: paragraphs packed greedily up to ``size``, each next chunk seeded with the last ``overlap`` characters.

    The seed is not counted against the limit; a paragraph longer than the limit is cut into windows on its own.
    """
    paragraphs = F.filter(F.transform(F.split(text, rf"(?U)\n{SPACE}*\n"), stripped), lambda p: p != "")
    step = F.greatest(F.lit(1), size - overlap)
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        flushed = F.when(cur != "", F.concat(out, F.array(cur))).otherwise(out)
        joined = F.when(cur != "", F.concat(cur, F.lit("\n\n"), p)).otherwise(p)
        seed = stripped(F.right(cur, F.lit(overlap))) if overlap else F.lit("")
        return (
            F.when(F.length(p) > size, F.struct(F.concat(flushed, windows(p, size, step)).alias("out"), F.lit("").alias("cur")))
            .when(F.length(joined) <= size, F.struct(out.alias("out"), joined.alias("cur")))
            .otherwise(F.struct(F.concat(out, F.array(cur)).alias("out"), stripped(F.concat(seed, F.lit("\n\n"), p)).alias("cur")))
        )

    return F.aggregate(paragraphs, zero, add, lambda acc: F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))


def sections(text: Column) -> Column:
    """array<struct<crumb, body>>: the text under each heading with its trail of headings; empty bodies are left out."""
    kind = "struct<stack:array<struct<level:int,title:string>>,lines:array<string>,out:array<struct<crumb:string,body:string>>>"
    zero = F.struct(F.array().cast("array<struct<level:int,title:string>>").alias("stack"), F.array().cast("array<string>").alias("lines"), F.array().cast("array<struct<crumb:string,body:string>>").alias("out"))

    def flush(acc: Column) -> Column:
        body = stripped(F.array_join(acc["lines"], "\n"))
        crumb = F.array_join(F.transform(acc["stack"], lambda s: s["title"]), " > ")
        return F.when(body != "", F.concat(acc["out"], F.array(F.struct(crumb.alias("crumb"), body.alias("body"))))).otherwise(acc["out"])

    def add(acc: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, _HEADING, 1))
        title = stripped(F.regexp_extract(line, _HEADING, 2))
        stack = F.concat(F.filter(acc["stack"], lambda s: s["level"] < level), F.array(F.struct(level.alias("level"), title.alias("title"))))
        return F.when(line.rlike(_HEADING), F.struct(stack.alias("stack"), F.array().cast("array<string>").alias("lines"), flush(acc).alias("out"))).otherwise(
            F.struct(acc["stack"].alias("stack"), F.concat(acc["lines"], F.array(line)).alias("lines"), acc["out"].alias("out"))
        ).cast(kind)

    return F.aggregate(F.split(text, _LINES), zero.cast(kind), add, flush)


def markdown(text: Column, size: int, overlap: int) -> Column:
    """array<string>: packed sections, each piece under its trail of headings; plain packing where no section has text."""

    def pieces(s: Column) -> Column:
        room = F.greatest(F.lit(1), F.lit(size) - F.when(s["crumb"] != "", F.length(s["crumb"]) + 1).otherwise(0))
        return F.transform(pack(s["body"], room, overlap), lambda p: F.when(s["crumb"] != "", F.concat(s["crumb"], F.lit("\n"), p)).otherwise(p))

    made = F.flatten(F.transform(sections(text), pieces))
    return F.when(F.size(made) > 0, made).otherwise(pack(text, F.lit(size), overlap))


def chunks(sources: DataFrame, size: int = 1600, overlap: int = 180, chunker: str = "") -> DataFrame:
    """Adds (ordinal, text, text_hash, chunk_id) rows for sources(path, file_type, text); ``chunker='plain'`` ignores headings."""
    if chunker not in ("", "plain"):
        raise ValueError(f"unknown chunker '{chunker}'")
    plain = pack(F.col("text"), F.lit(size), overlap)
    is_markdown = F.regexp_replace(F.lower("file_type"), r"^\.+", "").isin("md", "markdown")
    made = plain if chunker == "plain" else F.when(is_markdown, markdown(F.col("text"), size, overlap)).otherwise(plain)
    out = sources.select("*", F.posexplode(made).alias("ordinal", "__piece")).withColumn("text", F.col("__piece")).drop("__piece")
    return out.withColumn("text_hash", sha256(F.col("text"))).withColumn("chunk_id", chunk_id(F.col("path"), F.col("ordinal"), F.col("text_hash")))
