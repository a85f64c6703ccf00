"""Ranking of chunks for a whole table of questions: BM25, dense similarity, fusion, features, re-ranking, top k.

Scores are rounded to nine decimals before they are ordered: the order of floating-point
sums is not fixed on a cluster, and ties are then broken by path and ordinal.
All statistics are taken over the whole corpus; a project filter applies after scoring.

No task gets all chunks of a question: maxima are aggregates that are joined back, ranks are counted inside bands of
scores and added up over the bands, and the last orders are taken over the few files that can still win.
Several policies are ranked over the same scores in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded, keyword_terms, tokens, words
from . import scoring
from .index import KEYS, document_frequency, dot, idf, path_terms, postings, statistics
from .scoring import K1, B

# Fixed values.
COVERAGE_BONUS = 0.18


@dataclass(frozen=True)
class Policy:
    """fusion: raw, minmax, rrf, or keyword (no vectors; blends nothing)."""

    policy_id: str = "hybrid-rrf"
    fusion: str = "rrf"
    dense_weight: float = 0.5
    rrf_k: int = 60
    recency_weight: float = 0.05
    metadata_weight: float = 0.15
    rerank_budget: int = 20
    top_k: int = 10


#: The evaluated systems that rank chunks.
SYSTEMS = [
    Policy("bm25", "keyword", 0.0),
    Policy("dense", "raw", 1.0),
    Policy("hybrid", "raw", 0.55),
    Policy("hybrid-norerank", "raw", 0.55, rerank_budget=0),
    Policy("hybrid-norecency", "raw", 0.55, recency_weight=0.0),
    Policy("hybrid-rrf", "rrf", 0.5),
]


def clamp_top_k(requested: int | None, default: int = 10, most: int = 50) -> int:
    return max(1, min(int(requested or default), most))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries(query_id, question)."""
    return queries.select("query_id", F.explode(keyword_terms(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(queries: DataFrame, chunks: DataFrame, posting: DataFrame | None = None, stats: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(query_id, path, ordinal, lexical, matched, coverage) for chunks that share a term with a query.

    ``posting`` (path, ordinal, term, tf, dl) and ``stats`` (n_chunks, avgdl) may be stored ones; terms(query_id, term, qtf) may
    replace the keyword terms of the questions.
    """
    terms = query_terms(queries) if terms is None else terms
    n_terms = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    asked = terms.select("term").distinct()
    wanted = postings(chunks, asked) if posting is None else posting.join(asked, "term", "left_semi")
    stats = statistics(chunks) if stats is None else stats
    hits = terms.join(wanted, "term").join(document_frequency(wanted), "term").crossJoin(F.broadcast(stats))
    tf = F.col("tf")
    weight = F.col("qtf") * idf(F.col("n_chunks"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))))
    scored = hits.groupBy("query_id", *KEYS).agg(F.round(F.sum(weight), 9).alias("lexical"), F.count(F.lit(1)).alias("matched"))
    return scored.join(n_terms, "query_id").withColumn("coverage", F.col("matched") / F.col("n_terms")).drop("n_terms")


def term_weights(queries: DataFrame, chunks: DataFrame, posting: DataFrame | None = None) -> DataFrame:
    """(query_id, term, weight): idf of every distinct token of a question, stopwords and unseen terms included."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    asked = terms.select("term").distinct()
    n = chunks.agg(F.count(F.lit(1)).alias("n_chunks"))
    wanted = postings(chunks, asked) if posting is None else posting.join(asked, "term", "left_semi")
    found = terms.join(document_frequency(wanted), "term", "left").crossJoin(F.broadcast(n))
    return found.select("query_id", "term", idf(F.col("n_chunks"), F.coalesce("df", F.lit(0))).alias("weight"))


def path_overlap(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, path, overlap): share of a question's words found in a path's terms, where there is any."""
    asked = queries.select("query_id", F.array_distinct(words(F.col("question"))).alias("w"))
    single = asked.select("query_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    found = single.join(path_terms(sources).select("path", F.explode("terms").alias("word")), "word")
    return found.groupBy("query_id", "path", "n").agg(F.count(F.lit(1)).alias("shared")).select("query_id", "path", (F.col("shared") / F.col("n")).alias("overlap"))


def similarity(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, keys of vectors, similarity): every question against every row; both sides have ``vector``."""
    q = queries.select("query_id", F.col("vector").alias("__q"))
    return vectors.crossJoin(q).withColumn("similarity", F.round(dot(F.col("vector"), F.col("__q")), 9)).drop("vector", "__q")


def top(rows: DataFrame, by: list, k: int, group: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``."""
    w = Window.partitionBy(group).orderBy(*by)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Bands of scores in which ranks are counted.
_BANDS = 4096


def placed(rows: DataFrame, value: str, high: Column, low: Column, name: str) -> DataFrame:
    """Adds the place of each row in its query by descending ``value``, ties by path and ordinal; values lie between low and high.

    Rows are numbered inside bands of the value, and the rows in higher bands are added.
    """
    share = F.when(high > low, (high - F.col(value)) / (high - low)).otherwise(0.0)
    banded = rows.withColumn("__band", F.least(F.floor(share * _BANDS), F.lit(_BANDS)).cast("int"))
    above = Window.partitionBy("query_id").orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    before = banded.groupBy("query_id", "__band").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select("query_id", "__band", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("query_id", "__band").orderBy(F.desc(value), *KEYS)
    numbered = banded.withColumn("__no", F.row_number().over(inside)).join(before, ["query_id", "__band"])
    return numbered.withColumn(name, F.col("__before") + F.col("__no")).drop("__band", "__no", "__before")


def _policies(spark, policies: list[Policy]) -> DataFrame:
    rows = [(p.policy_id, p.fusion, float(p.dense_weight), p.rrf_k, float(p.recency_weight), float(p.metadata_weight), p.rerank_budget, p.top_k) for p in policies]
    return spark.createDataFrame(rows, "policy_id string, fusion string, w double, rrf_k int, recency_weight double, metadata_weight double, budget int, top_k int")


def _check(fusions) -> None:
    unknown = {*fusions} - {"keyword", "raw", "minmax", "rrf"}
    if unknown:
        raise ValueError(f"unknown fusion '{sorted(unknown)[0]}'")


def fuse(rows: DataFrame, policies: Policy | list[Policy], matches: DataFrame | None = None) -> DataFrame:
    """rows(query_id, path, ordinal, lexical, similarity, ...) once for each policy, with the policy's columns and ``relevance``.

    The rows hold every chunk of every query, or for keyword policies those with a match; matches(query_id, path, ordinal, lexical) are those
    with a keyword score, if they are known.  Reciprocal-rank sums are as they are, not yet shares of the best one.
    """
    policies = [policies] if isinstance(policies, Policy) else policies
    used = {p.fusion for p in policies}
    _check(used)
    # maxima of the keyword scores come from the chunks that have one
    found = rows.where("lexical > 0") if matches is None else matches
    ends = found.groupBy("query_id").agg(F.max("lexical").alias("__most"), F.count(F.lit(1)).alias("__matched"))
    rows = rows.join(ends, "query_id", "left")
    keyword = F.col("lexical") / F.coalesce("__most", F.lit(1.0))
    w = F.col("w")
    relevance = F.when(F.col("fusion") == "keyword", keyword)
    if "raw" in used:
        relevance = relevance.when(F.col("fusion") == "raw", w * (F.col("similarity") + 1) / 2 + (1 - w) * keyword)
    if "minmax" in used:
        rows = rows.join(rows.groupBy("query_id").agg(F.min("similarity").alias("__lo"), F.max("similarity").alias("__hi")), "query_id")
        scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col("similarity") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.0)
        relevance = relevance.when(F.col("fusion") == "minmax", w * scaled + (1 - w) * keyword)
    if "rrf" in used:
        rows = placed(rows, "similarity", F.lit(1.0), F.lit(-1.0), "__dense")
        # all chunks without a query term share the rank after the last match
        scored = found.select("query_id", *KEYS, "lexical").join(ends, "query_id")
        words_ = placed(scored, "lexical", F.col("__most"), F.lit(0.0), "__word").select("query_id", *KEYS, "__word")
        rows = rows.join(words_, ["query_id", *KEYS], "left").withColumn("__word", F.coalesce("__word", F.coalesce("__matched", F.lit(0)) + 1))
        relevance = relevance.when(F.col("fusion") == "rrf", w / (F.col("rrf_k") + F.col("__dense")) + (1 - w) / (F.col("rrf_k") + F.col("__word")))
    rows = rows.crossJoin(F.broadcast(_policies(rows.sparkSession, policies))).withColumn("relevance", relevance)
    return rows.drop("__most", "__matched", "__lo", "__hi", "__dense", "__word")


def rank(queries: DataFrame, chunks: DataFrame, policy: Policy | list[Policy], project: str | None = None, vectors: DataFrame | None = None, posting: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, score, path, ordinal): the best chunk of each of the best ``top_k`` files; of a list of policies also policy_id.

    queries(query_id, question[, vector]); chunks(path, ordinal, project, root_label, mtime[, text]); vectors(path, ordinal, vector)
    unless the policies are keyword-only; the text is needed only without stored ``posting`` and ``stats`` (see bm25).
    Without stored postings and vectors all scores are taken from the texts, block by block (see scoring); vectors are then the hashed ones.
    """
    policies = [policy] if isinstance(policy, Policy) else policy
    _check([p.fusion for p in policies])
    if posting is None and stats is None and vectors is None:
        out = _rank_texts(queries, chunks, policies, project)
        return out.drop("policy_id") if isinstance(policy, Policy) else out
    sparse = all(p.fusion == "keyword" for p in policies)
    lexical = bm25(queries, chunks, posting, stats)
    overlap = path_overlap(queries, chunks)
    files = chunks.select("path", "project", "mtime").distinct()
    span = chunks.agg(F.min("mtime").alias("__from"), F.greatest(F.lit(1.0), F.max("mtime") - F.min("mtime")).alias("__range"))
    if sparse:
        by_path = overlap.join(chunks.select(*KEYS), "path").select("query_id", *KEYS)
        rows = lexical.select("query_id", *KEYS).union(by_path).distinct()
    else:
        rows = similarity(queries, vectors)
    rows = rows.join(lexical, ["query_id", *KEYS], "left").na.fill(0.0, ["lexical", "coverage"])
    rows = fuse(rows, policies, lexical)
    # what follows is the same for all chunks of a file but for relevance and coverage
    of_file, settings = ["query_id", "policy_id", "path"], ["fusion", "recency_weight", "metadata_weight", "budget", "top_k"]
    by_file = rows.groupBy(*of_file, *settings).agg(F.collect_list(F.struct("relevance", "lexical", "ordinal", "coverage")).alias("cells"))
    if any(p.fusion == "rrf" for p in policies):
        best = by_file.groupBy("query_id", "policy_id").agg(F.max(F.array_max(F.transform("cells", lambda c: c["relevance"]))).alias("__best"))
        by_file = by_file.join(best, ["query_id", "policy_id"])
    else:
        by_file = by_file.withColumn("__best", F.lit(1.0))
    by_file = by_file.join(overlap, ["query_id", "path"], "left").na.fill(0.0, ["overlap"]).join(files, "path").crossJoin(F.broadcast(span))
    if project:
        by_file = by_file.where(F.contains(folded(F.col("project")), F.lit(project.lower())))
    scale = F.when((F.col("fusion") == "rrf") & (F.col("__best") > 0), F.col("__best")).otherwise(1.0)
    recency = F.col("recency_weight") * (F.col("mtime") - F.col("__from")) / F.col("__range")
    # a keyword policy has no use for chunks without any match
    kept = F.filter("cells", lambda c: (F.col("fusion") != "keyword") | (c["lexical"] > 0) | (F.col("overlap") > 0))
    scored = F.transform(kept, lambda c: F.struct(F.round(c["relevance"] / scale + recency + F.col("metadata_weight") * F.col("overlap"), 9).alias("score"), c["ordinal"].alias("ordinal"), c["coverage"].alias("coverage")))
    by_file = by_file.select(*of_file, "budget", "top_k", scored.alias("cells")).where(F.size("cells") > 0).withColumn("best", F.array_max(F.transform("cells", lambda c: c["score"])))
    # chunks of the head belong to the files whose best chunk is among the first; of all others only top_k can be shown
    most = max(p.rerank_budget + p.top_k for p in policies)
    by_best = Window.partitionBy("query_id", "policy_id").orderBy(F.desc("best"), "path")
    open_ = by_file.withColumn("__no", F.row_number().over(by_best)).where(F.col("__no") <= most)
    cells = open_.select(*of_file, "budget", "top_k", F.explode("cells").alias("c")).select(*of_file, "budget", "top_k", "c.*")
    named = [] if isinstance(policy, Policy) else ["policy_id"]
    return _first(cells).select(*named, "query_id", "rank", F.round("final", 6).alias("score"), "path", "ordinal")


def _first(cells: DataFrame) -> DataFrame:
    """(query_id, policy_id, path, ordinal, final, rank) of cells(query_id, policy_id, budget, top_k, path, ordinal, score, coverage), which hold
    the chunks of the head and the best chunk of each file that can be shown."""
    of_file = ["query_id", "policy_id", "path"]
    head = F.row_number().over(Window.partitionBy("query_id", "policy_id").orderBy(F.desc("score"), *KEYS)) <= F.col("budget")
    cells = cells.withColumn("head", head)
    cells = cells.withColumn("final", F.round(F.col("score") + F.when(F.col("head"), COVERAGE_BONUS * F.col("coverage")).otherwise(0.0), 9))
    shown = cells.groupBy(*of_file, "top_k").agg(F.max_by("ordinal", F.struct("final", "head", "score", -F.col("ordinal"))).alias("ordinal"), F.max("final").alias("final"))
    place = F.row_number().over(Window.partitionBy("query_id", "policy_id").orderBy(F.desc("final"), "path"))
    return shown.withColumn("rank", place.cast("long")).where(F.col("rank") <= F.col("top_k"))


def _rank_texts(queries: DataFrame, chunks: DataFrame, policies: list[Policy], project: str | None) -> DataFrame:
    """rank() from the texts, with policy_id.  The answers, top_k for each question and policy, pass through the driver as the questions do."""
    spark, asked = chunks.sparkSession, scoring.Asked(queries)
    kind = f"policy_id string, query_id {asked.kind.simpleString()}, rank long, score double, path string, ordinal int"
    dense = any(p.fusion != "keyword" for p in policies)
    made = scoring.blocks(chunks, asked, dense, project).persist()
    try:
        corpus = scoring.Corpus(made, asked)
        ends = scoring.extremes(made, asked, corpus, any(p.fusion == "minmax" for p in policies))
        plain = [p for p in policies if p.fusion != "rrf"]
        by_rank = [p for p in policies if p.fusion == "rrf"]
        found = scoring.candidates(made, asked, corpus, plain, ends) if plain else None
        if by_rank:
            more = scoring.ranked_candidates(made, asked, corpus, by_rank, bool(project)).withColumn("p", F.col("p") + len(plain))
            found = more if found is None else found.unionByName(more)
        order = plain + by_rank
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("p") + 1)
        cells = found.withColumns({"query_id": F.col("q"), "policy_id": F.col("p"), "budget": of([p.rerank_budget for p in order]), "top_k": of([p.top_k for p in order])})
        rows = _first(cells).select("policy_id", "query_id", "rank", F.round("final", 6), "path", "ordinal").collect()
    finally:
        made.unpersist()
    return spark.createDataFrame([(order[r[0]].policy_id, asked.ids[r[1]], *r[2:]) for r in rows], kind)


def score_spread(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, head: int = 20) -> DataFrame:
    """(query_id, dense_spread, lexical_spread): max less min over the ``head`` densest chunks of both scores, each brought to 0..1.

    All tokens of a question count here, stopwords too.  Without ``vectors`` the scores come from the texts (see scoring).
    """
    if vectors is None:
        return _spread_texts(queries, chunks, head)
    terms = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    lexical = bm25(queries, chunks, terms=terms)
    most = lexical.groupBy("query_id").agg(F.max("lexical").alias("most"))
    near = top(similarity(queries, vectors), [F.desc("similarity"), *KEYS], head)
    both = near.join(lexical, ["query_id", *KEYS], "left").join(most, "query_id", "left").na.fill(0.0, ["lexical", "most"])
    dense, share = (F.col("similarity") + 1) / 2, F.col("lexical") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)
    return both.groupBy("query_id").agg((F.max(dense) - F.min(dense)).alias("dense_spread"), (F.max(share) - F.min(share)).alias("lexical_spread"))


def _spread_texts(queries: DataFrame, chunks: DataFrame, head: int) -> DataFrame:
    asked = scoring.Asked(queries, every=True)
    made = scoring.blocks(chunks, asked, True).persist()
    try:
        corpus = scoring.Corpus(made, asked)
        most = scoring.extremes(made, asked, corpus, False)["most"]
        near = top(scoring.nearest(made, asked, corpus, head), [F.desc("similarity"), *KEYS], head, "q")
        ends = [f(c).alias(f"{n}_{c}") for c in ("similarity", "lexical") for n, f in (("hi", F.max), ("lo", F.min))]
        rows = near.groupBy("q").agg(*ends).collect()
    finally:
        made.unpersist()
    share = lambda x: (x + 1) / 2
    found = [(asked.ids[r["q"]], share(r["hi_similarity"]) - share(r["lo_similarity"]), r["hi_lexical"] / float(most[r["q"]]) - r["lo_lexical"] / float(most[r["q"]])) for r in rows]
    return chunks.sparkSession.createDataFrame(found, f"query_id {asked.kind.simpleString()}, dense_spread double, lexical_spread double")


def median_spread(spreads: DataFrame) -> DataFrame:
    """One row: the medians of both spreads over the questions."""
    return spreads.agg(F.round(F.median("dense_spread"), 4).alias("dense_spread"), F.round(F.median("lexical_spread"), 4).alias("lexical_spread"))
