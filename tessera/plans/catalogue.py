"""Registered queries of the retrieval engine, with SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import baselines, chunking, evaluation, gates, index, ranking, refresh, selection, snippets, trust
from .corpora import CHUNKS_SQL, QRELS_SQL, QUESTIONS_SQL, SOURCES_SQL, chunks, qrels, questions, sources, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# SQL building blocks ---------------------------------------------------------------------------

_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"


def _tok(x: str, pattern: str = T.TOKEN) -> str:
    return f"list_transform(regexp_extract_all({x}, '{pattern}'), lambda t: lower(t))"


_KEYWORDS_SQL = f"""asked AS (SELECT query_id, CASE WHEN len(few) = 0 THEN every ELSE few END AS terms
  FROM (SELECT query_id, every, list_filter(every, lambda t: t NOT IN {_STOP}) AS few FROM (SELECT query_id, {_tok('question')} AS every FROM questions))),
terms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM asked) GROUP BY ALL)"""
_ALL_TERMS_SQL = f"""terms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tok('question')}) AS term FROM questions) GROUP BY ALL)"""
_POSTINGS_SQL = f"""lengths AS (SELECT path, ordinal, len({_tok('text')}) AS dl FROM chunks),
postings AS (SELECT path, ordinal, term, count(*) AS tf FROM (SELECT path, ordinal, unnest({_tok('text')}) AS term FROM chunks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n_chunks, coalesce(avg(dl), 1.0) AS avgdl FROM lengths)"""
_BM25_SQL = f"""{_KEYWORDS_SQL}, {_POSTINGS_SQL},
bm25 AS (SELECT query_id, path, ordinal, round(sum(qtf * ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(1.0, avgdl)))), 9) AS lexical,
  count(*) AS matched, count(*) / any_value(n_terms) AS coverage
  FROM terms JOIN postings USING (term) JOIN df USING (term) JOIN lengths USING (path, ordinal) JOIN (SELECT query_id, count(*) AS n_terms FROM terms GROUP BY query_id) USING (query_id) CROSS JOIN stats
  GROUP BY query_id, path, ordinal)"""
_WORDS = lambda x: f"list_transform(regexp_extract_all({x}, '{T.WORD}'), lambda t: lower(t))"
_OVERLAP_SQL = f"""path_terms AS (SELECT DISTINCT path, unnest({_WORDS("project || ' ' || regexp_replace(below_root, '\\.[^./]*$', '')")}) AS word FROM sources),
overlap AS (SELECT query_id, path, count(*) / any_value(n) AS overlap
  FROM (SELECT query_id, len(w) AS n, unnest(w) AS word FROM (SELECT query_id, list_distinct({_WORDS('question')}) AS w FROM questions)) JOIN path_terms USING (word) GROUP BY query_id, path)"""
_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 131 + c) % 1000003) % 64"
_VECTORS_SQL = f"""cv0 AS (SELECT path, ordinal, {_HASH} AS b, sum(tf)::DOUBLE AS c FROM postings GROUP BY ALL),
cv AS (SELECT path, ordinal, b, c / sqrt(sum(c * c) OVER (PARTITION BY path, ordinal)) AS v FROM cv0),
qv0 AS (SELECT query_id, {_HASH} AS b, sum(tf)::DOUBLE AS c FROM (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({_tok('question')}) AS term FROM questions) GROUP BY ALL) GROUP BY ALL),
qv AS (SELECT query_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS v FROM qv0),
sims AS (SELECT query_id, path, ordinal, round(sum(cv.v * qv.v), 9) AS s FROM cv JOIN qv USING (b) GROUP BY ALL),
dense AS (SELECT query_id, path, ordinal, coalesce(s, 0.0) AS similarity FROM chunks CROSS JOIN questions LEFT JOIN sims USING (query_id, path, ordinal))"""


def _rank_sql(policy: ranking.Policy, project: str | None = None) -> str:
    w, k = policy.dense_weight, policy.rrf_k
    keyword = "lexical / CASE WHEN max(lexical) OVER q > 0 THEN max(lexical) OVER q ELSE 1.0 END"
    relevance = {
        "keyword": keyword,
        "raw": f"{w} * (similarity + 1) / 2 + (1 - {w}) * {keyword}",
        "minmax": f"{w} * CASE WHEN max(similarity) OVER q > min(similarity) OVER q THEN (similarity - min(similarity) OVER q) / (max(similarity) OVER q - min(similarity) OVER q) ELSE 0.0 END + (1 - {w}) * {keyword}",
        "rrf": f"{w} / ({k} + dr) + (1 - {w}) / ({k} + CASE WHEN lexical > 0 THEN wr ELSE m + 1 END)",
    }[policy.fusion]
    scale = "relevance / CASE WHEN max(relevance) OVER (PARTITION BY query_id) > 0 THEN max(relevance) OVER (PARTITION BY query_id) ELSE 1.0 END" if policy.fusion == "rrf" else "relevance"
    if policy.fusion == "keyword":
        cells = "SELECT DISTINCT query_id, path, ordinal FROM (SELECT query_id, path, ordinal FROM bm25 UNION ALL SELECT query_id, path, ordinal FROM overlap JOIN chunks USING (path))"
    else:
        cells = "SELECT query_id, path, ordinal, similarity FROM dense"
    ranks = "row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path, ordinal) AS dr, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, path, ordinal) AS wr, count(*) FILTER (lexical > 0) OVER (PARTITION BY query_id) AS m," if policy.fusion == "rrf" else ""
    vectors = "" if policy.fusion == "keyword" else f"{_VECTORS_SQL},"
    where = f"WHERE contains(lower(project), '{project}')" if project else ""
    return f"""WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_BM25_SQL}, {_OVERLAP_SQL}, {vectors}
cells AS ({cells}),
lex AS (SELECT cells.*, coalesce(lexical, 0.0) AS lexical, coalesce(coverage, 0.0) AS coverage FROM cells LEFT JOIN bm25 USING (query_id, path, ordinal)),
ranked AS (SELECT *, {ranks} 0 AS z FROM lex),
rel AS (SELECT *, {relevance} AS relevance FROM ranked WINDOW q AS (PARTITION BY query_id)),
rel2 AS (SELECT * EXCLUDE (relevance), {scale} AS relevance FROM rel),
span AS (SELECT min(mtime) AS lo, greatest(1.0, max(mtime) - min(mtime)) AS rng FROM chunks),
scored AS (SELECT query_id, path, ordinal, coverage, round(relevance + {policy.recency_weight} * (mtime - lo) / rng + {policy.metadata_weight} * coalesce(overlap, 0.0), 9) AS score
  FROM rel2 LEFT JOIN overlap USING (query_id, path) JOIN (SELECT path, ordinal, project, mtime FROM chunks) USING (path, ordinal) CROSS JOIN span {where}),
headed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, ordinal) <= {policy.rerank_budget} AS head FROM scored),
finals AS (SELECT *, round(score + CASE WHEN head THEN 0.18 * coverage ELSE 0.0 END, 9) AS final FROM headed),
best AS (SELECT * FROM finals QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY final DESC, head DESC, score DESC, ordinal) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, path) AS rank, round(final, 6) AS score, path, ordinal FROM best QUALIFY rank <= {policy.top_k}"""


def _corpus(spark: SparkSession, sf_dir: str):
    return questions(spark, sf_dir), chunks(spark, sf_dir)


def _ranked(spark, sf_dir, policy, project=None) -> DataFrame:
    return ranking.rank(*_corpus(spark, sf_dir), policy, project)


# text and index --------------------------------------------------------------------------------


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_term_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(f"WITH {QUESTIONS_SQL}, {_KEYWORDS_SQL} SELECT query_id, array_to_string(terms, ' ') AS terms FROM asked")
def keyword_terms(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.array_join(T.keyword_terms(F.col("question")), " ").alias("terms"))


@query(f"WITH {SOURCES_SQL}, {_OVERLAP_SQL.split('overlap AS')[0].rstrip().rstrip(',')} SELECT path, count(*) AS n_terms, string_agg(word, ' ' ORDER BY word) AS terms FROM path_terms GROUP BY path")
def path_terms(spark, sf_dir):
    return index.path_terms(sources(spark, sf_dir)).select("path", F.size("terms").cast("long").alias("n_terms"), F.array_join(F.array_sort("terms"), " ").alias("terms"))


@query(f"WITH {CHUNKS_SQL}, {_POSTINGS_SQL} SELECT term, df FROM df")
def postings_df(spark, sf_dir):
    return index.document_frequency(index.postings(chunks(spark, sf_dir)))


@query(f"WITH {CHUNKS_SQL}, {_POSTINGS_SQL} SELECT n_chunks, round(avgdl, 6) AS avgdl FROM stats")
def corpus_stats(spark, sf_dir):
    return index.statistics(chunks(spark, sf_dir)).select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query(r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS ordinal, piece
FROM (SELECT doc_id, s, regexp_replace(substr(text, s::INT + 1, 1600), '^\s+|\s+$', '', 'g') AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text), 1420)) AS s FROM documents)) WHERE piece != ''""")
def chunk_windows(spark, sf_dir):
    made = chunking.windows(F.col("text"), F.lit(1600), F.lit(1420))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(made).alias("ordinal", "piece"))


@query()
def chunk_packed(spark, sf_dir):
    doubled = sources(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.chunks(doubled, chunker="plain").select("path", "ordinal", "text_hash", "chunk_id")


@query()
def chunk_markdown(spark, sf_dir):
    headed = sources(spark, sf_dir).withColumn("text", F.concat(F.lit("# "), "project", F.lit("\n\n## "), "lang", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return chunking.chunks(headed).select("path", "ordinal", "text_hash", "chunk_id")


@query(f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_POSTINGS_SQL}, cv0 AS (SELECT path, ordinal, ({_HASH})::INTEGER AS b, sum(tf)::BIGINT AS c FROM postings GROUP BY ALL) SELECT path, ordinal, b, c FROM cv0")
def hashed_buckets(spark, sf_dir):
    posting = index.postings(chunks(spark, sf_dir))
    return posting.groupBy("path", "ordinal", index.bucket(F.col("term")).alias("b")).agg(F.sum("tf").alias("c"))


# ranking ---------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_BM25_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, path, ordinal) AS rank, path, ordinal, round(lexical, 6) AS lexical, matched FROM bm25 QUALIFY rank <= 10")
def bm25_topk(spark, sf_dir):
    q, c = _corpus(spark, sf_dir)
    best = ranking.top(ranking.bm25(q, c), [F.desc("lexical"), "path", "ordinal"], 10)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "path", "ordinal", F.round("lexical", 6).alias("lexical"), "matched")


@query(f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_BM25_SQL} SELECT query_id, path, ordinal, matched, round(coverage, 6) AS coverage FROM bm25")
def bm25_coverage(spark, sf_dir):
    q, c = _corpus(spark, sf_dir)
    return ranking.bm25(q, c).select("query_id", "path", "ordinal", "matched", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_POSTINGS_SQL} SELECT query_id, term, round(ln(1 + (n_chunks - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 6) AS weight FROM (SELECT DISTINCT query_id, unnest({_tok('question')}) AS term FROM questions) LEFT JOIN df USING (term) CROSS JOIN stats")
def term_weights(spark, sf_dir):
    q, c = _corpus(spark, sf_dir)
    return ranking.term_weights(q, c).select("query_id", "term", F.round("weight", 6).alias("weight"))


@query("""SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank, e.vec_id,
round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 10""")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    best = ranking.top(ranking.similarity(q, e), [F.desc("similarity"), "vec_id"], 10)
    return best.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


def _system(name: str, policy: ranking.Policy, project: str | None = None) -> None:
    def run(spark, sf_dir):
        return _ranked(spark, sf_dir, policy, project)

    run.__name__ = name
    query(_rank_sql(policy, project))(run)


_system("hybrid_search", ranking.Policy())
_system("fuse_raw", ranking.Policy("hybrid", "raw", 0.55))
_system("fuse_minmax", ranking.Policy("hybrid-minmax", "minmax", 0.55))
_system("fuse_rrf", ranking.Policy("rrf-only", "rrf", 0.7, recency_weight=0.0, metadata_weight=0.0, rerank_budget=0))
_system("dense_search", ranking.Policy("dense", "raw", 1.0))
_system("keyword_only_search", ranking.Policy("bm25", "keyword", 0.0))
_system("hybrid_norerank", ranking.Policy("hybrid-norerank", "raw", 0.55, rerank_budget=0))
_system("hybrid_norecency", ranking.Policy("hybrid-norecency", "raw", 0.55, recency_weight=0.0))
_system("hybrid_project_filter", ranking.Policy(), "src1")


#: Fusion by dense weight: the cells of a sweep.
_CELLS = [ranking.Policy(f"{f}/{w}", f, w) for f in ("raw", "minmax", "rrf") for w in (0.4, 0.5, 0.55, 0.7, 0.85, 1.0)]


@query(" UNION ALL ".join(f"SELECT '{p.policy_id}' AS policy_id, * FROM ({_rank_sql(p)})" for p in _CELLS))
def sweep_grid(spark, sf_dir):
    return ranking.rank(*_corpus(spark, sf_dir), _CELLS)


_SPREAD_SQL = f"""WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_BM25_SQL.replace(_KEYWORDS_SQL, _ALL_TERMS_SQL)}, {_VECTORS_SQL}, near AS (SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, path, ordinal) <= 20),
spreads AS (SELECT query_id, max((similarity + 1) / 2) - min((similarity + 1) / 2) AS dense_spread, max(coalesce(lexical / most, 0)) - min(coalesce(lexical / most, 0)) AS lexical_spread
FROM near LEFT JOIN bm25 USING (query_id, path, ordinal) LEFT JOIN (SELECT query_id, max(lexical) AS most FROM bm25 GROUP BY query_id) USING (query_id) GROUP BY query_id)"""


@query(f"{_SPREAD_SQL} SELECT query_id, round(dense_spread, 6) AS dense_spread, round(lexical_spread, 6) AS lexical_spread FROM spreads")
def score_spread(spark, sf_dir):
    return ranking.score_spread(*_corpus(spark, sf_dir)).select("query_id", F.round("dense_spread", 6).alias("dense_spread"), F.round("lexical_spread", 6).alias("lexical_spread"))


@query(f"{_SPREAD_SQL} SELECT round(median(dense_spread), 4) AS dense_spread, round(median(lexical_spread), 4) AS lexical_spread FROM spreads")
def median_score_spread(spark, sf_dir):
    return ranking.median_spread(ranking.score_spread(*_corpus(spark, sf_dir)))


@query()
def snippet_texts(spark, sf_dir):
    q, c = _corpus(spark, sf_dir)
    hits = ranking.top(ranking.bm25(q, c), [F.desc("lexical"), "path", "ordinal"], 10).join(c.select("path", "ordinal", "text"), ["path", "ordinal"]).join(q, "query_id")
    weights = ranking.term_weights(q, c).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
    return snippets.snippets(hits.join(weights, "query_id"), ["query_id", "path", "ordinal"], 240).select("query_id", "path", "ordinal", "snippet")


_SCAN_TERMS = f"list_filter({_tok('question', T.SCAN_TOKEN)}, lambda t: t NOT IN {_STOP})"


@query(f"""WITH {SOURCES_SQL}, {QUESTIONS_SQL}, asked AS (SELECT query_id, list_distinct({_SCAN_TERMS}) AS terms FROM questions),
low AS (SELECT path, replace(lower(text), 'ß', 'ss') AS low FROM sources),
hits AS (SELECT query_id, path, low, terms, len(list_filter(terms, lambda t: contains(low, t))) AS matched FROM low CROSS JOIN asked),
counted AS (SELECT query_id, path, matched, len(list_filter(string_split(low, chr(10)), lambda x: len(list_filter(terms, lambda t: contains(x, t))) > 0)) AS lines FROM hits WHERE matched > 0)
SELECT query_id, path, matched, lines, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, lines DESC, path) AS rank FROM counted QUALIFY rank <= 10""")
def grep_rank(spark, sf_dir):
    return baselines.scan_rank(questions(spark, sf_dir), sources(spark, sf_dir))


@query(f"""WITH {SOURCES_SQL}, {QUESTIONS_SQL}, asked AS (SELECT query_id, list_distinct({_SCAN_TERMS}) AS terms FROM questions),
hits AS (SELECT query_id, path, len(list_filter(terms, lambda t: contains(lower(path), t))) AS matched FROM sources CROSS JOIN asked)
SELECT path, query_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, path) AS rank FROM hits WHERE matched > 0 QUALIFY rank <= 10""")
def filename_rank(spark, sf_dir):
    return baselines.path_rank(questions(spark, sf_dir), sources(spark, sf_dir))


# selection and gates ---------------------------------------------------------------------------


@query(f"WITH {SOURCES_SQL} SELECT path, row_number() OVER (PARTITION BY root_label ORDER BY mtime DESC, path) <= 300 AS selected FROM sources")
def select_newest(spark, sf_dir):
    return selection.newest(sources(spark, sf_dir), 300).select("path", "selected")


@query(f"""WITH {SOURCES_SQL}, p AS (SELECT path, root_label, project, row_number() OVER (PARTITION BY root_label, project ORDER BY mtime DESC, path) AS place FROM sources),
r AS (SELECT *, row_number() OVER (PARTITION BY root_label, place <= 20 ORDER BY place, project) AS rnd FROM p)
SELECT path, place <= 20 AND rnd <= 300 AS selected FROM r""")
def select_balanced(spark, sf_dir):
    return selection.balanced(sources(spark, sf_dir), 300, 20).select("path", "selected")


@query(f"WITH {SOURCES_SQL} SELECT root_label, count(*) AS files, 300::BIGINT AS max_files FROM sources GROUP BY root_label HAVING count(*) > 300")
def over_budget(spark, sf_dir):
    return selection.over_budget(sources(spark, sf_dir), 300)


@query(f"""WITH {SOURCES_SQL} SELECT path, CASE WHEN contains(path, '/src2/') THEN 'denied path segment: src2' WHEN contains(regexp_extract(path, '[^/]*$'), '0007') THEN 'sensitive filename'
WHEN regexp_matches(path, '^.*/es/.*9\\.txt$') THEN 'denied glob' WHEN byte_count = 0 THEN 'empty file' WHEN byte_count > 4000 THEN 'over 4000 bytes' END AS reason FROM sources WHERE file_type IN ('.md', '.txt')""")
def gate_reasons(spark, sf_dir):
    listing = sources(spark, sf_dir).withColumn("size", F.col("byte_count"))
    return gates.gate(listing, [".md", ".txt"], ["SRC2"], ["0007"], ["*/es/*9.txt"], 4000).select("path", "reason")


_SECRET_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in T.SECRETS) + " END"


@query(f"SELECT doc_id, {_SECRET_SQL} AS reason FROM documents")
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.secret_reason(F.col("text")).alias("reason"))


@query("SELECT item_id, CASE " + " ".join(f"WHEN contains(lower(text), '{m}') THEN '{m}'" for m in T.PRIVATE_MARKERS) + f" ELSE {_SECRET_SQL} END AS reason FROM benchmark")
def private_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.private_query_reason(F.col("text")).alias("reason"))


# refresh, trust, audit -------------------------------------------------------------------------

_OLD_SQL = """known AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN sha256('old ' || text) ELSE content_hash END AS content_hash, CASE WHEN doc_id % 11 = 0 THEN byte_count + 4 ELSE byte_count END AS byte_count,
  CASE WHEN doc_id % 13 = 0 THEN mtime - 5 ELSE mtime END AS mtime, CASE WHEN doc_id % 17 = 0 THEN 'corpus/moved' ELSE project END AS project, root_label FROM sources WHERE doc_id % 7 != 0),
seen AS (SELECT * FROM sources WHERE doc_id % 19 != 0)"""


def _states(spark, sf_dir):
    """An older index (some files absent, edited, touched or moved) and a newer disk (some files gone)."""
    s = sources(spark, sf_dir)
    i = F.col("doc_id")
    old = s.where(i % 7 != 0).select(
        "path",
        F.when(i % 11 == 0, F.sha2(F.concat(F.lit("old "), "text"), 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(i % 11 == 0, F.col("byte_count") + 4).otherwise(F.col("byte_count")).alias("byte_count"),
        F.when(i % 13 == 0, F.col("mtime") - 5).otherwise(F.col("mtime")).alias("mtime"),
        F.when(i % 17 == 0, "corpus/moved").otherwise(F.col("project")).alias("project"),
        "root_label",
    )
    return old, s.where(i % 19 != 0)


_DIFF_SQL = f"""WITH {SOURCES_SQL}, {_OLD_SQL}, changes AS (SELECT coalesce(k.path, s.path) AS path,
CASE WHEN k.path IS NULL THEN 'added' WHEN s.path IS NULL THEN CASE WHEN k.path LIKE '/corpus/src3/%' THEN 'orphan_kept' ELSE 'removed' END
WHEN k.byte_count = s.byte_count AND abs(k.mtime - s.mtime) < 1e-6 THEN 'unchanged' WHEN k.content_hash = s.content_hash THEN 'touched' ELSE 'reindexed' END AS status,
k.project IS DISTINCT FROM s.project OR k.root_label IS DISTINCT FROM s.root_label AS moved FROM known k FULL JOIN seen s ON k.path = s.path)"""


def _changes(spark, sf_dir):
    known, seen = _states(spark, sf_dir)
    return refresh.diff(known, seen, missing_roots=["/corpus/src3"])


@query(f"{_DIFF_SQL} SELECT path, status, status IN ('unchanged', 'touched') AND moved AS relabelled FROM changes")
def refresh_diff(spark, sf_dir):
    return _changes(spark, sf_dir)


@query(f"""{_DIFF_SQL} SELECT s.status, count(*) FILTER (c.status = s.status OR (s.status = 'relabelled' AND c.status = 'unchanged' AND moved)) AS files
FROM changes c CROSS JOIN (SELECT unnest([{', '.join(repr(s) for s in refresh.STATUSES)}]) AS status) s GROUP BY s.status""")
def refresh_counters(spark, sf_dir):
    return refresh.counters(_changes(spark, sf_dir))


@query(f"WITH {CHUNKS_SQL} SELECT sha256(text) AS text_hash, count(*) AS chunks FROM chunks GROUP BY text")
def text_hash_dedupe(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("chunks"))


@query(f"WITH {CHUNKS_SQL} SELECT DISTINCT sha256(text) AS text_hash FROM chunks WHERE sha256(text) NOT IN (SELECT sha256(text) FROM chunks WHERE ordinal = 0)")
def vector_reuse(spark, sf_dir):
    """Texts to embed when the first chunk of every file is in the cache."""
    c = chunks(spark, sf_dir).withColumn("text_hash", F.sha2("text", 256))
    cache = c.where("ordinal = 0").select("text_hash", F.lit("m").alias("model")).distinct()
    return refresh.missing_vectors(c, cache, "m").select("text_hash")


@query(f"""WITH {SOURCES_SQL}, h AS (SELECT substr(sha256(path), 1, 2) AS g, path, sha256(concat_ws(chr(10), path, content_hash, byte_count::VARCHAR, round(mtime * 1e6)::BIGINT::VARCHAR, project, root_label)) AS h FROM sources),
i AS (SELECT g, sha256(string_agg(h, chr(10) ORDER BY path)) AS h FROM h GROUP BY g) SELECT sha256(string_agg(h, chr(10) ORDER BY g)) AS digest FROM i""")
def manifest_digest(spark, sf_dir):
    return refresh.manifest_digest(sources(spark, sf_dir))


@query(f"""WITH {SOURCES_SQL}, {_OLD_SQL} SELECT k.path, CASE WHEN s.path IS NULL THEN 'stale' WHEN k.content_hash != s.content_hash THEN 'weak' WHEN k.mtime % 10 = 3 THEN 'rebuilt' ELSE 'strong' END AS verdict FROM known k LEFT JOIN seen s USING (path)""")
def trust_verdicts(spark, sf_dir):
    known, disk = _states(spark, sf_dir)
    hits = known.withColumn("indexed_at", F.when(F.col("mtime") % 10 == 3, 2_000_000_000.0).otherwise(F.col("mtime")))
    return trust.verdicts(hits, disk, 2_000_000_000.0).select("path", "verdict")


@query(f"""WITH {SOURCES_SQL}, {_OLD_SQL}, j AS (SELECT coalesce(k.path, s.path) AS path, k.path AS kp, s.path AS sp, k.content_hash AS kh, s.content_hash AS sh, s.doc_id FROM known k FULL JOIN seen s ON k.path = s.path)
SELECT path, 'ghost' AS kind FROM j WHERE sp IS NULL UNION ALL SELECT path, 'ownership' FROM j WHERE kp IS NOT NULL AND doc_id % 23 = 0
UNION ALL SELECT path, 'orphan' FROM j WHERE kp IS NOT NULL AND sp IS NOT NULL AND NOT (path LIKE '/corpus/src1/%' OR path LIKE '/corpus/src0/%')
UNION ALL SELECT path, 'hash_drift' FROM j WHERE kh != sh UNION ALL SELECT path, 'unindexed' FROM j WHERE kp IS NULL AND doc_id % 3 != 2""")
def drift_findings(spark, sf_dir):
    known, seen = _states(spark, sf_dir)
    i = F.col("doc_id")
    disk = seen.withColumns({"uid": F.when(i % 23 == 0, 0).otherwise(1000), "walked": i % 3 != 2, "refused": F.lit(False)})
    return trust.drift(known, disk, ["/corpus/src0", "/corpus/src1"], 1000)


@query(f"WITH {SOURCES_SQL} SELECT project, count(*) AS files FROM sources GROUP BY project ORDER BY files DESC, project LIMIT 15")
def top_projects(spark, sf_dir):
    return sources(spark, sf_dir).groupBy("project").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "project").limit(15)


@query(f"""WITH {SOURCES_SQL}, e AS (SELECT path, CASE WHEN doc_id % 29 = 0 THEN '' ELSE project END AS project, mtime, CASE WHEN doc_id % 5 = 0 AND nxt IS NOT NULL THEN nxt END AS overridden_by, CASE WHEN doc_id % 31 = 0 THEN 'odd' ELSE 'distractor' END AS tag
  FROM (SELECT *, lead(path) OVER (PARTITION BY project ORDER BY path) AS nxt FROM sources) WHERE doc_id % 7 != 0), f AS (SELECT path FROM sources WHERE doc_id % 19 != 0)
SELECT path, 'missing file' AS problem FROM e WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT path, 'unmanifested corpus file' FROM f WHERE path NOT IN (SELECT path FROM e)
UNION ALL SELECT path, 'missing field ''project''' FROM e WHERE project = '' UNION ALL SELECT path, 'unknown tags' FROM e WHERE tag = 'odd'
UNION ALL SELECT path, 'override missing from manifest' FROM e WHERE overridden_by IS NOT NULL AND overridden_by NOT IN (SELECT path FROM e)
UNION ALL SELECT e.path, 'not older than its override' FROM e JOIN e o ON e.overridden_by = o.path WHERE e.mtime >= o.mtime""")
def manifest_validate(spark, sf_dir):
    from pyspark.sql.window import Window

    i = F.col("doc_id")
    s = sources(spark, sf_dir).withColumn("nxt", F.lead("path").over(Window.partitionBy("project").orderBy("path")))
    entries = s.where(i % 7 != 0).select("path", F.when(i % 29 == 0, "").otherwise(F.col("project")).alias("project"), "mtime", F.when(i % 5 == 0, F.col("nxt")).alias("overridden_by"), F.array(F.when(i % 31 == 0, "odd").otherwise("distractor")).alias("planted"))
    return evaluation.manifest_problems(entries, s.where(i % 19 != 0).select("path"), ["distractor"])


# evaluation ------------------------------------------------------------------------------------

_METRICS_SQL = """ideal AS (SELECT query_id, path, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, path) AS i FROM qrels),
metrics AS (SELECT query_id, CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_1, CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_5, CASE WHEN f <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_10, coalesce(1.0::DOUBLE / f, 0.0) AS mrr_10, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END AS ndcg_10
FROM (SELECT query_id, min(rank) FILTER (grade >= 1) AS f, coalesce(sum((2 ** grade - 1) / log2(rank + 1)), 0.0) AS dcg, coalesce(sum((2 ** grade - 1) / log2(i + 1)) FILTER (i <= 10), 0.0) AS ideal FROM ideal LEFT JOIN ranked USING (query_id, path) GROUP BY query_id))"""


def _ranked_sql(policy: ranking.Policy) -> str:
    return f"WITH {SOURCES_SQL}, {QUESTIONS_SQL}, {QRELS_SQL}, ranked AS (SELECT query_id, rank, path FROM ({_rank_sql(policy)})), {_METRICS_SQL}"


_BM25_POLICY = ranking.Policy("bm25", "keyword", 0.0)


def _metrics(spark, sf_dir, policy=_BM25_POLICY):
    return evaluation.per_query(_ranked(spark, sf_dir, policy), qrels(spark, sf_dir))


@query(f"{_ranked_sql(_BM25_POLICY)} SELECT query_id, recall_1, recall_5, recall_10, round(mrr_10, 6) AS mrr_10, round(ndcg_10, 6) AS ndcg_10 FROM metrics")
def retrieval_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", "recall_1", "recall_5", "recall_10", F.round("mrr_10", 6).alias("mrr_10"), F.round("ndcg_10", 6).alias("ndcg_10"))


@query(f"""{_ranked_sql(_BM25_POLICY)}, c AS (SELECT *, 'c' || query_id % 4 AS category FROM metrics)
SELECT coalesce(category, 'overall') AS category, count(*) AS n_queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in evaluation.METRICS)} FROM c GROUP BY GROUPING SETS ((category), ())""")
def metrics_by_category(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("category", F.concat(F.lit("c"), (F.col("query_id") % 4).cast("string")))
    return evaluation.means(m, "category")


@query()
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap(_metrics(spark, sf_dir))


@query()
def paired_delta(spark, sf_dir):
    return evaluation.paired_delta(_metrics(spark, sf_dir, ranking.Policy()), _metrics(spark, sf_dir), "mrr_10")


@query("SELECT event_type, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.95), 2) AS p95, round(avg(value), 2) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return evaluation.latency(table(spark, sf_dir, "events"), "value", "event_type")


@query("""SELECT query_id, CASE WHEN (6 * list_sum(list_transform(range(1, 64), lambda i: instr('0123456789abcdef', substr(h, i::INT, 1)) - 1)) + instr('0123456789abcdef', substr(h, 64, 1)) - 1) % 10 < 3 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT query_id, sha256(query_id) AS h FROM (SELECT 'q-' || lpad(item_id::VARCHAR, 3, '0') AS query_id FROM benchmark))""")
def split_assignment(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q-"), F.lpad(F.col("item_id").cast("string"), 3, "0")).alias("query_id"))
    return q.select("query_id", T.split_of(F.col("query_id")).alias("split"))


from . import upkeep  # noqa: E402, F401  registers its queries here
