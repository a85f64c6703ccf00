"""Registered queries of upkeep, checks and sweeps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation, index, ranking, refresh, selection
from . import catalogue as C
from .corpora import CHUNKS_SQL, QRELS_SQL, QUESTIONS_SQL, SOURCES_SQL, chunks, qrels, questions, sources, table

# maintenance of the tables ---------------------------------------------------------------------


@C.query(f"WITH {SOURCES_SQL}, p AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'shared' ELSE 'local_owner_only' END AS permissions FROM sources) SELECT path, project FROM p WHERE permissions IN ('local_owner_only')")
def permission_filter(spark, sf_dir):
    marked = sources(spark, sf_dir).withColumn("permissions", F.when(F.col("doc_id") % 10 == 0, "shared").otherwise("local_owner_only"))
    return marked.where(F.col("permissions").isin("local_owner_only")).select("path", "project")


@C.query(f"{C._DIFF_SQL} SELECT path, content_hash, byte_count, mtime, project FROM seen UNION ALL SELECT path, content_hash, byte_count, mtime, project FROM known WHERE path IN (SELECT path FROM changes WHERE status = 'orphan_kept')")
def next_sources(spark, sf_dir):
    known, seen = C._states(spark, sf_dir)
    columns = ["path", "content_hash", "byte_count", "mtime", "project"]
    return refresh.next_sources(known.select(columns), seen.select(columns), C._changes(spark, sf_dir))


@C.query(f"""{C._DIFF_SQL.replace(SOURCES_SQL, CHUNKS_SQL)}, old AS (SELECT path, ordinal, sha256(text) AS text_hash FROM chunks WHERE path IN (SELECT path FROM known)),
fresh AS (SELECT path, ordinal, sha256(text) AS text_hash FROM chunks WHERE path IN (SELECT path FROM changes WHERE status IN ('added', 'reindexed')))
SELECT * FROM old WHERE path NOT IN (SELECT path FROM changes WHERE status IN ('added', 'reindexed', 'removed')) UNION ALL SELECT * FROM fresh""")
def next_chunks(spark, sf_dir):
    known, _ = C._states(spark, sf_dir)
    changes = C._changes(spark, sf_dir)
    cut = chunks(spark, sf_dir).select("path", "ordinal", F.sha2("text", 256).alias("text_hash"))
    fresh = cut.join(changes.where(F.col("status").isin("added", "reindexed")), "path", "left_semi")
    return refresh.next_chunks(cut.join(known, "path", "left_semi"), fresh, changes)


_CACHE_SQL = f"""WITH {CHUNKS_SQL}, c AS (SELECT DISTINCT sha256(text) AS text_hash, ordinal = 0 AS first FROM chunks),
cache AS (SELECT DISTINCT text_hash, 'm' AS model, CASE WHEN substr(text_hash, 1, 1) < '8' THEN 100.0 ELSE 2000000.0 END AS last_used FROM c WHERE first),
new AS (SELECT DISTINCT text_hash, 'm' AS model FROM c WHERE substr(text_hash, 2, 1) < '8')"""


def _cache(spark, sf_dir):
    cut = chunks(spark, sf_dir).select(F.sha2("text", 256).alias("text_hash"), "ordinal")
    used = F.when(F.substring("text_hash", 1, 1) < "8", 100.0).otherwise(2_000_000.0)
    cache = cut.where("ordinal = 0").select("text_hash", F.lit("m").alias("model"), used.alias("last_used")).distinct()
    return cache, cut.where(F.substring("text_hash", 2, 1) < "8").select("text_hash", F.lit("m").alias("model")).distinct()


@C.query(f"""{_CACHE_SQL} SELECT text_hash, model, CASE WHEN (text_hash, model) IN (SELECT (text_hash, model) FROM new) THEN 3000000.0 ELSE last_used END AS last_used FROM cache
UNION ALL SELECT text_hash, model, 3000000.0 FROM new WHERE text_hash NOT IN (SELECT text_hash FROM cache)""")
def vector_cache_store(spark, sf_dir):
    cache, new = _cache(spark, sf_dir)
    return refresh.store_vectors(cache, new, 3_000_000.0)


@C.query(f"{_CACHE_SQL} SELECT text_hash, model, last_used FROM cache WHERE last_used >= 2000000.0 - 86400 OR text_hash IN (SELECT text_hash FROM new)")
def vector_cache_prune(spark, sf_dir):
    cache, new = _cache(spark, sf_dir)
    return refresh.prune_vectors(cache, 2_000_000.0, 1, new)


@C.query(f"WITH {SOURCES_SQL} SELECT DISTINCT project FROM sources")
def project_labels(spark, sf_dir):
    return sources(spark, sf_dir).select("project").distinct()


_BELOW_SQL = "CASE doc_id % 7 WHEN 0 THEN 'README.md' WHEN 1 THEN 'a/State.md' WHEN 2 THEN 'a/docs/x.md' WHEN 3 THEN 'a/b/docs/x.md' WHEN 4 THEN 'my-HANDOFF-1.txt' WHEN 5 THEN 'a/b/readme.md' ELSE 'a/specs/next-push.md' END"


@C.query(f"SELECT doc_id, doc_id % 7 IN (0, 1, 4) AS locator, doc_id % 7 IN (2, 6) AS shallow FROM (SELECT doc_id, {_BELOW_SQL} AS b FROM documents)")
def selection_flags(spark, sf_dir):
    locator, shallow = selection.flags(F.expr(_BELOW_SQL))
    return table(spark, sf_dir, "documents").select("doc_id", locator.alias("locator"), shallow.alias("shallow"))


@C.query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(ts) // 1000000 AS seconds FROM events")
def iso_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", T.iso_utc(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("iso"))
    return e.select("event_id", "iso", F.floor(T.parse_iso(F.col("iso"))).alias("seconds"))


@C.query("""SELECT vec_id, unnest(range(0, len(v)))::INTEGER AS pos, round(unnest(v) / CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS x
FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings))""")
def normalised_vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    return v.select("vec_id", F.posexplode(index.normalise(F.col("v"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


# chunks and snippets ---------------------------------------------------------------------------

_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_PACKED_SQL = rf"""WITH {SOURCES_SQL}, ps AS (SELECT path, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: {_STRIP('x')}), lambda x: x != '') AS ps FROM sources),
folded AS (SELECT path, list_reduce(list_prepend({{'out': []::VARCHAR[], 'cur': ''}}, list_transform(ps, lambda p: {{'out': []::VARCHAR[], 'cur': p}})), lambda a, x:
  CASE WHEN length(x.cur) > 1600 THEN {{'out': list_concat(CASE WHEN a.cur != '' THEN list_append(a.out, a.cur) ELSE a.out END,
      list_filter(list_transform(range(0, length(x.cur), 1420), lambda s: {_STRIP('substr(x.cur, s::INT + 1, 1600)')}), lambda w: w != '')), 'cur': ''}}
    WHEN length(CASE WHEN a.cur != '' THEN a.cur || chr(10) || chr(10) || x.cur ELSE x.cur END) <= 1600 THEN {{'out': a.out, 'cur': CASE WHEN a.cur != '' THEN a.cur || chr(10) || chr(10) || x.cur ELSE x.cur END}}
    ELSE {{'out': list_append(a.out, a.cur), 'cur': {_STRIP(_STRIP("right(a.cur, 180)") + " || chr(10) || chr(10) || x.cur")}}} END) AS f FROM ps),
made AS (SELECT path, CASE WHEN f.cur != '' THEN list_append(f.out, f.cur) ELSE f.out END AS pieces FROM folded),
rows AS (SELECT path, unnest(range(0, len(pieces)))::INTEGER AS ordinal, sha256(unnest(pieces)) AS text_hash FROM made)
SELECT path, ordinal, text_hash, substr(sha256(path || ':' || ordinal || ':' || text_hash), 1, 24) AS chunk_id FROM rows"""
C.SQL["chunk_packed"] = _PACKED_SQL

_LIMIT, _REACH = 240, 180
_SNIPPET_SQL = rf"""WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {C._BM25_SQL}, hits AS (SELECT query_id, path, ordinal FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, path, ordinal) <= 10),
ws AS (SELECT query_id, term, ln(1 + (n_chunks - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS weight FROM (SELECT DISTINCT query_id, unnest({C._tok('question')}) AS term FROM questions) LEFT JOIN df USING (term) CROSS JOIN stats),
lines AS (SELECT query_id, path, ordinal, {_STRIP(r"regexp_replace(text, '\s+', ' ', 'g')")} AS line FROM hits JOIN chunks USING (path, ordinal)),
cells AS (SELECT query_id, path, ordinal, unnest(range(0, len(toks))) AS no, unnest(gaps[1:len(toks)]) AS gap, unnest(toks) AS tok FROM (SELECT *, regexp_split_to_array(line, '{T.TOKEN}') AS gaps, regexp_extract_all(line, '{T.TOKEN}') AS toks FROM lines)),
placed AS (SELECT query_id, path, ordinal, lower(tok) AS term, sum(length(gap) + length(tok)) OVER (PARTITION BY query_id, path, ordinal ORDER BY no)::INTEGER - length(tok) AS b FROM cells),
found AS (SELECT placed.*, weight FROM placed JOIN ws USING (query_id, term) WHERE length(term) > 2),
worth AS (SELECT query_id, path, ordinal, b, round(sum(weight), 9) AS worth FROM (SELECT DISTINCT x.query_id, x.path, x.ordinal, x.b, y.term, y.weight FROM found x JOIN found y ON x.query_id = y.query_id AND x.path = y.path AND x.ordinal = y.ordinal AND y.b >= x.b AND y.b < x.b + {_REACH}) GROUP BY ALL),
anchors AS (SELECT query_id, path, ordinal, b AS anchor FROM worth QUALIFY row_number() OVER (PARTITION BY query_id, path, ordinal ORDER BY worth DESC, b) = 1),
l0 AS (SELECT *, greatest(0, least(anchor - {_LIMIT - _REACH}, length(line) - {_LIMIT})) AS lead0 FROM lines LEFT JOIN anchors USING (query_id, path, ordinal)),
l1 AS (SELECT *, CASE WHEN lead0 > 0 AND instr(substr(line, lead0 + 1, anchor - lead0), ' ') > 0 THEN lead0 + instr(substr(line, lead0 + 1, anchor - lead0), ' ') ELSE lead0 END AS lead1 FROM l0),
l2 AS (SELECT *, CASE WHEN lead1 + {_LIMIT} < length(line) THEN regexp_replace(substr(line, lead1 + 1, {_LIMIT}), ' [^ ]*$', '') ELSE substr(line, lead1 + 1, {_LIMIT}) END AS shown FROM l1)
SELECT query_id, path, ordinal, CASE WHEN length(line) <= {_LIMIT} THEN line WHEN anchor IS NULL THEN rtrim(substr(line, 1, {_LIMIT})) || '…'
  ELSE CASE WHEN lead1 > 0 THEN '…' ELSE '' END || trim(shown) || CASE WHEN lead1 + length(shown) < length(line) THEN '…' ELSE '' END END AS snippet FROM l2"""
C.SQL["snippet_texts"] = _SNIPPET_SQL

# checks and sweeps -----------------------------------------------------------------------------


@C.query("""SELECT split, count(*) AS queries FROM (SELECT CASE WHEN (6 * list_sum(list_transform(range(1, 64), lambda i: instr('0123456789abcdef', substr(h, i::INT, 1)) - 1)) + instr('0123456789abcdef', substr(h, 64, 1)) - 1) % 10 < 3 THEN 'dev' ELSE 'test' END AS split
FROM (SELECT sha256('q-' || lpad(item_id::VARCHAR, 3, '0')) AS h FROM benchmark)) GROUP BY split""")
def split_counts(spark, sf_dir):
    return C.split_assignment(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("queries"))


@C.query(f"""WITH {SOURCES_SQL}, {QUESTIONS_SQL}, {QRELS_SQL}, q AS (SELECT query_id, CASE WHEN query_id % 5 = 0 THEN '' ELSE 'c' END AS category FROM questions UNION ALL SELECT query_id, 'c' FROM questions WHERE query_id % 7 = 0),
r AS (SELECT query_id, path, CASE WHEN query_id % 3 = 0 THEN 3 ELSE grade END AS grade FROM qrels WHERE query_id % 4 != 0), f AS (SELECT path FROM sources WHERE doc_id % 2 = 0)
SELECT query_id, 'duplicate id' AS problem FROM q GROUP BY query_id HAVING count(*) > 1 UNION ALL SELECT query_id, 'no labels' FROM q WHERE query_id NOT IN (SELECT query_id FROM r)
UNION ALL SELECT query_id, 'missing category' FROM q WHERE category = '' UNION ALL SELECT query_id, 'unknown path: ' || path FROM r WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT query_id, 'grade not 1 or 2: ' || path FROM r WHERE grade NOT IN (1, 2)""")
def label_problems(spark, sf_dir):
    i = F.col("query_id")
    named = questions(spark, sf_dir).select("query_id")
    asked = named.withColumn("category", F.when(i % 5 == 0, "").otherwise("c")).unionByName(named.where(i % 7 == 0).withColumn("category", F.lit("c")))
    labels = qrels(spark, sf_dir).where(i % 4 != 0).withColumn("grade", F.when(i % 3 == 0, 3).otherwise(F.col("grade")))
    return evaluation.query_problems(asked, labels, sources(spark, sf_dir).where("doc_id % 2 = 0").select("path"))


def _with_metrics(policy: ranking.Policy, name: str) -> str:
    ranked = f"{name}_ranked AS (SELECT query_id, rank, path FROM ({C._rank_sql(policy)}))"
    metrics = C._METRICS_SQL.replace("ideal AS (", f"{name}_ideal AS (", 1).replace("metrics AS (", f"{name}_metrics AS (", 1).replace("FROM ideal LEFT JOIN ranked", f"FROM {name}_ideal LEFT JOIN {name}_ranked")
    return f"{ranked}, {metrics}"


@C.query(f"""WITH {SOURCES_SQL}, {QUESTIONS_SQL}, {QRELS_SQL}, {_with_metrics(ranking.Policy(), 'a')}, {_with_metrics(C._BM25_POLICY, 'b')},
d AS (SELECT a.mrr_10 - b.mrr_10 AS d FROM a_metrics a JOIN b_metrics b USING (query_id))
SELECT round(avg(d), 4) AS mean_delta, count(*) FILTER (d > 0) AS a_wins, count(*) FILTER (d < 0) AS b_wins, count(*) FILTER (d = 0) AS ties, count(*) AS n FROM d""")
def paired_counts(spark, sf_dir):
    return evaluation.paired_counts(C._metrics(spark, sf_dir, ranking.Policy()), C._metrics(spark, sf_dir), "mrr_10")


_MEANS_SQL = f"""WITH {SOURCES_SQL}, {QUESTIONS_SQL}, {QRELS_SQL}, cells AS ({C.SQL['sweep_grid']}), names AS (SELECT DISTINCT policy_id FROM cells),
ideal AS (SELECT query_id, path, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, path) AS i FROM qrels),
met AS (SELECT policy_id, query_id, min(rank) FILTER (grade >= 1) AS f, coalesce(sum((2 ** grade - 1) / log2(rank + 1)), 0.0) AS dcg, coalesce(sum((2 ** grade - 1) / log2(i + 1)) FILTER (i <= 10), 0.0) AS ideal
  FROM ideal CROSS JOIN names LEFT JOIN cells USING (policy_id, query_id, path) GROUP BY policy_id, query_id),
means AS (SELECT policy_id, count(*) AS n_queries, round(avg(CASE WHEN f <= 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN f <= 10 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall_10,
  round(avg(coalesce(1.0::DOUBLE / f, 0.0)), 6) AS mrr_10, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END), 6) AS ndcg_10 FROM met GROUP BY policy_id)"""


@C.query(f"{_MEANS_SQL} SELECT * FROM means ORDER BY mrr_10 DESC, recall_5 DESC, policy_id LIMIT 1")
def best_sweep_cell(spark, sf_dir):
    return evaluation.best_cell(evaluation.cell_means(C.sweep_grid(spark, sf_dir), qrels(spark, sf_dir)))
