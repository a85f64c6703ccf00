import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import baselines, evaluation, index, ranking
from tessera.operators.ranking import Policy

CHUNKS = [
    ("/c/p1/a.md", 0, "kiln fires at cone six kiln", "p1", "c", 100.0),
    ("/c/p1/a.md", 1, "glaze notes", "p1", "c", 100.0),
    ("/c/p1/b.md", 0, "retry the dropped socket", "p1", "c", 200.0),
    ("/c/p2/kiln.md", 0, "nothing here", "p2", "c", 300.0),
    ("/c/p2/z.md", 0, "...", "p2", "c", 50.0),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "path string, ordinal int, text string, project string, root_label string, mtime double").cache()


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")


def cells(spark, lexical, similarity):
    return spark.createDataFrame([(0, "p", i, float(a), float(b)) for i, (a, b) in enumerate(zip(lexical, similarity))], "query_id int, path string, ordinal int, lexical double, similarity double")


def test_bm25_by_the_formula(spark, chunks):
    got = {(r.path, r.ordinal): r for r in ranking.bm25(asked(spark, "the kiln kiln glaze"), chunks).collect()}
    n, avgdl = 5, (6 + 2 + 4 + 2 + 0) / 5
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    kiln = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 6 / avgdl))
    assert abs(got["/c/p1/a.md", 0].lexical - kiln) < 1e-8 and got["/c/p1/a.md", 0].coverage == 0.5
    assert set(got) == {("/c/p1/a.md", 0), ("/c/p1/a.md", 1)}
    assert index.statistics(chunks).first().avgdl == avgdl


def test_fusion_orders(spark):
    order = lambda df: [r.ordinal for r in df.orderBy(F.desc("relevance"), "ordinal").collect()]
    assert order(ranking.fuse(cells(spark, [0, 0.3, 0.2], [0.9, 0.2, 0.1]), Policy(fusion="rrf", dense_weight=0.5))) == [1, 0, 2]
    both = cells(spark, [1, 10], [0.80, 0.70])
    assert order(ranking.fuse(both, Policy(fusion="raw", dense_weight=0.55))) == [1, 0]
    assert order(ranking.fuse(both, Policy(fusion="minmax", dense_weight=0.55))) == [0, 1]
    flat = ranking.fuse(cells(spark, [0, 0], [0.5, 0.5]), Policy(fusion="minmax", dense_weight=1.0)).collect()
    assert [r.relevance for r in flat] == [0.0, 0.0]
    assert all(math.isfinite(r.relevance) for r in ranking.fuse(cells(spark, [0, 0], [0.5, 0.5]), Policy()).collect())
    with pytest.raises(ValueError):
        ranking.fuse(both, Policy(fusion="odd"))


def test_keyword_search_needs_a_term_in_text_or_path(spark, chunks):
    got = ranking.rank(asked(spark, "kiln"), chunks, Policy("bm25", "keyword", 0.0)).orderBy("rank").collect()
    assert [(r.rank, r.path) for r in got] == [(1, "/c/p1/a.md"), (2, "/c/p2/kiln.md")]
    assert ranking.rank(asked(spark, "zzz"), chunks, Policy("bm25", "keyword", 0.0)).count() == 0


def test_project_filter_keeps_scores(spark, chunks):
    q = asked(spark, "kiln glaze")
    v, q = index.hashed_vectors(chunks, index.KEYS), q.join(index.hashed_vectors(q, ["query_id"], "question"), "query_id")
    whole = {r.path: r.score for r in ranking.rank(q, chunks, Policy(rerank_budget=0), None, v).collect()}
    part = {r.path: r.score for r in ranking.rank(q, chunks, Policy(rerank_budget=0), "P2", v).collect()}
    assert set(part) == {"/c/p2/kiln.md", "/c/p2/z.md"} and all(whole[p] == s for p, s in part.items())
    assert ranking.rank(q, chunks, Policy(), "nowhere", v).count() == 0


def test_one_chunk_a_file_and_top_k(spark, chunks):
    q = asked(spark, "kiln glaze")
    v, q = index.hashed_vectors(chunks, index.KEYS), q.join(index.hashed_vectors(q, ["query_id"], "question"), "query_id")
    got = ranking.rank(q, chunks, Policy(top_k=2), None, v).collect()
    assert len(got) == 2 and len({r.path for r in got}) == 2
    assert [ranking.clamp_top_k(x) for x in (None, 0, -5, 7, 99)] == [10, 10, 1, 7, 50]


def test_term_weights_include_stopwords_and_unseen_terms(spark, chunks):
    got = {r.term: r.weight for r in ranking.term_weights(asked(spark, "the kiln zzz"), chunks).collect()}
    assert abs(got["zzz"] - math.log(1 + 5.5 / 0.5)) < 1e-9 and set(got) == {"the", "kiln", "zzz"}


def test_scanning_baselines(spark):
    files = spark.createDataFrame([("a/retries.md", "retries\nretry\nretry"), ("b.md", "retry socket"), ("c.md", "Straße")], "path string, text string")
    got = baselines.scan_rank(asked(spark, "retry socket", "strasse", "the of"), files).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.path, r.matched, r.lines) for r in got] == [(0, "b.md", 2, 1), (0, "a/retries.md", 1, 2), (1, "c.md", 1, 1)]
    assert [r.path for r in baselines.path_rank(asked(spark, "retries"), files).collect()] == ["a/retries.md"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b"), (2, 1, "q")], "query_id int, rank int, path string")
    qrels = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 1), (2, "z", 2), (3, "q", 0)], "query_id int, path string, grade int")
    got = {r.query_id: r for r in evaluation.per_query(ranked, qrels).collect()}
    ideal = 3 + 1 / math.log2(3) + 1 / 2
    assert (got[1].recall_1, got[1].recall_5, got[1].mrr_10) == (0.0, 1.0, 0.5) and abs(got[1].ndcg_10 - (3 / math.log2(3) + 1 / 2) / ideal) < 1e-9
    assert (got[2].recall_10, got[2].ndcg_10, got[3].ndcg_10) == (0.0, 0.0, 0.0)


def test_intervals_equal_a_plain_bootstrap(spark):
    import random

    values = [0.0, 1.0, 0.5, 0.25, 1.0]
    rows = spark.createDataFrame([(i, *[v] * 5) for i, v in enumerate(values)], "query_id int, " + ", ".join(f"{m} double" for m in evaluation.METRICS))
    rng = random.Random(7)
    means = sorted(sum(values[rng.randrange(5)] for _ in range(5)) / 5 for _ in range(200))
    got = {r.metric: (r.low, r.high) for r in evaluation.bootstrap(rows, samples=200, seed=7).collect()}
    alpha = (1 - 0.95) / 2
    assert got["mrr_10"] == (round(means[max(0, math.ceil(alpha * 200) - 1)], 4), round(means[min(199, math.floor((1 - alpha) * 200))], 4))
    delta = evaluation.paired_delta(rows, rows.withColumn("mrr_10", F.col("mrr_10") - 0.25), "mrr_10", 100).first()
    assert (delta.mean_delta, delta.low, delta.high, delta.a_wins, delta.n) == (0.25, 0.25, 0.25, 5, 5)


def test_latency_is_nearest_rank(spark):
    got = evaluation.latency(spark.createDataFrame([(float(x),) for x in range(1, 101)], "ms double"), "ms").first()
    assert (got.p50, got.p95, got.mean) == (50.0, 95.0, 50.5)


def test_problems_of_labelled_queries(spark):
    q = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", ""), ("c", "x")], "query_id string, category string")
    r = spark.createDataFrame([("a", "p", 2), ("b", "lost", 1), ("b", "p", 3)], "query_id string, path string, grade int")
    got = sorted(x.problem for x in evaluation.query_problems(q, r, spark.createDataFrame([("p",)], "path string")).collect())
    assert got == ["duplicate id", "grade not 1 or 2: p", "missing category", "no labels", "unknown path: lost"]


def _plain(spark, rows, questions):
    """A corpus and its questions, with the stored vectors that lead rank() past the blocks."""
    c = spark.createDataFrame(rows, "path string, ordinal int, text string, project string, root_label string, mtime double")
    q = asked(spark, *questions)
    return c, q, q.join(index.hashed_vectors(q, ["query_id"], "question"), "query_id"), index.hashed_vectors(c, index.KEYS)


def _odd_corpus():
    """Many equal texts, files of many chunks, letters that lower() would turn into a-z, empty texts, two roots."""
    rows = [(f"/c/p{i % 3}/same-{i:03}.md", 0, "kiln glaze cone", f"p{i % 3}", "c", 100.0 + i % 7) for i in range(90)]
    rows += [("/c/p1/long.md", i, f"glaze kiln n{i} Kiln İ" + " pad" * (i % 9), "p1", "c", 50.0) for i in range(70)]
    return rows + [("/d/x/Kiln.v2.md", 0, "", "D", "d", 900.0), ("/d/y/z", 0, "Retry_the SOCKET", None, "d", 1.0)]


_ODD_QUESTIONS = ["kiln glaze", "the of", "", "zzz", "retry_the socket D kiln", "cone cone n7"]


def test_blocks_rank_as_joins_do(spark):
    c, q, with_vectors, v = _plain(spark, _odd_corpus(), _ODD_QUESTIONS)
    policies = [Policy("raw", "raw", 0.55), Policy("minmax", "minmax", 0.4), Policy("flat", "raw", 1.0, recency_weight=0.0, metadata_weight=0.0, rerank_budget=3, top_k=5)]
    rows = lambda df: sorted(map(str, df.collect()))
    for project in (None, "P1"):
        assert rows(ranking.rank(q, c.repartition(5), policies, project)) == rows(ranking.rank(with_vectors, c, policies, project, v))


def test_keyword_pairs_do_not_shuffle(spark):
    from tessera.operators import scoring

    c, q, _, _ = _plain(spark, _odd_corpus(), _ODD_QUESTIONS)
    policy = Policy("bm25", "keyword", 0.0, rerank_budget=2, top_k=3)
    # one task hands on the head and the open files of each question only
    asked_ = scoring.Asked(q)
    made = scoring.blocks(c.coalesce(1), asked_, False)
    corpus = scoring.Corpus(made, asked_)
    few = scoring.candidates(made, asked_, corpus, [policy], scoring.extremes(made, asked_, corpus, False)).count()
    assert 0 < few <= 6 * (2 + 5) < c.count()


def test_spread_from_blocks_equals_joins(spark):
    c, q, with_vectors, v = _plain(spark, _odd_corpus(), _ODD_QUESTIONS)
    rows = lambda df: sorted((r.query_id, round(r.dense_spread, 9), round(r.lexical_spread, 9)) for r in df.collect())
    assert rows(ranking.score_spread(q, c.repartition(5))) == rows(ranking.score_spread(with_vectors, c, v))


def test_labels_do_not_shuffle_texts(spark, tmp_path):
    import duckdb
    from tessera.plans import corpora

    start = "one two three four five six seven eight nine ten"
    docs = [(1, f"a {start} b", "x", "en"), (2, start[:44], "x", "en"), (3, None, "x", "en"), (4, "tiny", "x", "en"), (5, "", "x", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, start), (8, "tiny"), (9, None), (10, "one  two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpora.qrels(spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(f"WITH {corpora.SOURCES_SQL}, {corpora.QUESTIONS_SQL}, {corpora.QRELS_SQL} SELECT query_id, path, grade FROM qrels").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 3


def test_blocks_rank_by_place_as_joins_do(spark, monkeypatch):
    from tessera.operators import scoring

    c, q, with_vectors, v = _plain(spark, _odd_corpus(), _ODD_QUESTIONS)
    policies = [Policy("rrf", "rrf", 0.5, rrf_k=1, rerank_budget=3, top_k=4), Policy("near", "rrf", 1.0, rrf_k=1, rerank_budget=0, top_k=3), Policy("raw", "raw", 0.55)]
    rounds, plain = [], scoring._reach
    monkeypatch.setattr(scoring, "DEPTH", 3)
    monkeypatch.setattr(scoring, "_reach", lambda *x: rounds.append(x) or plain(*x))
    rows = lambda df: sorted(map(str, df.collect()))
    for project in (None, "P2"):
        rounds.clear()
        assert rows(ranking.rank(q, c.repartition(5), policies, project)) == rows(ranking.rank(with_vectors, c, policies, project, v))
        assert len(rounds) > 2  # three chunks do not prove the answers: more were taken
