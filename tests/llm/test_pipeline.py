import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import bpe, toxicity


def minhash_brute(rows, words, num, den):
    """Smallest id of each row's near-duplicate component."""
    sets, parent = [], list(range(len(rows)))
    for r in rows:
        w = (r.text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            n = len(s & sets[j])
            if n and den * n >= num * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[root(i)] = min(low.get(root(i), 1 << 60), r.doc_id)
    return [low.get(root(i)) for i in range(len(rows))]


def test_stages_against_brute_force(spark, small, odd_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 100_000), allowMissingColumns=True)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    columns = docs.columns
    steps = dict(pipeline.STAGES)
    kept = pipeline.stage(steps["toxicity"](spark, docs, small), "t")
    assert kept.columns == columns
    one = toxicity.scorer(toxicity.fit(docs, labels))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if one(r.text or "") < 0.5)

    before, kept = kept.collect(), pipeline.stage(steps["near_duplicates"](spark, kept, small), "n")
    assert kept.columns == columns
    low = minhash_brute(before, 5, 80, 100)
    want = {(r.doc_id, r.text) for r, c in zip(before, low) if r.doc_id == c}
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in kept.collect())

    before, kept = kept.collect(), pipeline.stage(steps["decontamination"](spark, kept, small), "d")
    assert kept.columns == columns

    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [shingles(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = [r for r in before if not any(y and 100 * len(y & shingles(r.text)) >= 80 * len(y) for y in items)]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in clean)

    before, kept = {r.doc_id: r for r in kept.collect()}, pipeline.stage(steps["secrets"](spark, kept, small), "s")
    assert kept.columns == columns and kept.count() == len(before)
    for r in kept.collect():
        if "[secret:" in (r.text or "") or "[example:" in (r.text or ""):
            assert not re.search(r"(?i)(password|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{8}|[0-9a-f]{32}", r.text)
            assert r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id].text

    ids = {r.doc_id: r for r in steps["bpe"](spark, kept, small).collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in kept.collect():
        assert ids[r.doc_id].ids_sha256 == hashlib.sha256(np.array(enc.encode_ordinary(r.text or ""), dtype="<u4").tobytes()).hexdigest()


def test_a_contaminated_row_takes_no_other_row_of_its_id_along(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    rows = [(None, f"before {item} after", "en", "s", 1), (None, "a clean text of its own", "en", "s", 1), (7, item, "en", "s", 1), (7, "another clean text", "en", "s", 1), (8, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.remove_contaminated(spark, docs, small).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(None, "a clean text of its own"), (7, "another clean text"), (8, None)]))


def _text_exchanges(df) -> int:
    """Exchanges with texts in the plan that ran; reused ones do not count."""
    jvm = df.sparkSession._jvm
    plan = df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    ran = plan.split("Initial Plan")[0] + plan[plan.index("\n(1)") :]
    shown = set(re.findall(r"(?<!Reused)Exchange \((\d+)\)", ran.split("\n(1)")[0]))
    return sum(bool(re.search(r"\btext#", line)) for n, line in re.findall(r"\((\d+)\) Exchange\nInput \[\d+\]: (.*)", plan) if n in shown)


def test_near_duplicates_shuffle_the_texts_once_and_keep_one_of_repeated_rows(spark, odd_docs):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = pipeline.remove_near_duplicates(spark, odd_docs, "")
        got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((str(r.doc_id), r.text) for r in got.collect() if r.text and "quick" in r.text) == [("3", next(r.text for r in odd_docs.collect() if r.doc_id == 3))]
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "4", "5", "7", "8", "9"]
    assert _text_exchanges(got) <= 2  # the texts, and those of the repeated rows


def test_run_and_empty_tables(spark, small, no_docs):
    assert pipeline.run(spark, small).count() > 0
    docs = no_docs
    for name, step in pipeline.STAGES:
        docs = step(spark, docs, small)
        assert docs.count() == 0, name
