import collections

import pytest

from tessera.llm import graph, minhash


def brute(rows, words, num, den):
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter()
        for g in s:
            shared.update(held[g])
            held[g].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[root(i)] = min(low.get(root(i), 1 << 60), r.doc_id)
    return sorted(str((r.doc_id, len(sets[i]), low.get(root(i)), r.doc_id == low.get(root(i)))) for i, r in enumerate(rows))


def found(docs, forest):
    return sorted(str(tuple(r)) for r in minhash.near_duplicates(docs, forest).drop("text_key").collect())


@pytest.mark.parametrize("words,num", [(3, 85), (5, 80)])
def test_against_brute_force(spark, small, odd_docs, words, num):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd_docs, allowMissingColumns=True)
    assert found(docs, minhash.Forest(words=words, num=num)) == brute(docs.select("doc_id", "text").collect(), words, num, 100)


def test_a_dense_group_around_the_threshold(spark):
    """Copies with a few changed words each: most pairs lie just below the threshold and some above."""
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = minhash.Forest(words=3, num=85)
    assert found(docs, forest) == brute(docs.collect(), 3, 85, 100)


def test_blocks_find_a_spanning_forest():
    import numpy as np

    sets = [np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(900, 1000, dtype=np.uint64)]
    forest = minhash.Forest(num=90)
    assert minhash.forest(sets, None, forest) == [(0, 1), (1, 2)]
    assert minhash.forest(sets[:1], sets[1:], forest) == [(0, 1)]


@pytest.mark.parametrize("share", [250_000, 40])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", share)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{x: 100 for x in range(100, 140)}, 200: 200, 201: 200}


def test_empty_table(spark, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_texts_are_read_for_sets_once_and_for_all_members(spark, small, monkeypatch):
    made, real = [], minhash._sets
    monkeypatch.setattr(minhash, "_sets", lambda *a: made.append(1) or real(*a))
    minhash.near_duplicates(spark.read.parquet(f"{small}/documents.parquet"), minhash.Forest(words=3, num=85))
    assert len(made) == 1


def test_small_tasks_keep_their_memory_and_their_errors(monkeypatch):
    import pyarrow as pa

    from tessera.llm import common

    trims = []
    monkeypatch.setattr(common.gc, "collect", lambda: trims.append(1))

    def failing(batches):
        for batch in batches:
            yield batch
            raise ValueError("a task's own error")

    few = pa.RecordBatch.from_pydict({"a": [1, 2, 3]})
    with pytest.raises(ValueError, match="own error"):
        list(common.lean(failing)(iter([few])))
    assert not trims
    many = pa.RecordBatch.from_pydict({"a": list(range(200_000))})
    assert len(list(common.lean(iter)(iter([many])))) == 1 and trims
