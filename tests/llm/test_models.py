import math
import tracemalloc
import zlib

import numpy as np
import pytest

from tessera.llm import ctw, quality, queries, toxicity


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = int(label.sum())
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("name,label,mod,fold,least", [("op5_quality", "quality", 4, 2, 0.97), ("op7_toxicity", "toxic", 5, 0, 0.75)])
def test_held_out_ranking(spark, name, label, mod, fold, least):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % mod == fold for i in got.doc_id]
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= (0.7 if label == "quality" else 0.5))).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert auc(both.score.to_numpy(), both[label].to_numpy()) >= least


@pytest.mark.parametrize("module,column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_and_empty_tables(spark, odd_docs, no_docs, module, column):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        model = module.fit(odd_docs, labels)
        assert module.score(odd_docs, model).count() == odd_docs.count()
    assert module.score(no_docs, module.fit(no_docs, some)).count() == 0
    by_text = {}
    for r in module.score(odd_docs, module.fit(odd_docs, some)).join(odd_docs.select("doc_id", "text"), "doc_id").collect():
        assert by_text.setdefault(r.text or "", r.score) == r.score


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    emit, move, counts = rng.standard_normal(7), rng.standard_normal((2, 2)), np.array([3, 4])
    good, logz, _ = quality.marginals(emit, move, counts)
    at = 0
    for c, z in zip(counts, logz):
        total, mass = 0.0, np.zeros(c)
        for code in range(2**c):
            y = [(code >> i) & 1 for i in range(c)]
            p = math.exp(sum(emit[at + i] * y[i] for i in range(c)) + sum(move[y[i - 1], y[i]] for i in range(1, c)))
            total += p
            mass += p * np.array(y)
        assert np.allclose(good[at : at + c], mass / total) and abs(math.log(total) - z) < 1e-9
        at += c


def test_upper_case_share_is_of_all_words_of_a_line():
    features, _ = quality.own_features(["low " * 50 + "HIGH " * 150], np.zeros(1))
    assert features[0, len(quality._CLASSES) + 3] == 0.75


def chain_of(rng):
    return quality.Chain(rng.standard_normal(quality.WIDTH), rng.standard_normal((2, 2)), rng.standard_normal(quality.WIDTH), rng.random(quality.WIDTH) + 0.5, 0.7, 0.1)


def plain_score(chain, text):
    """One text at a time, features as one matrix, the chain in loops."""
    lines = text.split("\n")
    own, size = quality.own_features(lines, quality._repeated(lines))
    first, last = quality._ends(np.array([len(lines)]))
    emit = ((quality.with_neighbours(own, first, last) - chain.centre) / chain.spread) @ chain.weights
    m = np.exp(chain.move)
    pots = [np.array([1.0, math.exp(e)]) for e in emit]
    ahead, behind = [pots[0] / pots[0].sum()], [np.ones(2)]
    for p in pots[1:]:
        v = (ahead[-1] @ m) * p
        ahead.append(v / v.sum())
    for p in pots[:0:-1]:
        v = m @ (p * behind[-1])
        behind.append(v / v.sum())
    both = np.array(ahead) * np.array(behind[::-1])
    share = np.clip((both[:, 1] / both.sum(axis=1) * size).sum() / size.sum(), 1e-6, 1 - 1e-6)
    return 1 / (1 + math.exp(-(chain.slope * math.log(share / (1 - share)) + chain.offset)))


def test_scores_equal_a_plain_chain_and_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(5)
    words = ["alpha", "BETA", "12", "|", "gamma, delta", "", "éa"]
    texts = ["\n".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(rng.integers(1, 40))) for _ in range(60)] + ["", "x"]
    texts += ["\n".join(rng.choice(words, 3000)), "\n".join(rng.choice(words, 1025))]  # long enough for the scan
    chain = chain_of(rng)
    whole = chain.scores(texts)
    assert np.allclose(whole, [plain_score(chain, t) for t in texts], atol=1e-7)
    assert [chain.scores([t])[0] for t in texts] == whole.tolist() == chain.scores(texts[::-1])[::-1].tolist()
    monkeypatch.setattr(quality, "_LINES", 7)
    monkeypatch.setattr(quality, "_CELLS", 50)
    assert chain.scores(texts).tolist() == whole.tolist()


def test_a_text_of_four_megabytes_of_lines_needs_bounded_memory():
    import tracemalloc

    chain = chain_of(np.random.default_rng(6))
    text = "\n".join(str(i % 99_991) for i in range(700_000))
    tracemalloc.start()
    chain.scores(["a\nb"] * 300 + [text])
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()

def planted_votes(rng, n, share=0.2):
    """Five voters that repeat one another, two independent ones, and noisy annotators."""
    y = rng.random(n) < share
    one = np.where(y, rng.random(n) < 0.8, rng.random(n) < 0.05)
    others = [np.where(y, rng.random(n) < p, rng.random(n) < q) for p, q in ((0.6, 0.1), (0.7, 0.02))]
    return y, np.stack([one] * 5 + others, axis=1), np.where(rng.random(n) < 0.05, ~y, y).astype(int)


def test_label_model_counts_repeating_voters_once():
    y, votes, noisy = planted_votes(np.random.default_rng(0), 4000)
    post = toxicity.label_model(votes, noisy)
    assert ((post > 0.5) == y).mean() >= (noisy == y).mean()
    once = toxicity.label_model(votes[:, 4:], noisy)
    assert np.abs(post - once).mean() < 0.05  # four more copies of a voter change little


def test_label_model_labels_documents_without_a_label():
    y, votes, noisy = planted_votes(np.random.default_rng(1), 6000)
    noisy[1000:] = -1
    post = toxicity.label_model(votes, noisy)
    assert ((post[1000:] > 0.5) == y[1000:]).mean() > 0.9  # all clean: 0.8
    assert abs(post[1000:].mean() - y[1000:].mean()) < 0.05


def test_linear_classifier_finds_planted_features():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 30)) < 0.2
    truth = np.zeros(30)
    truth[:4] = 3, -3, 2, 4
    y = 1 / (1 + np.exp(-(x @ truth - 2)))
    row, col = np.nonzero(x)
    w, b = toxicity._logistic(row, col, 2000, 30, y)
    assert np.abs(w - truth).max() < 0.2 and abs(b + 2) < 0.2
    anchor = (rng.random(2000) < y).astype(int)
    cut = toxicity._cut(row, col, 30, y, anchor)
    assert -1 < cut < 4  # clean documents are dear: the cut is above one half


def direct_mixing(training, depth):
    """log10 probability of a text by the definition, over plain dictionaries of counts for each decision and context."""
    counts = {}

    def steps(text):
        padded = bytes(depth) + text
        for at in range(len(text) + 1):
            context = padded[at : at + depth][::-1]  # the newest byte first
            if at == len(text):
                yield context, [(0, 1)]
            else:
                bits = [text[at] >> (7 - i) & 1 for i in range(8)]
                yield context, [(0, 0)] + [(int("1" + "".join(map(str, bits[:i])), 2), bits[i]) for i in range(8)]

    for text in training:
        for context, decisions in steps(text):
            for decision, one in decisions:
                for d in range(depth + 1):
                    counts.setdefault((decision, context[:d]), [0, 0])[one] += 1
    children = {}
    for decision, c in counts:
        if c:
            children.setdefault((decision, c[:-1]), []).append(c)

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    known = {}

    def weighted(decision, c):
        if (decision, c) not in known:
            own = kt(counts.get((decision, c), [0, 0]))
            known[decision, c] = own if len(c) == depth else math.log(0.5) + np.logaddexp(own, sum(weighted(decision, x) for x in children.get((decision, c), [])))
        return known[decision, c]

    def log10(text):
        total = 0.0
        for context, decisions in steps(text):
            for decision, one in decisions:
                p, left = 0.0, 1.0
                for d in range(depth + 1):
                    n = counts.get((decision, context[:d]), [0, 0])
                    stop = 1.0 if d == depth else math.exp(math.log(0.5) + kt(n) - weighted(decision, context[:d]))
                    p, left = p + left * stop * (n[1] + 0.5) / (sum(n) + 1), left * (1 - stop)
                total += math.log10(p if one else 1 - p)
        return total

    return log10


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_scores_equal_direct_mixing(spark, depth):
    words = ["abracadabra", "abba", "", "cab" * 5, "the cat sat on the mat", "a rare zebra \u00e9\u4e2d"]
    rows = [(i, words[i * 7 % 6] + words[i % 5]) for i in range(60)] + [(1000 + i, "unseen Qx abr") for i in range(8)] + [(2000, None), (None, "Abba")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    text = lambda t: (t or "").encode().lower()
    model = direct_mixing([text(t) for i, t in rows if not held(i)], depth)
    want = sorted((i is None, i or 0, round(model(text(t)), 6)) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for common in (16, 4_000_000):  # with and without n-grams that meet their probability in a join
        got = ctw.score(docs, depth=depth, common=common).collect()
        assert np.allclose(np.array(sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in got)), np.array(want), atol=1e-5)


def test_pieces_and_runs_change_nothing(monkeypatch):
    texts = [b"abracadabra" * 9, b"", b"abba", b"the cat sat on the mat " * 5]
    whole, _ = ctw.ngrams(next(ctw._pieces(texts, 4)), 4)
    keys, n = np.unique(whole, return_counts=True)
    nodes = ctw._prefix_nodes(keys, n, 4)
    monkeypatch.setattr(ctw, "_PIECE", 7)
    monkeypatch.setattr(ctw, "_RUN", 3)
    assert np.array_equal(np.concatenate([ctw.ngrams(p, 4)[0] for p in ctw._pieces(texts, 4)]), whole)
    for a, b in zip(nodes, ctw._prefix_nodes(keys, n, 4)):
        assert np.array_equal(a.key, b.key) and np.array_equal(a.n1, b.n1) and np.allclose(a.weighted, b.weighted)


def test_counts_of_a_hundred_thousand_million_keep_their_digits():
    nodes = ctw.Nodes(np.zeros(1, dtype=np.int64), np.array([10**11]), np.array([10**11 + 10**6]))
    assert abs(nodes.one[0] - (10**11 + 10**6 + 0.5) / (2 * 10**11 + 10**6 + 1)) < 1e-15


def test_unigram_base_and_model(spark, small, odd_docs):
    from collections import Counter

    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd_docs, allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r.doc_id), held(r.doc_id), len(w := tokens(r.text)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)) for r in rows)
    got = ctw.score(docs, head=200, common=30_000, depth=3).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_model_without_training_rows(spark, no_docs):
    assert ctw.score(no_docs).count() == 0
    one = spark.createDataFrame([(i, "ab") for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    got = ctw.score(one).first()
    assert (got.train_tokens, got.n_known, got.n_tokens) == (0, 0, 2) and abs(got.score - 19 * math.log10(0.5)) < 1e-3


def test_toxicity_fit_keeps_the_driver_small(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = np.array(["".join(map(chr, w)) for w in rng.integers(97, 123, (4000, 7))])
    docs = [(i, " ".join(rng.choice(words, 800, replace=False)) + " awful" * (i % 2)) for i in range(1500)]
    hashes = sum(len(toxicity.feature_hashes(t)) for _, t in docs) * 4 * 0.8  # bytes; a fifth is held out
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1500)], "doc_id long, toxic int")
    handed = []
    monkeypatch.setattr(toxicity, "hand_back", lambda: handed.append(1))
    tracemalloc.start()
    try:
        model = toxicity.fit(frame, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert handed == [1]
    assert peak < 4 * hashes, peak / hashes
    one = toxicity.scorer(model)
    assert one("awful") > one("kind")
