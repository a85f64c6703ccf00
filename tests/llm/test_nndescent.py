import numpy as np

from tessera.llm import nndescent


def brute(rows, threshold):
    """By dimension: vectors of different dimensions never link."""
    out = {i: (vec_id, 0, vec_id, True) for i, (vec_id, _) in enumerate(rows)}
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    for dim in {len(rows[i][1]) for i in ok}:
        brute_of([i for i in ok if len(rows[i][1]) == dim], rows, threshold, out)
    return sorted(out.values())


def brute_of(ok, rows, threshold, out):
    x = np.array([rows[i][1] for i in ok], dtype=float)
    x /= np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= threshold
    np.fill_diagonal(s, False)
    parent = list(range(len(ok)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in zip(*np.nonzero(s)):
        parent[root(i)] = root(j)
    lows = {}
    for a, i in enumerate(ok):
        lows[root(a)] = min(lows.get(root(a), rows[i][0]), rows[i][0])
    for a, i in enumerate(ok):
        out[i] = (rows[i][0], int(s[a].sum()), lows[root(a)], rows[i][0] == lows[root(a)])


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [rng.standard_normal(16) for _ in range(250)]
    for size, noise in ((60, 0.05), (9, 0.1), (3, 0.1)):  # one region beyond k, two groups inside
        centre = rng.standard_normal(16)
        rows += [centre + noise * rng.standard_normal(16) for _ in range(size)]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(rows)]
    rows += [(900, rows[0][1]), (901, rows[255][1]), (902, None), (903, [0.0] * 16), (904, [float("nan")] * 16), (905, [None] * 16), (906, [1.0]), (907, [])]
    rows += [(910, [3.0, 4.0]), (911, [3.1, 4.0]), (912, [-3.0, 1.0]), (913, [3e-200, 4e-200]), (914, [3e200, 4.1e200]), (915, [2.0])]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, key string")
    got = sorted(map(tuple, nndescent.near_duplicates(docs, k=8, block=32).collect()))
    assert got == brute(rows, 0.9)


def nested(rng, centre, groups, size, wide, tight):
    """Groups of near copies, each tighter than the distance between the groups."""
    return [g + tight * rng.standard_normal(16) for g in (centre + wide * rng.standard_normal(16) for _ in range(groups)) for _ in range(size)]


def test_links_between_tight_groups_of_more_than_k(spark):
    rng = np.random.default_rng(3)
    rows = nested(rng, rng.standard_normal(16), 6, 20, 0.03, 0.005)  # all groups linked with one another
    a = rng.standard_normal(16)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(16)
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    turn = np.arccos(0.9)
    for c in (a, np.cos(turn) * a + np.sin(turn) * b):  # some of the pairs of these two groups are links
        rows += [c + 0.02 * rng.standard_normal(16) for _ in range(30)]
    turn *= 1.04
    for c in (a, np.cos(turn) * a + np.sin(turn) * b):  # centres further apart than the threshold
        rows += [-c + 0.02 * rng.standard_normal(16) for _ in range(30)]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(rows)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, nndescent.near_duplicates(docs, k=8, block=32).collect()))
    assert got == brute(rows, 0.9)


def test_audit_sees_lost_links_and_the_search_goes_on(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = nested(rng, rng.standard_normal(16), 3, 12, 0.03, 0.005) + [rng.standard_normal(16) for _ in range(20)]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(rows)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    recall, audit, saturated = [], nndescent.audit, nndescent._saturated
    monkeypatch.setattr(nndescent, "_saturated", lambda *args: saturated(*args).where("false"))  # no list is enlarged
    monkeypatch.setattr(nndescent, "audit", lambda *args: recall.append(audit(*args)) or recall[-1])
    got = sorted(map(tuple, nndescent.near_duplicates(docs, k=4, block=32, max_rounds=1, searches=1).collect()))
    assert recall[0] < 0.5 and got == brute(rows, 0.9)


def test_cells_pass_over_no_link(spark, monkeypatch):
    """Few pivots, small blocks, and regions of several slices of chunks."""
    rng = np.random.default_rng(8)
    rows = [x for _ in range(5) for x in nested(rng, rng.standard_normal(16), 4, 30, 0.05, 0.005)]
    x = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, v.tobytes(), 1) for i, v in enumerate(x)], "node long, unit binary, copies long")
    monkeypatch.setattr(nndescent, "_PIVOTS", 3)
    none = spark.createDataFrame([], "a long, b long")
    regions = nndescent._regions
    more, _ = regions(none, nodes.select("node"), nodes, 0.9, 2)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    assert {r.node: r.more for r in more.collect()} == {i: n for i, n in enumerate(s.sum(axis=1).tolist()) if n}


def test_eight_bits_are_off_by_no_more_than_the_margin():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200, 64)) ** 3
    x /= np.linalg.norm(x, axis=1)[:, None]
    small, step = nndescent._rounded(x)
    y = small * step[:, None]
    worst = np.linalg.norm(x - y, axis=1).max()
    assert np.abs(x @ x.T - y @ y.T).max() <= worst * (2 + worst)


def test_full_list_with_entries_just_below_the_threshold_is_saturated(spark):
    entries = [(1, 2, 0.95), (1, 3, 0.89), (2, 1, 0.95), (2, 3, 0.86), (3, 1, 0.95)]
    lists = spark.createDataFrame(entries, "v long, u long, sim float")
    assert [r.node for r in nndescent._saturated(lists, 2, 0.9, 0.03).collect()] == [1]


def test_empty_table_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert nndescent.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, None, 1), (3, None, 1), (4, [1.0, 0.001], 2)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 2, 4, False), (None, 2, 4, False), (3, 0, 3, True), (3, 0, 3, True), (4, 2, 4, True)]))
