"""Near-duplicate documents by a MinHash LSH forest, confirmed on full shingle sets.

1. Every document becomes a set of shingle hashes.  Equal sets form one node (a 128-bit digest).
2. Each of ``trees`` sorted orders ranks the nodes by a sequence of minima.  A region is a run of
   nodes that share the first ``base_depth`` minima.  Inside a region all pairs are candidates if it
   has at most ``region`` nodes; a larger one is split by the next minimum, and so on, so the
   depth adapts to the density of the region.  Runs that stay large at full depth, and the seams of
   split regions, give neighbours in the order.
3. Every node's candidate that most orders agree on is confirmed first.  That joins most groups.
4. What may still lie between components is settled exactly: candidates between two components and the
   members of open regions (split ones, and those cut by a partition's end) form clusters, and each cluster
   is compared in blocks on the full sets.  Blocks of one component, or whose sizes
   rule out a link, are passed over; a block returns a spanning forest of its links, not its pairs.

Orders are range-partitioned by (region, label, node), so a dense region spreads over many tasks.
A pair at the threshold t meets in no region with probability (1 - t^base_depth)^trees: 2e-8 for
0.85, 4 and 24; 4e-6 for 0.8.

Defined results: null texts count as empty; documents without words are linked with nothing; rows
with a null id take part and get the smallest id of their component (null if it has none); rows with equal
ids are separate rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, drop_stage, id_text, lean, matched, stage
from .graph import components, contract
from .shingles import minhash, permutations, shingle_set


class Forest:
    """Parameters: link when ``den * intersection >= num * union`` on shingles of ``words`` words."""

    def __init__(self, words: int = 5, num: int = 80, den: int = 100, trees: int = 24, base_depth: int = 4, max_depth: int = 8, region: int = 8):
        self.words, self.num, self.den = words, num, den
        self.trees, self.base, self.depth, self.region = trees, base_depth, max_depth, region
        self.hashes = trees * base_depth + 32
        rng = np.random.default_rng(7)
        own = np.arange(trees * base_depth).reshape(trees, base_depth)
        self.order = np.array([np.concatenate([own[t], rng.choice(np.setdiff1d(np.arange(self.hashes), own[t]), max_depth - base_depth, replace=False)]) for t in range(trees)])


def signatures(docs: DataFrame, f: Forest) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, labels): labels has one binary of max_depth minima for each tree; null for empty sets."""

    def run(batches):
        a, b = permutations(f.hashes)
        for batch in batches:
            n, nodes, labels = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), f.words)
                n.append(len(s))
                if len(s):
                    nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    labels.append(minhash(s, a, b).astype(">u4").tobytes())
                else:
                    nodes.append(None)
                    labels.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(labels, pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "signature"])

    return docs.mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, node binary, signature binary")


def ordered(nodes: DataFrame, f: Forest) -> DataFrame:
    """One row for each node and tree: region (hash of tree and base minima), label (the further minima), node, n."""

    def run(batches):
        cut = f.base * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=">u4").reshape(batch.num_rows, f.hashes)
            for t in range(f.trees):
                rows = np.ascontiguousarray(sig[:, f.order[t]]).view(np.uint8).reshape(batch.num_rows, f.depth * 4)
                regions = [int.from_bytes(hashlib.blake2b(r[:cut].tobytes() + bytes([t]), digest_size=8).digest(), "little", signed=True) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(regions, pa.int64()), pa.array([r[cut:].tobytes() for r in rows], pa.binary()), batch.column("node"), batch.column("n")], ["region", "label", "node", "n"])

    return nodes.select("node", "n", "signature").mapInArrow(lean(run), "region long, label binary, node binary, n long")


def _close(n_a: int, n_b: int, f: Forest) -> bool:
    return f.den * min(n_a, n_b) >= f.num * max(n_a, n_b)


def neighbours(rows: DataFrame, f: Forest) -> DataFrame:
    """Candidates (a, b) and, with b null, the members a of open regions, whose pairs are not all listed."""

    def pairs(members, depth, out):
        """members: (label, node, n), sorted."""
        if len(members) <= f.region:
            for i, (_, a, n_a) in enumerate(members):
                out.extend((a, b) for _, b, n_b in members[i + 1 :] if _close(n_a, n_b, f))
            return
        out.extend((a, b) for (_, a, n_a), (_, b, n_b) in zip(members, members[1:]) if _close(n_a, n_b, f))
        if depth == f.depth:
            return
        at, end = 0, (depth - f.base + 1) * 4
        while at < len(members):
            to = at + 1
            while to < len(members) and members[to][0][:end] == members[at][0][:end]:
                to += 1
            if to - at > 1 and to - at < len(members):
                pairs(members[at:to], depth + 1, out)
            elif to - at == len(members):
                pairs_next(members, depth + 1, out)
            at = to

    def pairs_next(members, depth, out):
        if depth < f.depth:
            pairs(members, depth, out)

    def table(found, opened):
        a = [x for x, _ in found] + [x for _, x in opened]
        b = [y for _, y in found] + [None] * len(opened)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([None] * len(found) + [r for r, _ in opened], pa.int64())], ["a", "b", "region"])

    #: Rows of one region that a task holds at once; a longer run is worked off in parts and stays open.
    hold = 4096

    def run(batches):
        current, members, first, cut, found, opened = None, [], True, False, [], []

        def close(last):
            nonlocal members
            if len(members) > 1:
                pairs(members, f.base, found)
            if members and (first or last or cut or len(members) > f.region):
                opened.extend((current, node) for _, node, _ in members)
            members = []

        for batch in batches:
            for region, label, node, n in zip(*(c.to_pylist() for c in batch.columns)):
                if region != current:
                    if current is not None:
                        close(False)
                        first = False
                    current, cut = region, False
                elif len(members) >= hold:
                    cut, kept = True, members[-1:]
                    close(False)
                    members = kept
                members.append((label, node, n))
                if len(found) + len(opened) > 20000:
                    yield table(found, opened)
                    found, opened = [], []
        close(True)
        if found or opened:
            yield table(found, opened)

    spread = rows.repartitionByRange(F.col("region"), F.col("label"), F.col("node")).sortWithinPartitions("region", "label", "node")
    return spread.mapInArrow(lean(run), "a binary, b binary, region long")


def confirm(pairs: DataFrame, sets: DataFrame, f: Forest) -> DataFrame:
    """(a, b, linked) of pairs (a, b), from the full sets (node, shingles)."""

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                out.append(f.den * both >= f.num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    full = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    return full.mapInArrow(lean(run), "a binary, b binary, linked boolean")


def _with_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between different components, with ra and rb; nodes that have no root yet are their own."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    out = edges.join(a, "a", "left").join(b, "b", "left")
    return out.withColumns({f"r{x}": F.coalesce(f"r{x}", x) for x in "ab"}).where("ra != rb")


def _merge(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """Roots after linked pairs (ra, rb) of roots have joined components."""
    more = stage(components(linked.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "merged")
    new = more.join(roots.select("node"), "node", "left_anti")
    return stage(contract(roots, more).unionByName(new), "roots")


def near_duplicates(docs: DataFrame, f: Forest | None = None) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row of documents(doc_id, text).

    text_key is xxhash64 of the text (null: empty), which with doc_id names a row's text.  What the result reads can be dropped when it
    is no longer needed: ``_tessera_reads``.
    """
    f = f or Forest()
    texts = id_text(docs).withColumn("text_key", F.xxhash64("text"))
    signed = stage(signatures(texts, f), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_key")).alias("example"))
    nodes = stage(nodes, "nodes")
    rows = ordered(nodes, f)
    found = stage(neighbours(rows, f), "candidates")
    edges = stage(found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("agree")), "edges")
    opened = found.where("b is null").select("region", F.col("a").alias("node"))
    wanted = edges.select(F.explode(F.array("a", "b")).alias("node")).unionByName(opened.select("node")).distinct()
    sets = stage(_sets(texts, nodes, wanted, f), "sets")
    drop_shuffles(docs.sparkSession)
    parents = edges.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b")
    done = stage(confirm(parents, sets, f), "confirmed")
    roots = stage(components(done.where("linked").select("a", "b")), "roots")
    roots = _settle(edges.join(done.select("a", "b"), ["a", "b"], "left_anti"), opened, sets, roots, f)

    whole = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = whole.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    by_node = stage(whole.join(lowest, "root").select("node", "copies", "component_id"), "membership")
    for used in (found, edges, done, roots, nodes):
        drop_stage(used)
    drop_shuffles(docs.sparkSession)
    out = matched(signed.select("doc_id", "text_key", "n_shingles", "node"), by_node, ["node"], "copies")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    out._tessera_reads = (signed, by_node)
    return out


def _sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, f: Forest) -> DataFrame:
    """(node, n, shingles) of the wanted nodes, made again from one text of each."""
    named = nodes.join(wanted, "node", "left_semi").select("node", "n", "example.doc_id", "example.text_key")
    cond = texts.doc_id.eqNullSafe(named.doc_id) & (texts.text_key == named.text_key)
    rows = texts.join(named, cond).select("node", "n", "text")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), f.words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(sets, pa.binary())], ["node", "n", "shingles"])

    made = rows.mapInArrow(lean(run), "node binary, n long, shingles binary")
    return made.groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))


def _settle(edges: DataFrame, opened: DataFrame, sets: DataFrame, roots: DataFrame, f: Forest) -> DataFrame:
    """Roots after all links between components were found among candidates (a, b) and members (region, node) of open regions; sets goes."""
    apart = _with_roots(edges, roots).select("a", "b")
    members = opened.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stage(members.select("region", "node", "root"), "members")
    mixed = members.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("lo != hi")
    # rows of large regions meet their region's first node by broadcast
    first = stage(mixed.select("region", "first", "n"), "mixed")
    ties = matched(members.select("region", "node"), first, ["region"], "n").where("first is not null").select(F.col("first").alias("a"), F.col("node").alias("b"))
    clustered = stage(components(apart.unionByName(ties), "clusters"), "clusters")
    clusters = clustered.withColumnRenamed("root", "cluster")
    held = clusters.join(sets, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = stage(_blocks(held, f), "blocks")
    drop_stage(sets)
    drop_shuffles(roots.sparkSession)
    inside = blocks.where("a is not null").select("a", "b")
    left = blocks.where("a is null").select("cluster", "block", "root", "least", "most", "nodes", "sets")
    # a cluster's blocks are dealt into slices of about sixteen; every slice meets all blocks of its cluster
    slices = left.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / 16).cast("int").alias("slices"))
    left = left.join(slices, "cluster")
    right = left.select("cluster", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *(F.col(c).alias(f"{c}2") for c in ("block", "root", "least", "most", "nodes", "sets")))
    left = left.withColumn("slice", F.pmod(F.xxhash64("block"), F.col("slices")).cast("int")).drop("slices")
    fits = F.expr(f"{f.den} * most2 >= {f.num} * least and {f.den} * most >= {f.num} * least2")
    pairs = left.join(right, ["cluster", "slice"]).where("block <= block2").where("root is null or root2 is null or root != root2").where(fits)
    linked = stage(inside.unionByName(_compare(pairs, f)), "linked")
    merged = _merge(roots, _with_roots(linked, roots))
    for used in (members, first, clustered, blocks, linked, roots):
        drop_stage(used)
    return merged


def forest(left: list[np.ndarray], right: list[np.ndarray] | None, f: Forest) -> list[tuple[int, int]]:
    """A spanning forest of the links inside ``left``, or between ``left`` and ``right`` (places, right ones after left)."""
    both = left + (right or [])
    size = np.array([len(x) for x in both], dtype=np.int64)
    if len(both) == 2:
        shared = np.array([[0, len(np.intersect1d(both[0], both[1], assume_unique=True))], [0, 0]], dtype=np.float64)
        shared[1, 0] = shared[0, 1]
    else:
        values = np.concatenate(both)
        row = np.repeat(np.arange(len(both)), size)
        order = np.argsort(values, kind="stable")
        values, row = values[order], row[order]
        start = np.concatenate([[True], values[1:] != values[:-1]])
        column = np.cumsum(start) - 1
        often = np.bincount(column) > 1
        column, row = (np.cumsum(often) - 1)[column[often[column]]], row[often[column]]
        shared = np.zeros((len(both), len(both)))
        for at in range(0, int(often.sum()), 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            dense = np.zeros((len(both), 4096), dtype=np.float32)
            dense[row[lo:hi], column[lo:hi] - at] = 1
            shared += dense @ dense.T
    union = size[:, None] + size[None, :] - shared
    a, b = np.nonzero(np.triu((f.den * shared >= f.num * union) & (union > 0), 1))
    parent = list(range(len(both)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        if right is not None and (i < len(left)) == (j < len(left)):
            continue
        x, y = root(i), root(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


_BLOCK_SCHEMA = "a binary, b binary, cluster binary, block binary, root binary, least long, most long, nodes array<binary>, sets array<binary>"


def _blocks(held: DataFrame, f: Forest, block: int = 256, block_bytes: int = 4_000_000) -> DataFrame:
    """Links (a, b) of clusters that fit one block, and the blocks of all others; root is null where a block mixes components."""
    names = ["a", "b", "cluster", "block", "root", "least", "most", "nodes", "sets"]
    types = [pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def run(batches):
        current, members, size, whole, first, out = None, [], 0, True, True, []

        def close(last_of_task, ends):
            """ends: the cluster ends here; a whole cluster in one block is compared at once."""
            nonlocal members, size, whole
            if members and ends and whole and not first and not last_of_task:
                sets = [np.frombuffer(m[2], dtype=np.uint64) for m in members]
                if len({m[1] for m in members}) > 1:
                    out.extend((members[i][0], members[j][0], *[None] * 7) for i, j in forest(sets, None, f))
            elif members:
                n = [m[3] for m in members]
                roots = {m[1] for m in members}
                out.append((None, None, current, members[0][0], members[0][1] if len(roots) == 1 else None, min(n), max(n), [m[0] for m in members], [m[2] for m in members]))
                whole = False
            members, size = [], 0

        for batch in batches:
            for cluster, root, n, node, shingles in zip(*(batch.column(c).to_pylist() for c in ("cluster", "root", "n", "node", "shingles"))):
                if cluster != current:
                    if current is not None:
                        close(False, True)
                        first = False
                    current, whole = cluster, True
                elif len(members) >= block or size >= block_bytes:
                    close(False, False)
                members.append((node, root, shingles, n))
                size += len(shingles)
                if len(out) >= 64:
                    yield table(out)
                    out = []
        close(True, True)
        if out:
            yield table(out)

    spread = held.select("cluster", "root", "n", "node", "shingles").repartitionByRange("cluster", "root", "n", "node").sortWithinPartitions("cluster", "root", "n", "node")
    return spread.mapInArrow(lean(run), _BLOCK_SCHEMA)


def _compare(pairs: DataFrame, f: Forest) -> DataFrame:
    """A spanning forest of the links in each pair of blocks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "block2", "nodes", "nodes2", "sets", "sets2")}
                left = [np.frombuffer(x, dtype=np.uint64) for x in row["sets"]]
                same = row["block"] == row["block2"]
                right = None if same else [np.frombuffer(x, dtype=np.uint64) for x in row["sets2"]]
                nodes = row["nodes"] if same else row["nodes"] + row["nodes2"]
                found = forest(left, right, f)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.binary()), pa.array([nodes[y] for _, y in found], pa.binary())], ["a", "b"])

    return pairs.mapInArrow(lean(run), "a binary, b binary")
