"""Near-duplicate embeddings by NN-descent.

1. Equal vectors form one node.  Several random orders (signs of random hyperplanes, then a random
   projection) are cut into blocks, and the best ``k`` neighbours inside a node's blocks start its list.
2. Rounds of NN-descent: every node joins its neighbours and reverse neighbours with one another; a
   pair that beats the worst entry of one's list enters it.  Rounds end when few lists change.
   These rounds compare vectors rounded to eight bits; everything below is in double precision.
3. List entries with cosine >= threshold are links.  The margin that eight bits need is not guessed: it is the largest
   rounding error of all vectors, twice.  A node whose list is full, its worst entry within
   the margin of the threshold or above, is saturated: its list is enlarged to all saturated nodes, compared chunk by chunk.  A chunk
   holds nodes of one region (saturated nodes connected by links), and is compared with the chunks of its own and of all other regions.
   Chunks whose centres lie too far apart for their radii are passed over, which loses nothing.  Chunks of different regions
   meet only in cells around ``_PIVOTS`` chunk centres: a cell covers the chunks nearest to its pivot, and by the
   triangle inequality a chunk has links only into cells that it reaches.  Counts
   leave these comparisons, and one edge for regions that turn out to be linked.
4. An audit compares a bounded set of nodes with all rows in blocks and logs the recall.  While it finds a recall of these links below
   ``least_recall``, the search goes on with lists of twice the length and further random orders.  After
   ``searches`` of them all nodes count as saturated, which finds every link.

Defined results: a vector that is null, zero or holds null or non-finite components has no links, is its own
component and is kept; very small and very large components are scaled first; a null id keeps a null component; equal vectors link
with one another; rows with equal ids are separate rows; vectors of each dimension are searched among themselves; further columns are ignored.
"""

from __future__ import annotations

import functools
import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stage, matched, stage
from .graph import components

_LOG = logging.getLogger(__name__)


def _bytes(column) -> np.ndarray:
    """Rows of a binary column whose values are of one length, as bytes, without a copy of each."""
    if not len(column):
        return np.zeros((0, 0), dtype=np.uint8)
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def _matrix(column) -> np.ndarray:
    """Rows of a binary column of float64."""
    return np.ascontiguousarray(_bytes(column)).view(np.float64)


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in eight bits and the size of one step in each."""
    step = np.abs(x).max(axis=1) / 127
    return np.rint(x / step[:, None]).astype(np.int8), step


def _small(rows: np.ndarray) -> np.ndarray:
    """Vectors from bytes: a step in four of them, then components in eight bits."""
    out = rows[:, 4:].view(np.int8).astype(np.float32)
    out *= np.ascontiguousarray(rows[:, :4]).view(np.float32)
    return out


def _usable(rows: DataFrame) -> DataFrame:
    """(vec_id, key): key is the vector as float64 bytes, null for vectors that link with nothing."""

    def run(batches):
        for batch in batches:
            keys = []
            for x in batch.column("embedding").to_pylist():
                v = np.array(x, dtype=np.float64) if x and None not in x else np.zeros(0)
                ok = len(v) and np.isfinite(v).all() and v.any()
                keys.append((v + 0.0).tobytes() if ok else None)  # adding zero makes minus zero plus zero
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary())], ["vec_id", "key"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, key binary")


def _units(nodes: DataFrame) -> DataFrame:
    """Adds unit (float64 of length one), small (the same in eight bits) and error, the distance between the two."""

    def run(batches):
        for batch in batches:
            widths = pc.binary_length(batch.column("key"))
            for width in pc.unique(widths):  # rows of one dimension at a time
                yield whole(batch.filter(pc.equal(widths, width)))

    def whole(batch):
        x = _matrix(batch.column("key"))
        x = x / np.abs(x).max(axis=1)[:, None]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        small, step = _rounded(x)
        step = step.astype(np.float32)
        error = np.sqrt(((x - small * step[:, None].astype(np.float64)) ** 2).sum(axis=1))
        packed = [s.tobytes() + r.tobytes() for s, r in zip(step, small)]
        return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("key"), batch.column("low"), batch.column("copies"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(packed, pa.binary()), pa.array(error)], ["node", "key", "low", "copies", "unit", "small", "error"])

    return nodes.mapInArrow(run, "node long, key binary, low long, copies long, unit binary, small binary, error double")


def _pairs_table(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a), pa.int64()), pa.array(np.asarray(b), pa.int64()), pa.array(np.asarray(sim, dtype=np.float32))], ["v", "u", "sim"])


def _start(nodes: DataFrame, dim: int, k: int, orders: int, block: int, seed: int = 5) -> DataFrame:
    """(v, u, sim): best neighbours inside blocks of random orders."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((orders, 16, dim)).astype(np.float32)
    lines = rng.standard_normal((orders, dim)).astype(np.float32)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _small(_bytes(batch.column("small")))
            for t in range(orders):
                code = ((x @ planes[t].T > 0) @ (1 << np.arange(15, -1, -1))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code + (t << 16)), pa.array((x @ lines[t]).astype(np.float32)), batch.column("node"), batch.column("small")], ["code", "at", "node", "small"])

    def compare(batches):
        ids, rows, order = [], [], None

        def best():
            if len(ids) < 2:
                return
            v = np.array(ids, dtype=np.int64)
            x = _small(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1))
            s = x @ x.T
            np.fill_diagonal(s, -2)
            n = min(k, len(v) - 1)
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            yield _pairs_table(np.repeat(v, n), v[top.ravel()], np.take_along_axis(s, top, axis=1).ravel())

        for batch in batches:
            for code, node, small in zip(batch.column("code").to_numpy(), batch.column("node").to_numpy(), batch.column("small")):
                if order is not None and (code >> 16 != order or len(ids) >= block):
                    yield from best()
                    ids, rows = [], []
                order = code >> 16
                ids.append(node)
                rows.append(small.as_py())
        yield from best()

    placed = nodes.select("node", "small").mapInArrow(place, "code long, at float, node long, small binary")
    spread = placed.repartitionByRange("code", "at", "node").sortWithinPartitions("code", "at", "node")
    return spread.mapInArrow(compare, "v long, u long, sim float")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct entries of each list."""
    w = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return pairs.groupBy("v", "u").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def _round(lists: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Pairs found by joining every node's neighbours, forward and reverse, with one another."""
    back = lists.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim")
    w = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    # a node that is in very many lists passes on the nearest of them; the others still list it themselves
    back = back.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    around = lists.select("v", "u").unionByName(back.select("v", "u")).distinct()
    worst = lists.groupBy(F.col("v").alias("u")).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
    told = nodes.select(F.col("node").alias("u"), "small").join(worst, "u", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
    gathered = around.join(told, "u").groupBy("v").agg(F.collect_list(F.struct("u", "small", "worst")).alias("around"))

    def run(batches):
        for batch in batches:
            lists_ = batch.column("around")
            flat, at = lists_.flatten(), lists_.offsets.to_numpy()
            at = at - at[0]
            if not len(flat):
                continue
            ids, worst_ = flat.field("u").to_numpy(), flat.field("worst").to_numpy()
            rows = _bytes(flat.field("small"))
            va, ua, sa = [], [], []
            for lo, hi in zip(at[:-1], at[1:]):
                x = _small(rows[lo:hi])
                s = x @ x.T
                np.fill_diagonal(s, -3)
                i, j = np.nonzero(s > worst_[lo:hi, None])
                va.append(ids[lo + i])
                ua.append(ids[lo + j])
                sa.append(s[i, j])
            if va:
                yield _pairs_table(np.concatenate(va), np.concatenate(ua), np.concatenate(sa))

    return gathered.mapInArrow(run, "v long, u long, sim float")


def _confirm(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with cosine >= threshold in double precision."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _matrix(batch.column("xa")), _matrix(batch.column("xb")))
                yield batch.select(["a", "b"]).filter(pa.array(s >= threshold))

    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("xa")), "a")
    return left.join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("xb")), "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _listed(lists: DataFrame, nodes: DataFrame, threshold: float, margin: float) -> DataFrame:
    near = lists.where(F.col("sim") >= threshold - margin).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    return _confirm(near, nodes, threshold)


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, size: int) -> float:
    """Recall of the final links, counted (node, near), on at most ``size`` nodes, taken by the hash of their number, against all rows."""
    chosen = nodes.select("node", "unit").orderBy(F.xxhash64("node"), "node").limit(size).toArrow()
    if not chosen.num_rows:
        return 1.0
    ids, x = chosen.column("node").to_numpy(), _matrix(chosen.column("unit").combine_chunks())

    def run(batches):
        for batch in batches:
            total = np.zeros(len(ids), dtype=np.int64)
            if batch.num_rows:
                s = x @ _matrix(batch.column("unit")).T >= threshold
                total = (s & (ids[:, None] != batch.column("node").to_numpy()[None, :])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "true_links"])

    true = nodes.select("node", "unit").mapInArrow(run, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    met = true.join(counted.select("node", "near"), "node", "left")
    got, want = met.agg(F.sum(F.least(F.coalesce("near", F.lit(0)), "true_links")), F.sum("true_links")).first()
    return (got / want) if want else 1.0


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


def _pack(members: DataFrame, chunk: int) -> DataFrame:
    """Chunks of at most ``chunk`` nodes of one region; (region, by, node) is the order, best the node nearest the centre."""

    def run(batches):
        region, rows = None, []

        def out():
            if rows:
                x = np.stack([r[3] for r in rows])
                centre = x.mean(axis=0)
                norm = np.sqrt(centre @ centre)
                centre = centre / norm if norm > 1e-9 else x[0]
                apart = _angle(x @ centre)
                best = int(apart.argmin())
                lists = [pa.array([[r[i] for r in rows]], pa.list_(pa.int64())) for i in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array([region], pa.int64()), pa.array([rows[0][0]], pa.int64()), *lists, pa.array([x.tobytes()], pa.binary()), pa.array([centre.tobytes()], pa.binary()), pa.array([float(apart.max())]), pa.array([rows[best][0]], pa.int64()), pa.array([x[best].tobytes()], pa.binary())], ["region", "chunk", "ids", "roots", "copies", "x", "centre", "radius", "best", "unit"])

        for batch in batches:
            for of, node, root, n, unit in zip(*(batch.column(c).to_numpy() for c in ("region", "node", "root", "copies")), batch.column("unit")):
                if of != region or len(rows) >= chunk:
                    yield from out()
                    region, rows = int(of), []
                rows.append((int(node), int(root), int(n), np.frombuffer(unit.as_buffer(), dtype=np.float64)))
        yield from out()

    spread = members.select("region", "by", "node", "root", "copies", "unit").repartitionByRange("region", "by", "node").sortWithinPartitions("region", "by", "node")
    return spread.mapInArrow(run, "region long, chunk long, ids array<long>, roots array<long>, copies array<long>, x binary, centre binary, radius double, best long, unit binary")


#: Chunk centres that cells are built around, and centres that one block of a cell holds.
_PIVOTS, _BLOCK = 1024, 512


def _across(packed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, linked) of chunks of different regions: pairs whose centres and radii allow a link, and links of their best nodes.

    Every chunk belongs to the cell of its nearest pivot (a bounded sample of the centres, by the hash of their number).  Blocks of
    cells are compared with the blocks of all cells that one of their chunks reaches, from the higher cell to the lower one.
    Of the links of best nodes at most one for each chunk of a pair of blocks is returned.
    """
    reach = float(np.arccos(threshold)) + 1e-6
    heads = packed.select("region", "chunk", "centre", "radius", "best", "unit")
    some = heads.orderBy(F.xxhash64("chunk"), "chunk").limit(_PIVOTS).select("centre").toArrow()
    schema = "a long, b long, linked boolean"
    if not some.num_rows:
        return packed.sparkSession.createDataFrame([], schema)
    pivots = _matrix(some.column("centre").combine_chunks())

    def pieces(batch):
        return (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048))

    def settle(batches):
        for batch in (part for whole in batches for part in pieces(whole)):
            if batch.num_rows:
                apart = _angle(_matrix(batch.column("centre")) @ pivots.T)
                cell = apart.argmin(axis=1)
                far = apart[np.arange(len(cell)), cell] + batch.column("radius").to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    settled = stage(heads.mapInArrow(settle, "region long, chunk long, centre binary, radius double, best long, unit binary, cell int, far double"), "heads")
    cover = np.full(len(pivots), -np.inf)
    for r in settled.groupBy("cell").agg(F.max("far").alias("far")).collect():  # one row for each pivot
        cover[r["cell"]] = r["far"]

    def gather(batches):
        of, rows = None, []

        def out():
            if rows:
                centres = np.stack([np.frombuffer(r["centre"]) for r in rows])
                near = _angle(centres @ pivots.T) <= cover[None, :] + np.array([r["radius"] for r in rows])[:, None] + reach
                visits = np.flatnonzero(near.any(axis=0))
                lists = [pa.array([[r[c] for r in rows]]) for c in ("region", "chunk", "radius", "best")]
                yield pa.RecordBatch.from_arrays([pa.array([rows[0]["chunk"]], pa.int64()), pa.array([of], pa.int32()), pa.array([visits[visits <= of]], pa.list_(pa.int32())), *lists, *(pa.array([b"".join(r[c] for r in rows)], pa.binary()) for c in ("centre", "unit"))], ["block", "cell", "visits", "region", "chunk", "radius", "best", "centre", "unit"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != of or len(rows) >= _BLOCK:
                    yield from out()
                    of, rows = row["cell"], []
                rows.append(row)
        yield from out()

    spread = settled.repartitionByRange("cell", "chunk").sortWithinPartitions("cell", "chunk")
    blocks = stage(spread.mapInArrow(gather, "block long, cell int, visits array<int>, region array<long>, chunk array<long>, radius array<double>, best array<long>, centre binary, unit binary"), "blocks")

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                one, two = ({c: np.frombuffer(row[c + s]).reshape(len(row["chunk" + s]), -1) if c in ("centre", "unit") else np.array(row[c + s]) for c in ("region", "chunk", "radius", "best", "centre", "unit")} for s in ("", "2"))
                apart = one["region"][:, None] != two["region"][None, :]
                if row["block"] == row["block2"]:
                    apart = np.triu(apart)
                i, j = np.nonzero(apart & (_angle(one["centre"] @ two["centre"].T) <= one["radius"][:, None] + two["radius"][None, :] + reach))
                yield pa.RecordBatch.from_arrays([pa.array(one["chunk"][i]), pa.array(two["chunk"][j]), pa.array(np.zeros(len(i), dtype=bool))], ["a", "b", "linked"])
                s = apart & (one["unit"] @ two["unit"].T >= threshold)
                i, j = np.flatnonzero(s.any(axis=1)), np.flatnonzero(s.any(axis=0))
                i, j = np.concatenate([i, s.argmax(axis=0)[j]]), np.concatenate([s.argmax(axis=1)[i], j])
                yield pa.RecordBatch.from_arrays([pa.array(one["best"][i]), pa.array(two["best"][j]), pa.array(np.ones(len(i), dtype=bool))], ["a", "b", "linked"])

    # pairs of blocks by number, then their centres
    visits = blocks.select(F.col("block").alias("block2"), F.col("cell").alias("cell2"), F.explode("visits").alias("cell"))
    met = visits.join(blocks.select("block", "cell"), "cell").where("cell < cell2 or block <= block2").select("block", "block2")
    columns = ["region", "chunk", "radius", "best", "centre", "unit"]
    other = blocks.select(*(F.col(c).alias(c + "2") for c in ("block", *columns)))
    pairs = met.join(blocks.select("block", *columns), "block").join(other, "block2")
    out = stage(pairs.mapInArrow(compare, schema), "across")
    drop_stage(blocks)
    drop_stage(settled)
    return out


def _compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, to, more, near) of pairs of chunks.

    Where ``to`` is null: the links of a node, as copies and as nodes.  Else node and to are roots with a link between them.
    """
    reach = float(np.arccos(threshold))

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            edges = set()
            for row in batch.to_pylist():
                if _angle(np.frombuffer(row["centre"]) @ np.frombuffer(row["centre2"])) > row["radius"] + row["radius2"] + reach + 1e-6:
                    continue
                x, y = (np.frombuffer(row["x" + c]).reshape(len(row["ids" + c]), -1) for c in ("", "2"))
                s = x @ y.T >= threshold
                same = row["chunk"] == row["chunk2"]
                if same:
                    np.fill_diagonal(s, False)
                for ids, t, copies in ((row["ids"], s, row["copies2"]),) if same else ((row["ids"], s, row["copies2"]), (row["ids2"], s.T, row["copies"])):
                    near = t.sum(axis=1)
                    hit = np.flatnonzero(near)
                    out[0].append(np.array(ids, dtype=np.int64)[hit])
                    out[1].append((t @ np.array(copies, dtype=np.int64))[hit])
                    out[2].append(near[hit])
                r1, r2 = np.array(row["roots"]), np.array(row["roots2"])
                i, j = np.nonzero(s & (r1[:, None] != r2[None, :]))
                if len(i):
                    edges.update(map(tuple, np.unique(np.stack([r1[i], r2[j]], axis=1), axis=0).tolist()))
            node, more, near = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out[:3])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.nulls(len(node), pa.int64()), pa.array(more, pa.int64()), pa.array(near, pa.int64())], ["node", "to", "more", "near"])
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(a), pa.int64()), pa.array([0] * len(a), pa.int64())], ["node", "to", "more", "near"])

    return pairs.mapInArrow(run, "node long, to long, more long, near long").groupBy("node", "to").agg(F.sum("more").alias("more"), F.sum("near").alias("near"))


def _side(packed: DataFrame, suffix: str) -> DataFrame:
    return packed.select(*(F.col(c).alias(c + suffix) for c in ("chunk", "ids", "roots", "copies", "x", "centre", "radius")), "region")


def _regions(links: DataFrame, saturated: DataFrame, nodes: DataFrame, threshold: float, chunk: int = 256) -> tuple[DataFrame, DataFrame]:
    """(node, more, near), the links of every saturated node with all saturated nodes, as copies and as nodes; and edges (a, b) that join their regions."""
    inside = links.join(saturated.select(F.col("node").alias("a")), "a", "left_semi").join(saturated.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    full = saturated.join(nodes.select("node", "unit", "copies"), "node")

    def members(edges: DataFrame) -> DataFrame:
        return full.join(components(edges, "regions"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    packed = stage(_pack(members(inside).withColumn("region", F.col("root")).withColumn("by", F.lit(0)), chunk), "chunks")
    across = _across(packed, threshold)
    # regions whose best nodes link are one: their chunks then meet by the region, without a row for each pair
    joins = across.where("linked").select("a", "b")
    if joins.limit(1).count():
        first = packed.select(F.explode(F.arrays_zip("ids", "roots")).alias("m")).select(F.col("m.ids").alias("node"), F.col("m.roots").alias("by"))
        merged = members(inside.unionAll(joins)).withColumn("region", F.col("root")).join(first, "node")
        packed = stage(_pack(merged, chunk), "chunks")
        across = _across(packed, threshold)
    left, right = _side(packed, ""), _side(packed, "2")
    # a region's chunks are dealt into slices of about 64; every slice meets all chunks of the region
    slices = packed.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("slices"))
    one = left.join(slices, "region").withColumn("slice", F.pmod(F.xxhash64("chunk"), F.col("slices")).cast("int"))
    all_ = right.join(slices, "region").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    within = one.drop("slices").join(all_.drop("slices"), ["region", "slice"]).where("chunk <= chunk2").drop("region", "slice")
    pairs = across.where("not linked").select(F.col("a").alias("chunk"), F.col("b").alias("chunk2"))
    between = pairs.join(left.drop("region"), "chunk").join(right.drop("region"), "chunk2").select(*within.columns)
    counted = _compared(within, threshold).unionByName(_compared(between, threshold))
    counted = stage(counted, "region-links")
    more = counted.where("to is null").groupBy("node").agg(F.sum("more").alias("more"), F.sum("near").alias("near"))
    return more, joins.unionAll(counted.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))


def _saturated(lists: DataFrame, k: int, threshold: float, margin: float) -> DataFrame:
    """(node) of full lists whose worst entry may be a link in eight bits: further links may have found no place."""
    return lists.groupBy(F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("worst")).where((F.col("n") >= k) & (F.col("worst") >= threshold - margin)).select("node")


def _found(links: DataFrame, saturated: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, more, near), all links found of each node, as copies and as nodes; and edges (a, b) beside the listed links."""
    region_links, joins = _regions(links, saturated, nodes, threshold)
    # of a saturated node's listed links, those with saturated nodes are counted by the regions
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    marked = saturated.select(F.col("node"), F.lit(True).alias("full"))
    listed = ends.join(marked, "node", "left").join(marked.select(F.col("node").alias("to"), F.col("full").alias("to_full")), "to", "left")
    listed = listed.where("full is null or to_full is null").join(nodes.select(F.col("node").alias("to"), F.col("copies")), "to").groupBy("node").agg(F.sum("copies").alias("more"), F.count(F.lit(1)).alias("near"))
    return listed.unionByName(region_links).groupBy("node").agg(F.sum("more").alias("more"), F.sum("near").alias("near")), joins


def near_duplicates(rows: DataFrame, threshold: float = 0.9, k: int = 16, orders: int = 8, block: int = 256, max_rounds: int = 6, least_recall: float = 0.99, audited: int = 512, searches: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings(vec_id, embedding)."""
    keyed = stage(_usable(rows), "vectors")
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    # written once: a node's number stays the same
    nodes = stage(_units(classes.select("node", "key", "low", "copies")), "nodes")
    widths = [r[0] for r in nodes.select(F.octet_length("key")).distinct().collect()]
    known = [_searched(nodes.where(F.octet_length("key") == w), w // 8, threshold, k, orders, block, max_rounds, least_recall, audited, searches) for w in sorted(widths)]
    none = nodes.where("false").select("key", "copies", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("more"))
    known = functools.reduce(DataFrame.unionByName, known, none).select("key", "copies", F.col("copies").alias("size"), "component_id", "more")
    out = matched(keyed, known, ["key"], "copies")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    n_links = F.coalesce(F.col("more") + F.col("size") - 1, F.lit(0))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _searched(nodes: DataFrame, dim: int, threshold: float, k: int, orders: int, block: int, max_rounds: int, least_recall: float, audited: int, searches: int) -> DataFrame:
    """(key, copies, component_id, more) of nodes of one dimension: more counts links with other nodes, as copies."""
    total, worst = nodes.agg(F.count(F.lit(1)), F.max("error")).first()
    # two vectors of length one, each off by at most ``worst``: their product is off by at most worst * (2 + worst)
    margin = worst * (2 + worst) + 1e-6
    changed_below = 0.002
    lists = None
    for search in range(searches):
        size = k << search
        begun = _start(nodes, dim, size, orders, block, 5 + search)
        lists = stage(_best(begun if lists is None else begun.unionByName(lists), size), "lists")
        for _ in range(max_rounds):
            found = _round(lists, nodes, size)
            new = stage(_best(found.unionByName(lists), size), "lists")
            changed = new.join(lists.select("v", "u"), ["v", "u"], "left_anti").where(F.col("sim") >= threshold - margin).count()
            drop_stage(lists)
            lists = new
            if changed <= changed_below * total:
                break
        links = stage(_listed(lists, nodes, threshold, margin), "links")
        saturated = stage(_saturated(lists, size, threshold, margin), "saturated")
        counted, joins = _found(links, saturated, nodes, threshold)
        counted = stage(counted, "counted")
        recall = audit(nodes, counted, threshold, audited)
        _LOG.info("dimension %d, lists of %d: recall %.4f on %d audited nodes", dim, size, recall, min(audited, total))
        if recall >= least_recall:
            break
    else:
        counted, joins = _found(links, nodes.select("node"), nodes, threshold)
        counted = stage(counted, "counted")
    roots = components(links.select("a", "b").unionAll(joins))
    whole = nodes.select("node", "key", "low", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    return whole.join(lowest, "root").join(counted, "node", "left").select("key", "copies", "component_id", F.coalesce("more", F.lit(0)).cast("long").alias("more"))
