"""Hard negatives of anchors by cover trees over norm-augmented vectors.

Every candidate x gets one more component, sqrt(M^2 - |x|^2), where M is the largest norm; an anchor q gets a zero.  Then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so that the inner product is bounded from both sides by the distance to a node's centre and
the node's covering radius.  A node whose bounds lie outside the window of wanted scores, or under the k-th best score found so
far, is skipped with all below it; what is left is visited best bound first, and the rows of leaves are verified exactly.

The top of the tree is a sample of centres, to which all candidates are dealt; the candidates of a centre (or a share of
them, where they are many) make one block with a cover tree of its own, built once and stored in one row.  Anchors go to the block of their best
bound first, and then, with the scores found there, to those blocks that may still hold better ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbook.llm.text import arrow_rows
from tarnbook.session import cut_lineage

SCALE = 256.0
LARGEST = 1 << 23  # components stop there, so that inner products fit in a long
BLOCK_ROWS = 8192
MOST_CENTERS = 2048
LEAF_ROWS = 32
BASE = 1.3
ANCHOR_BATCH = 1000
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, OF = 30, 90, 100


# --- the tree of a block ----------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes from the root on: centre (a row), covering radius, range in ``order``, parent, and whether it is a leaf."""

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray


def cover_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS, base: float = BASE) -> Tree:
    """A cover tree: each level covers a node's rows by balls ``base`` times smaller, the first around the node's own centre.

    Radii are then drawn tight.  A node ends as a leaf when it has few rows, or when smaller balls would hold few rows
    each (rows about equally far from each other have no cover worth descending).
    """
    order, nodes = np.arange(len(points)), []
    todo = [(0, len(points), -1)] if len(points) else []
    while todo:
        begin, end, parent = todo.pop()
        rows = order[begin:end]
        far = np.linalg.norm(points[rows] - points[rows[0]], axis=1)
        radius, at = float(far.max()), len(nodes)
        nodes.append([int(rows[0]), radius, begin, end, parent, True])
        if end - begin <= leaf_rows or radius == 0.0:
            continue
        most, reach, groups = max(8, (end - begin) // (leaf_rows // 2)), radius / base, []
        left = np.arange(end - begin)
        while len(left) and len(groups) <= most:
            near = far[left] <= reach if not groups else np.linalg.norm(points[rows[left]] - points[rows[left[0]]], axis=1) <= reach
            groups.append(left[near])
            left = left[~near]
        if len(left) or len(groups) == 1:
            continue
        nodes[at][5] = False
        order[begin:end] = rows[np.concatenate(groups)]
        for group in groups:
            todo.append((begin, begin + len(group), at))
            begin += len(group)
    columns = [np.array(c) for c in zip(*nodes)] if nodes else [np.zeros(0, dtype=int)] * 6
    return Tree(order, columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4].astype(np.int64), columns[5].astype(bool))


def augmented(q: np.ndarray, most2: float) -> np.ndarray:
    """Rows with the component that makes all norms equal."""
    q = q.astype(np.float64)
    return np.column_stack([q, np.sqrt(np.maximum(0.0, most2 - (q * q).sum(axis=1)))])


def score_bounds(queries: np.ndarray, centers: np.ndarray, radius: np.ndarray, most2: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with anything within ``radius`` of (augmented) centres."""
    q = queries.astype(np.float64)
    both = (q * q).sum(axis=1)[:, None] + most2
    far = np.sqrt(np.maximum(0.0, both - 2.0 * (q @ centers[:, :-1].T)))
    slack = 1e-9 * both + 1e-3  # rounding never hides a row
    return (both - (far + radius) ** 2) / 2 - slack, (both - np.maximum(0.0, far - radius) ** 2) / 2 + slack


class Found:
    """The best ``k`` rows of each query so far."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()  # scores below do not matter
        self.rows = [np.zeros(0, dtype=np.int64)] * 3  # query, candidate, score

    def add(self, query: list[np.ndarray], row: list[np.ndarray], score: list[np.ndarray], rank: np.ndarray) -> None:
        q, r, s = (np.concatenate([old, *new]) for old, new in zip(self.rows, (query, row, score)))
        order = np.lexsort((rank[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        keep = place < self.k
        self.rows = [q[keep], r[keep], s[keep]]


class Block:
    """Candidates with their cover tree."""

    def __init__(self, uid: np.ndarray, vec_id: pa.Array, label: np.ndarray, q: np.ndarray, tree: Tree, most2: float):
        self.uid, self.label, self.q, self.tree, self.most2 = uid, label, q.astype(np.float64), tree, most2
        self.vec_id = vec_id
        # Ties by the smaller id, a null last, then by the row.
        ids = vec_id.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((uid, ids, vec_id.is_null().to_numpy(zero_copy_only=False)))
        self.rank = np.empty(len(uid), dtype=np.int64)
        self.rank[order] = np.arange(len(uid))
        self.exact = bool(np.abs(q).max(initial=0) ** 2 * max(1, q.shape[1]) < 1 << 52)
        self.whole = q.astype(np.int64)
        self.centers = augmented(q[tree.center], most2)

    def scores(self, queries: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        if self.exact and float(np.abs(queries).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * self.q.shape[1] < 1 << 52:
            return np.rint(queries.astype(np.float64) @ self.q[rows].T).astype(np.int64)
        return queries.astype(np.int64) @ self.whole[rows].T

    def search(self, uid: np.ndarray, queries: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of the best ``k`` rows of each query with scores from ``low`` to ``high``, of its own label or of others.

        Nodes are closed from the root down; then each query visits its open leaves, best bound first, one, two, four ... at a
        time, as long as their bounds reach its k-th best score.
        """
        tree = self.tree
        below, above = score_bounds(queries, self.centers, tree.radius, self.most2)
        is_open = (above >= np.maximum(low, least)[:, None]) & (below <= high[:, None])
        for node in range(1, len(tree.parent)):  # parents come first
            is_open[:, node] &= is_open[:, tree.parent[node]]
        leaves = np.flatnonzero(tree.leaf)
        bound = np.where(is_open[:, leaves], above[:, leaves], -np.inf)
        by_bound = np.argsort(-bound, axis=1, kind="stable")
        found, done, step = Found(least, k), 0, 1
        while done < len(leaves):
            turn = by_bound[:, done : done + step]
            reach = np.take_along_axis(bound, turn, axis=1)
            q, column = np.nonzero((reach > -np.inf) & (reach >= found.least[:, None]))
            if not len(q):
                break  # bounds fall along the order
            leaf, parts = turn[q, column], ([], [], [])
            order = np.argsort(leaf, kind="stable")
            q, leaf = q[order], leaf[order]
            for lo, hi in zip(*(e.tolist() for e in _ranges(leaf))):
                mine, node = q[lo:hi], leaves[leaf[lo]]
                rows = tree.order[tree.begin[node] : tree.end[node]]
                score = self.scores(queries[mine], rows)
                alike = label[mine, None] == self.label[rows]
                ok = (alike if same else ~alike) & (score >= np.maximum(low, found.least)[mine, None]) & (score <= high[mine, None]) & (uid[mine, None] != self.uid[rows])
                a, b = np.nonzero(ok)
                for part, values in zip(parts, (mine[a], rows[b], score[a, b])):
                    part.append(values)
            found.add(*parts, self.rank)
            done, step = done + step, step * 2
        return tuple(found.rows)


def _ranges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return begin, np.append(begin[1:], len(values))


# --- candidates in blocks ---------------------------------------------------------------------------------------------


def whole_vectors(table: DataFrame, id_col: str, vec: str, label: str, scale: float) -> DataFrame:
    """``vec_id, label long, q array<int>``: the rows that take part, components scaled and rounded down.

    Rows with a null label, a null vector, or a null, NaN or infinite component are left out; a null id stays.
    """
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(vec, lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(scale), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    rows = table.where(F.col(label).isNotNull() & F.col(vec).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), scaled.alias("q"))


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows, zeros after the end of shorter ones."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), dtype=np.int32)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _planes(q: np.ndarray) -> bytes:
    """Numbers of the smallest fitting size, first bytes first: alike bytes stand together and pack well."""
    size = 2 if np.abs(q).max(initial=0) < 1 << 15 else 4
    return bytes([size]) + q.astype(f"<i{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def _unplaned(body: bytes, dims: int) -> np.ndarray:
    size = body[0]
    return np.frombuffer(body, np.uint8, -1, 1).reshape(size, -1).T.copy().view(f"<i{size}").reshape(-1, dims).astype(np.int32)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


@dataclass
class Candidates:
    """Stored candidates: ``rows`` (uid, vec_id, label, q), ``blocks`` (block, body) and the top of the tree."""

    rows: DataFrame
    blocks: DataFrame
    centers: np.ndarray
    radius: np.ndarray
    shares: np.ndarray
    dims: int
    most2: float


def index(vectors: DataFrame, block_rows: int = BLOCK_ROWS, most_centers: int = MOST_CENTERS, leaf_rows: int = LEAF_ROWS, base: float = BASE) -> Candidates | None:
    """Deal candidates (``vec_id, label, q``) to centres and build a cover tree for each block; None for an empty table.

    The centres are a sample by hash of one row in ``block_rows``, ``most_centers`` at most; they and their radii are all the
    driver sees.  A centre with more than ``block_rows`` candidates is dealt to several blocks by hash of the row, so that neither a crowd
    of copies nor a large table makes a large block.
    """
    spark = vectors.sparkSession
    arrow_rows(spark)
    norm2 = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    n, dims, most2 = vectors.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(norm2)).first()
    if not n:
        return None
    dims, most2 = max(1, dims), float(most2)
    wanted = min(most_centers, -(-n // block_rows))
    sample = vectors.select("q").orderBy(F.xxhash64("vec_id", "q")).limit(wanted).toArrow().column("q").combine_chunks()
    centers = augmented(np.unique(_matrix(sample, dims), axis=0), most2)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), dims)
            rows = augmented(q, most2)
            center = np.argmax(rows @ centers.T, axis=1)  # all norms are equal
            far = np.linalg.norm(rows - centers[center], axis=1)
            body = pa.array([_planes(r) for r in q], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "vec_id", "label")), body, pa.array(center, pa.int64()), pa.array(far)], names=["uid", "vec_id", "label", "q", "center", "far"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "q")
    rows = cut_lineage(numbered.mapInArrow(dealt, "uid long, vec_id long, label long, q binary, center long, far double"))
    radius, shares = np.full(len(centers), -1.0), np.zeros(len(centers), dtype=np.int64)
    for r in rows.groupBy("center").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["center"]], shares[r["center"]] = r["far"] + 1e-6, -(-r["n"] // block_rows)
    used = shares > 0
    firsts = (np.cumsum(shares) - shares).tolist()
    places = F.array(*[F.lit(f) for f in firsts])
    many = F.array(*[F.lit(int(s)) for s in np.maximum(shares, 1)])
    at = F.col("center").cast("int")
    block = F.get(places, at) + F.pmod(F.xxhash64("uid"), F.get(many, at))

    def built(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        q = np.concatenate([_unplaned(b, dims) for b in table.column("q").to_pylist()])
        tree = cover_tree(augmented(q, most2), leaf_rows, base)
        rows = pa.record_batch([table.column(c).chunk(0) for c in ("uid", "vec_id", "label")], names=["uid", "vec_id", "label"])
        nodes = pa.record_batch([pa.array(c) for c in (tree.center, tree.radius, tree.begin, tree.end, tree.parent, tree.leaf)], names=["center", "radius", "begin", "end", "parent", "leaf"])
        columns = [pa.array([table.column("block")[0].as_py()], pa.int64()), *(pa.array([b], pa.binary()) for b in (_ipc(rows), _planes(q), tree.order.astype("<i4").tobytes(), _ipc(nodes)))]
        return pa.Table.from_arrays(columns, names=["block", "rows", "q", "order", "nodes"])

    packed = rows.withColumn("block", block).groupBy("block").applyInArrow(built, "block long, rows binary, q binary, order binary, nodes binary")
    return Candidates(rows.select("uid", "vec_id", "label", "q"), cut_lineage(packed), centers[used], radius[used], shares[used], dims, most2)


def _unpacked(row: dict, dims: int, most2: float) -> Block:
    rows, nodes = (pa.ipc.open_stream(row[c]).read_next_batch() for c in ("rows", "nodes"))
    tree = Tree(np.frombuffer(row["order"], "<i4").astype(np.int64), *(nodes.column(c).to_numpy(zero_copy_only=False) for c in ("center", "radius", "begin", "end", "parent", "leaf")))
    return Block(rows.column("uid").to_numpy(), rows.column("vec_id"), rows.column("label").to_numpy(), _unplaned(row["q"], dims), tree, most2)


# --- search -----------------------------------------------------------------------------------------------------------

_HITS = "qid long, window int, uid long, vec_id long, score long"


def _visit(found: Candidates, queries: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
    """The best rows of ``queries`` in the block of their best bound (``first``), or in all others that may hold better ones."""
    centers, radius, shares, dims, most2 = found.centers, found.radius, found.shares, found.dims, found.most2
    firsts = np.cumsum(shares) - shares

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            q = np.concatenate([_unplaned(b, dims) for b in batch.column("q").to_pylist()])
            below, above = score_bounds(q, centers, radius, most2)
            best = np.argmax(above, axis=1)
            low, high, least = (batch.column(c).to_pylist() for c in ("low", "high", "least"))
            least_of = np.array([min((max(l, m) for l, m, h in zip(*w) if l <= h), default=np.inf) for w in zip(low, least, high)], dtype=float)
            most_of = np.array([max((h for l, h in zip(*w) if l <= h), default=-np.inf) for w in zip(low, high)], dtype=float)
            wanted = (above >= least_of[:, None]) & (below <= most_of[:, None])
            is_best = np.arange(len(centers)) == best[:, None]
            a, c = np.nonzero(wanted & (is_best if first else ~is_best))
            n = shares[c]
            upto = np.append(0, np.cumsum(n))
            block = np.repeat(firsts[c] - upto[:-1], n) + np.arange(upto[-1])
            part = batch.take(pa.array(np.repeat(a, n)))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *part.columns], names=["block", *batch.schema.names])

    fields = "qid long, label long, q binary, low array<long>, high array<long>, least array<long>"
    arrow_rows(queries.sparkSession)
    asked = queries.select("qid", "label", "q", "low", "high", "least").mapInArrow(routed, "block long, " + fields)
    both = found.blocks.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    placed = both.repartition("block").sortWithinPartitions("block", "asks")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, block = None, None, None
        for batch in batches:
            ids, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(ids):
                if not asks[at]:
                    now, block, stored = ids[at], None, {c: batch.column(c)[at].as_py() for c in ("rows", "q", "order", "nodes")}
                    at += 1
                    continue
                to = at
                while to < len(ids) and asks[to] and ids[to] == ids[at]:
                    to += 1
                if ids[at] == now:
                    block = block or _unpacked(stored, dims, most2)
                    yield _searched(block, batch.slice(at, to - at), dims, same, k)
                at = to

    return placed.mapInArrow(searched, _HITS)


def _searched(block: Block, asked: pa.RecordBatch, dims: int, same: bool, k: int) -> pa.RecordBatch:
    low, high, least = (asked.column(c).to_pylist() for c in ("low", "high", "least"))
    which = np.array([(a, w) for a, ws in enumerate(low) for w, l in enumerate(ws) if l <= high[a][w]], dtype=np.int64).reshape(-1, 2)
    a, w = which[:, 0], which[:, 1]
    q = np.concatenate([_unplaned(b, dims) for b in asked.column("q").to_pylist()])
    flat = [np.array([v[x][y] for x, y in which.tolist()], dtype=np.int64) for v in (low, high, least)]
    qid = asked.column("qid").to_numpy()
    query, row, score = block.search(qid[a], q[a], asked.column("label").to_numpy()[a], *flat, same, k)
    return pa.RecordBatch.from_arrays(
        [pa.array(qid[a[query]]), pa.array(w[query], pa.int32()), pa.array(block.uid[row]), block.vec_id.take(pa.array(row)), pa.array(score)], names=["qid", "window", "uid", "vec_id", "score"]
    )


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(found: Candidates, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """``qid, window, rank, uid, vec_id, score``: the first ``k`` rows of each window of each query (``qid, label, q, low, high``).

    ``qid`` is the uid of the query's own row, which is no hit.  Higher scores come first, ties by smaller id.
    """
    start = queries.withColumn("least", F.col("low"))
    near = cut_lineage(_best(_visit(found, start, same, k, True), k))
    if len(found.centers) == 1:
        return near
    reached = near.where(F.col("rank") == k).groupBy(F.col("qid").alias("__qid")).agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    known = start.join(reached, F.col("qid") == F.col("__qid"), "left")
    least = F.transform("low", lambda x, i: F.coalesce(F.get(F.map_values(F.map_filter("reached", lambda w, s: w == i)), F.lit(0)), x))
    rest = _visit(found, known.withColumn("least", least), same, k, False)
    return cut_lineage(_best(near.drop("rank").unionByName(rest), k))


def _floor_div(a: Column, b: int) -> Column:
    """Whole-number division that rounds down; exact for every long."""
    return ((a - F.pmod(a, F.lit(b))).cast("decimal(38,0)") / F.lit(b)).cast("long")


def hard_negatives(
    table: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, of: int = OF, scale: float = SCALE, **sizes: int,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its first ``positives`` other rows of the same label by inner product; for each of them the first
    ``negatives`` rows of other labels are returned whose score s has ``low`` * p <= ``of`` * s <= ``high`` * p, p being the positive's
    score.  ``is_anchor`` is a condition on the prepared column ``vec_id``; a null is no anchor.

    Higher scores come first, ties by smaller id, a null id last.  Rows that share an id are separate rows: a copy of an anchor may
    be its positive, and repeated anchors give repeated results.  Vectors of different lengths are as if zeros followed the shorter one; an
    empty one scores 0.  Components stop at plus and minus ``LARGEST`` after scaling.  An empty table gives no rows.
    """
    spark = table.sparkSession
    found = index(whole_vectors(table, id_col, vec, label, scale), **sizes)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = found.rows.where(is_anchor).withColumnRenamed("uid", "qid")
    lowest, highest = F.array(F.lit(-(1 << 62)).cast("long")), F.array(F.lit(1 << 62).cast("long"))
    near = search(found, anchors.select("qid", "label", "q", lowest.alias("low"), highest.alias("high")), True, positives)
    p = F.col("score")
    windows = near.select("qid", "rank", (-_floor_div(-p * low, of)).alias("low"), _floor_div(p * high, of).alias("high"))
    windows = windows.groupBy(F.col("qid").alias("__qid")).agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    asked = anchors.join(windows, F.col("qid") == F.col("__qid")).select("qid", "label", "q", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    hits = search(found, asked, False, negatives)
    hits = hits.select(F.col("qid").alias("n_qid"), "window", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.join(anchors.select("qid", F.col("vec_id").alias("anchor_id")), "qid").select("qid", "anchor_id", F.col("rank").alias("p_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The windows of an anchor stand in the order of its positives' ranks, which have no gaps.
    return hits.join(pairs, (F.col("n_qid") == F.col("qid")) & (F.col("window") + 1 == F.col("p_rank"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
