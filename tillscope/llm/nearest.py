"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import stage

#: Rows that the tree is fitted on, those of the smallest hash; every row is indexed.
SAMPLE_ROWS = 20_000
#: Most children of a node, and sampled rows that a leaf needs.
BRANCHES, LEAF_SAMPLE = 8, 8
#: A leaf should hold so large a power of the number of rows: what leaves answer grows slower than the rows.
LEAF_POWER = 0.7
#: Recall to reach on the calibrating queries, and how many they are.
RECALL, CALIBRATING = 0.97, 256
#: Rows of either side of a block that one task compares.
BLOCK_ROWS = 8192


@dataclass
class Tree:
    """Nodes in one list; a node without children is a leaf with a number."""

    centers: list[np.ndarray] = field(default_factory=list)  # of the children
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every vector: down to the nearest child at every node."""
        out = np.empty(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centers[node]
            best = ((c**2).sum(axis=1) - 2 * (x[rows] @ c.T)).argmin(axis=1)
            waiting += [(child, rows[best == i]) for i, child in enumerate(self.children[node])]
        return out

    def bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for a query, most promising first: a priority queue over the open branches."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
                continue
            for near, child in zip((self.centers[node] @ q).tolist(), self.children[node]):
                heapq.heappush(queue, (-near, child))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the centre of each row; starts from rows far from each other."""
    centers = x[[rng.integers(len(x))]]
    away = ((x - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k and away.sum() > 0:
        centers = np.vstack([centers, x[rng.choice(len(x), p=away / away.sum())]])
        away = np.minimum(away, ((x - centers[-1]) ** 2).sum(axis=1))
    of = np.zeros(len(x), np.int64)
    for _ in range(12):
        of = ((centers**2).sum(axis=1) - 2 * (x @ centers.T)).argmin(axis=1)
        size = np.bincount(of, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        moved = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centers)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers, of


def grow(sample: np.ndarray, leaf_sample: int) -> Tree:
    """Splits the sample by k-means again and again, until a node holds few rows."""
    rng = np.random.default_rng(7)
    tree = Tree()

    def node(rows: np.ndarray) -> int:
        me = len(tree.children)
        tree.centers.append(np.zeros((0, sample.shape[1])))
        tree.children.append([])
        tree.leaf.append(-1)
        if len(rows) > leaf_sample:
            centers, of = _k_means(sample[rows], min(BRANCHES, -(-len(rows) // leaf_sample)), rng)
            used = np.unique(of)
            if len(used) > 1:
                tree.centers[me] = centers[used]
                tree.children[me] = [node(rows[of == i]) for i in used]
                return me
        tree.leaf[me] = tree.leaves
        tree.leaves += 1
        return me

    node(np.arange(len(sample)))
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest scores of every row; ties go to smaller ids."""
    if score.shape[1] > k:
        # all that reach the k-th score, then in order
        bound = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        r, c = np.nonzero(score >= bound[:, None])
    else:
        r, c = (i.ravel() for i in np.indices(score.shape))
    order = np.lexsort((ids[c], -score[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k]


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: with a key, the commonest number of components, all finite, not all zero."""
    v = F.col("v")
    whole = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        "id is not null and v is not null and size(v) > 0"
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = whole.where(finite & F.exists(v, lambda x: x != 0))
    common = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is not None:
        whole = whole.where(F.size("v") == common["d"])
    return whole.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def _indexed(rows: DataFrame, tree: Tree) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = sent.value.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["id", "v", "leaf"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, leaf long")


def _exact(rows: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a few queries, with their leaves: every row is compared where it lies."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                score = sent.value @ _matrix(batch.column(1)).T
                r, c = _best(score, ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r), pa.array(ids[c]), pa.array(score[r, c]), batch.column(2).take(pa.array(c))],
                    ["q", "id", "score", "leaf"],
                )

    found = rows.mapInArrow(run, "q long, id long, score double, leaf long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(tree: Tree, queries: np.ndarray, of: np.ndarray, leaf: np.ndarray, recall: float) -> int:
    """Leaves to visit: widened by one until enough of the true neighbours' leaves are among them."""
    place = np.zeros((len(queries), max(1, tree.leaves)), np.int64)
    for i, q in enumerate(queries):
        place[i, list(tree.bins(q))] = np.arange(tree.leaves)
    seen = place[of, leaf]
    visits = 1
    while visits < tree.leaves and np.mean(seen < visits) < recall:
        visits += 1
    return visits


def _visits(queries: DataFrame, tree: Tree, visits: int, size: dict[int, int], least: int) -> DataFrame:
    """A row for each query and leaf it visits: so many, and on until they hold ``least`` rows."""
    sent = queries.sparkSession.sparkContext.broadcast((tree, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, size = sent.value
        for batch in batches:
            row, leaf = [], []
            for i, q in enumerate(_matrix(batch.column(2))):
                held = 0
                for n, one in enumerate(tree.bins(q)):
                    if n >= visits and held >= least:
                        break
                    held += size.get(one, 0)
                    row.append(i)
                    leaf.append(one)
            took = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(leaf, pa.int64())], ["h1", "h2", "v", "leaf"])

    return queries.select("h1", "h2", "v").mapInArrow(run, "h1 long, h2 long, v array<double>, leaf long")


def _blocks(df: DataFrame, own: str, other: str, seed: str) -> DataFrame:
    """Deals a side's rows of a leaf over its blocks, once for each block of the other side."""
    block = F.pmod(F.xxhash64(seed), F.col(own)).alias(own)
    return df.select(
        *[c for c in df.columns if c not in (own, other)],
        block,
        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other),
    )


def search(
    df: DataFrame,
    every: int,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """The ``k`` nearest found, by inner product, of each row whose key is divisible by ``every``.

    Returns ``query_id``, ``rank``, ``vec_id`` and ``score``. Rows without key, with a vector that is null, zero, of another length than most or
    with null or non-finite components take no part. Repeated rows count once; a query's
    own key is never among its neighbours; ties go to the smaller key; fewer candidates than ``k`` are all returned.

    The tree is fitted on a bounded sample and every row is put in a leaf. Leaf visits
    widen until the recall on calibrating queries, against all rows, reaches ``recall``. Of equal vectors only the
    ``k + 1`` of the smallest keys can be neighbours, so a very common vector fills no leaf, and equal queries are searched
    once. Leaves that many rows or queries share are dealt over blocks.
    """
    spark = df.sparkSession
    rows = _usable(df, key, vector)
    same = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("rank", F.dense_rank().over(same)).where(F.col("rank") <= k + 1)
    few = stage(few.dropDuplicates(["id", "h1", "h2"]).drop("rank"), "vectors")
    n = few.count()
    sample = few.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow().combine_chunks()
    points = _matrix(sample["v"].combine_chunks() if isinstance(sample["v"], pa.ChunkedArray) else sample["v"])
    tree = grow(points, max(LEAF_SAMPLE, int(len(points) * n**LEAF_POWER / max(n, 1))))
    index = stage(_indexed(few, tree), "leaves")
    size = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}

    asked = rows.where(F.col("id") % every == 0).select("id", "h1", "h2", "v")
    queries = stage(asked.dropDuplicates(["h1", "h2"]).select("h1", "h2", "v"), "queries")
    some = queries.orderBy(F.xxhash64("h1")).limit(CALIBRATING).select("v").toArrow()["v"].combine_chunks()
    some = _matrix(some if not isinstance(some, pa.ChunkedArray) else some.combine_chunks())
    visits = 1
    if len(some):
        true = _exact(index, some, k + 1).toPandas()
        visits = calibrate(tree, some, true["q"].to_numpy(), true["leaf"].to_numpy(), recall)

    visited = stage(_visits(queries, tree, visits, size, k + 1), "visits")
    asks = {r["leaf"]: r["count"] for r in visited.groupBy("leaf").count().collect()}
    plan = [(x, -(-c // BLOCK_ROWS), -(-asks[x] // BLOCK_ROWS)) for x, c in size.items() if x in asks]
    plan = F.broadcast(spark.createDataFrame(plan, "leaf long, vb long, qb long"))
    left = _blocks(visited.join(plan, "leaf"), "qb", "vb", "h1")
    right = _blocks(index.join(plan, "leaf"), "vb", "qb", "id")

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        h1, h2, ids = (t[c].to_numpy() for t, c in ((q, "h1"), (q, "h2"), (v, "id")))
        parts = []
        if len(h1) and len(ids):
            x, y = (_matrix(t["v"].combine_chunks()) for t in (q, v))
            for at in range(0, len(x), 512):
                score = x[at : at + 512] @ y.T
                r, c = _best(score, ids, k + 1)
                parts.append((h1[at + r], h2[at + r], ids[c], score[r, c]))
        columns = [np.concatenate(p) for p in zip(*parts)] if parts else [[], [], [], []]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["h1", "h2", "vec_id", "score"])

    by = ("leaf", "vb", "qb")
    found = (
        left.groupBy(*by)
        .cogroup(right.groupBy(*by))
        .applyInArrow(compare, "h1 long, h2 long, vec_id long, score double")
    )
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    asked = asked.select(F.col("id").alias("query_id"), "h1", "h2").distinct()
    answered = asked.join(found, ["h1", "h2"]).where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answered.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
