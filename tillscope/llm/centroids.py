"""Exact k-means over integer vectors with ns-bounds (bounds loosened by the norm of a total displacement).

The centres of all rounds are kept. A row remembers its distance to every centre as last worked out, and in
which round that was. Since then a centre has moved from where it was to where it is, however it got there, so a stored
distance can have shrunk or grown by no more than the norm of that difference. Only centres whose bounds
leave open which is nearest are measured again, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.exprs import is_finite
from tillscope.session import drop_staged, stage

DIMENSIONS, CENTRES, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components (after scaling) beyond this have squared distances beyond a long.
MOST_COMPONENT = 1 << 26
#: Bounds are doubles: what they may be off by, as a share, and then some.
SLACK = 1e-9
#: Rows worked on together.
BLOCK = 8192


def integer_vectors(df: DataFrame, dimensions: int, scale: int, vector: str, key: str) -> DataFrame:
    """``id`` and ``x`` (scaled, rounded down) of all rows whose vector has ``dimensions`` finite components."""
    v = F.col(vector)
    sound = (F.size(v) == dimensions) & F.forall(v, is_finite)
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    small = F.forall(v, lambda c: F.abs(c.cast("double") * scale) < MOST_COMPONENT)
    whole = F.when(small, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit("component too large for exact distances")))
    return df.where(v.isNotNull() & sound).select(F.col(key).cast("long").alias("id"), whole.alias("x"))


def nearest_centres(
    x: np.ndarray, history: np.ndarray, cluster: np.ndarray, squared: np.ndarray, when: np.ndarray
) -> tuple[np.ndarray, int]:
    """The nearest of the last centres (ties: smaller number) for each row of ``x``, and how many distances were worked out.

    ``history`` has the centres of every round, ``cluster`` the nearest one before. ``squared`` and ``when``, squared distances to
    each centre and the round of each (-1: never), are brought up to date where a distance is worked out.
    """
    now, k = len(history) - 1, history.shape[1]
    rows, measured = np.arange(len(x)), 0

    def measure(which: np.ndarray, centre: int) -> None:
        nonlocal measured
        squared[which, centre] = ((x[which] - history[now, centre]) ** 2).sum(axis=1)
        when[which, centre] = now
        measured += len(which)

    for c in range(k):
        measure(np.flatnonzero(when[:, c] < 0), c)
    # how far each centre lies from where it was in each round
    displaced = np.sqrt(((history - history[now]) ** 2).sum(axis=2).astype(float))
    apart = displaced[when, np.arange(k)]
    known = np.sqrt(squared.astype(float))
    lower = (known - apart) * (1 - SLACK) - SLACK
    upper = (known + apart)[rows, cluster] * (1 + SLACK) + SLACK
    rival = lower <= upper[:, None]
    rival[rows, cluster] = False
    failed = np.flatnonzero(rival.any(axis=1))
    for c in range(k):  # the own centre first: an exact distance rules others out
        measure(failed[(cluster[failed] == c) & (when[failed, c] < now)], c)
    own = np.sqrt(squared[failed, cluster[failed]].astype(float)) * (1 + SLACK) + SLACK
    rival = lower[failed] <= own[:, None]
    for c in range(k):
        measure(failed[rival[:, c] & (when[failed, c] < now)], c)
    exact = np.where(when[failed] == now, squared[failed], np.iinfo(np.int64).max)
    cluster = cluster.copy()
    cluster[failed] = exact.argmin(axis=1)  # the first of equal ones
    return cluster, measured


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


_STATE = ["id", "x", "was", "cluster", "squared", "round"]


def _assigned(state: DataFrame, history: np.ndarray) -> DataFrame:
    """The rows with the nearest of the last centres (``cluster``) and the one before (``was``, -1 at first)."""
    k, width = history.shape[1:]
    fresh = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                n = part.num_rows
                if fresh:
                    was, squared, when = np.full(n, -1), np.zeros((n, k), np.int64), np.full((n, k), -1)
                else:
                    was = part.column(3).to_numpy().astype(np.int64)
                    squared, when = _matrix(part.column(4), k), _matrix(part.column(5), k)
                cluster, _ = nearest_centres(_matrix(part.column(1), width), history, np.maximum(was, 0), squared, when)
                mine = [pa.array(was.astype(np.int32)), pa.array(cluster.astype(np.int32))]
                lists = [_lists(squared), _lists(when.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *mine, *lists], _STATE)

    rows = state.select("id", "x") if fresh else state.select(*_STATE)
    kind = "id long, x array<int>, was int, cluster int, squared array<long>, round array<int>"
    return rows.mapInArrow(run, kind)


def _changes(state: DataFrame, k: int, width: int) -> np.ndarray:
    """Rows (first column) and component sums that each centre gained or lost by the rows that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            was, cluster = (batch.column(i).to_numpy() for i in (1, 2))
            for c in range(k):
                for some, sign in ((cluster == c, 1), (was == c, -1)):
                    total[c, 0] += sign * np.count_nonzero(some)
                    total[c, 1:] += sign * x[some].sum(axis=0)
        at = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["c", "i", "n"])

    moved = state.where("cluster <> was").select("x", "was", "cluster")
    parts = moved.mapInArrow(run, "c int, i int, n long").groupBy("c", "i").agg(F.sum("n").alias("n"))
    total = np.zeros((k, width + 1), object)
    for r in parts.collect():
        total[r["c"], r["i"]] = r["n"]
    return total


def cluster_vectors(
    df: DataFrame,
    order: Column,
    centres: int = CENTRES,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    vector: str = "embedding",
    key: str = "vec_id",
) -> DataFrame:
    """Exact k-means of the vectors with ``dimensions`` finite components, as whole numbers floor(``scale`` * component).

    The first ``centres`` vectors by ``order`` (rows without key can't be among them) are the first centres. Each of
    ``rounds`` rounds assigns every vector to the nearest centre (ties: smaller number) and moves every centre with vectors to their
    mean, rounded down by component; then vectors are assigned once more. Returns ``key``, ``cluster``, ``distance``
    (squared), ``cluster_inertia`` and ``inertia`` (distances summed over the cluster and over all) and ``centroid``.
    Null vectors and those of other lengths or with null, NaN or infinite components give no row; repeated rows and rows without
    key each give one. Fewer vectors than centres are all centres; without any the result is empty. Components beyond
    ``MOST_COMPONENT`` raise an error, as their distances are beyond a long.

    Every round reads the rows' state, writes the next one and sums the rows that moved; only sums per centre reach the driver.
    A round's table is deleted once the next is written.
    """
    rows = integer_vectors(df, dimensions, scale, vector, key)
    first = rows.where("id is not null").orderBy(order, "x").limit(centres).collect()
    spark = df.sparkSession
    if not first:
        kind = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return spark.createDataFrame([], kind)
    history = np.array([[r["x"] for r in first]], np.int64)
    total = np.zeros((len(first), dimensions + 1), object)
    state = rows
    for _ in range(rounds):
        before, state = state, stage(_assigned(state, history), "centroids")
        if before is not rows:
            drop_staged(before)
        total = total + _changes(state, len(first), dimensions)
        last = history[-1]
        moved = [[s // row[0] for s in row[1:]] if row[0] else last[c].tolist() for c, row in enumerate(total)]
        history = np.concatenate([history, np.array([moved], np.int64)])
        if (history[-1] == last).all():
            break  # the rest of the rounds changes nothing
    final = stage(_measured(_assigned(state, history), history[-1]), "clusters")
    if state is not rows:
        drop_staged(state)
    sums = {r["cluster"]: r["n"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    table = [(c, n, sum(sums.values()), history[-1][c].tolist()) for c, n in sums.items()]
    per_centre = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return final.join(F.broadcast(per_centre), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def _measured(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and the exact squared distance of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = _matrix(batch.column(1), centres.shape[1]), batch.column(2)
            distance = ((x - centres[cluster.to_numpy()]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), cluster, pa.array(distance)], ["id", "cluster", "distance"])

    return rows.select("id", "x", "cluster").mapInArrow(run, "id long, cluster int, distance long")
