"""KMeans of many periods, with many restarts and many k, advanced together.

Centres are keyed by (period, k, restart). One pass over the cached points moves the centres of
all of them one step: each task adds up its points per centre, and only those sums (a few numbers
per centre) are shuffled. Ten restarts of nine values of k in every month of a year
therefore cost the passes of a single fit. A few rounds over all points draw
candidates far apart in each period and weigh them; the centres start where they settle on
those, which leaves few passes over all points.

Points are kept in an order that keeps near ones together. A pass asks of every tile of such points whether one centre is
nearest to its whole bounding box; then the tile's sums stand for its points, and only the other tiles are worked on point by point.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tillscope.functions import exprs as X

# Tasks get the functions below by value; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Passes at most, and squared movement of the centres that ends them.
MAX_PASSES = 300
TOLERANCE = 1e-4
# Rounds in which starting points are drawn from all rows, and about how many each draws in a period.
OVERSAMPLING_ROUNDS, OVERSAMPLE = 2, 200
# Points of a tile, points that a task works on at once, and bits of each coordinate that order the points.
TILE = 64
CHUNK = 100_000
ORDER_BITS = 8


@dataclass
class _Fit:
    period: int
    k: int
    centers: np.ndarray
    cost: float = float("inf")
    done: bool = False


def _spread_start(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres drawn far apart: each with a chance in step with weight times squared distance."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    for _ in range(k - 1):
        nearest = weights * ((points[:, None, :] - np.array(chosen)) ** 2).sum(axis=2).min(axis=1)
        total = nearest.sum()
        if total == 0:  # fewer distinct points than centres
            break
        chosen.append(points[rng.choice(len(points), p=nearest / total)])
    return np.array(chosen)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point, and the squared distance to it."""
    squared = np.zeros((len(x), len(centers)))
    for i in range(x.shape[1]):  # few features; keeps the work on one core
        squared += (x[:, i, None] - centers[:, i]) ** 2
    label = squared.argmin(axis=1)
    return label, squared[np.arange(len(x)), label]


def _settle(points: np.ndarray, weights: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Moves the starting centres to rest on the weighted points."""
    for _ in range(MAX_PASSES):
        label, _ = _nearest(points, centers)
        count = np.bincount(label, weights, len(centers))
        total = np.column_stack([np.bincount(label, weights * c, len(centers)) for c in points.T])
        moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
        still = ((moved - centers) ** 2).sum() <= TOLERANCE
        centers = moved
        if still:
            break
    return centers


def _parts(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each period in a batch: period, their numbers in the batch, coordinates."""
    column = {n: batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("p", *names)}
    order = np.argsort(column["p"], kind="stable")
    cuts = np.flatnonzero(np.diff(column["p"][order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(column["p"][rows[0]]), rows, np.column_stack([column[n][rows] for n in names])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches, which have more tiles."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _candidates(points: DataFrame, names: Sequence[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per period points spread over all its rows, and how many rows are nearest to each.

    Rounds of oversampling: every row enters with a chance in step with its squared
    distance to the points of its period so far. Hashes of the rows decide, so the same rows come
    whatever the partitioning. All restarts start from these points.
    """
    first = points.groupBy("p").agg(F.min(F.struct("draw", *names)).alias("first")).select("p", "first.*").collect()
    found = {r["p"]: np.array([[r[n] for n in names]]) for r in first}

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(found, 0.0)
        for batch in batches:
            for p, _, x in _parts(batch, names):
                total[p] += float(_nearest(x, found[p])[1].sum())
        yield pa.RecordBatch.from_pydict({"p": pa.array(list(total), pa.int32()), "cost": pa.array(list(total.values()), pa.float64())})

    for round_ in range(OVERSAMPLING_ROUNDS):
        costs = points.mapInArrow(cost, "p int, cost double").groupBy("p").agg(F.sum("cost").alias("cost")).collect()
        total = {r["p"]: r["cost"] for r in costs if r["cost"] > 0}
        if not total:
            break

        def draw(batches: Iterator[pa.RecordBatch], total=total) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chance = batch.column(batch.schema.get_field_index("chance")).to_numpy()
                taken = [np.zeros(0, np.int64)]
                for p, rows, x in _parts(batch, names):
                    if p in total:
                        taken.append(rows[chance[rows] < OVERSAMPLE * _nearest(x, found[p])[1] / total[p]])
                yield batch.take(pa.array(np.concatenate(taken))).select(["p", *names])

        # every round has a hash of its own
        drawn = points.withColumn("chance", X.hash_fraction(F.col("draw"), F.lit(round_)))
        rows = drawn.mapInArrow(draw, "p int, " + ", ".join(f"{n} double" for n in names)).toPandas()
        for p, new in rows.groupby("p"):
            found[p] = np.unique(np.vstack([found[p], new[list(names)].to_numpy(dtype=float)]), axis=0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {p: np.zeros(len(c), np.int64) for p, c in found.items()}
        for batch in batches:
            for p, _, x in _parts(batch, names):
                n[p] += np.bincount(_nearest(x, found[p])[0], minlength=len(n[p]))
        for p, near in n.items():
            some = np.flatnonzero(near)
            columns = {"p": np.full(len(some), p, np.int32), "i": some.astype(np.int32), "n": near[some]}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    near = points.mapInArrow(count, "p int, i int, n long").groupBy("p", "i").agg(F.sum("n").alias("n")).toPandas()
    weighed = {}
    for p, rows in near.groupby("p"):
        rows = rows.sort_values("i")
        weighed[p] = (found[p][rows["i"].to_numpy()], rows["n"].to_numpy(dtype=float))
    return weighed


def _near_order(names: Sequence[str]) -> Column:
    """A number that is alike for near points: the interleaved leading bits of their squashed coordinates."""
    bits = max(1, min(ORDER_BITS, 62 // len(names)))
    number = F.lit(0).cast("long")
    for i, n in enumerate(names[:62]):
        x = F.col(n)
        step = F.floor((x / (F.abs(x) + 1) + 1) * F.lit(float(1 << bits - 1))).cast("long")
        step = F.greatest(F.least(step, F.lit((1 << bits) - 1)), F.lit(0))
        for b in range(bits):
            bit = F.shiftright(step, b).bitwiseAND(F.lit(1).cast("long"))
            number = number.bitwiseOR(F.shiftleft(bit, b * min(len(names), 62) + i))
    return number


def _packed(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """The coordinates of many points of a period in one value, so that a pass doesn't convert them point by point."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            for p, _, x in _parts(batch, names):
                yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    return points.select("p", *names).mapInArrow(pack, "p int, x binary")


class _Tiles:
    """Stretches of points with their bounding boxes and sums."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.first = np.arange(0, len(x), TILE)
        self.count = np.diff(np.append(self.first, len(x))).astype(float)
        self.low, self.high = (f.reduceat(x, self.first, axis=0) for f in (np.minimum, np.maximum))
        self.total = np.add.reduceat(x, self.first, axis=0)
        self.mean = self.total / self.count[:, None]
        off = x - np.repeat(self.mean, self.count.astype(int), axis=0)
        self.spread = np.add.reduceat((off * off).sum(axis=1), self.first)  # squared distances from the mean
        self.reach = np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1)

    def sums(self, centers: np.ndarray) -> np.ndarray:
        """Per centre: its points, their squared distances and their coordinates, added up."""
        label, _ = _nearest((self.low + self.high) / 2, centers)
        own = centers[label]
        # by how much another centre may be nearer than the own one, at most, within the box
        rounding = 1e-9 * (1 + self.reach + np.abs(centers).max()) ** 2
        whole = np.ones(len(label), bool)
        for c, center in enumerate(centers):
            nearer = np.zeros(len(label))
            for i in range(len(center)):
                corner = np.where(center[i] > own[:, i], self.high[:, i], self.low[:, i])
                nearer += (corner - own[:, i]) ** 2 - (corner - center[i]) ** 2
            whole &= (label == c) | (nearer < -rounding)
        total = np.zeros((len(centers), 2 + centers.shape[1]))
        at = label[whole]
        cost = self.spread[whole] + self.count[whole] * ((self.mean[whole] - own[whole]) ** 2).sum(axis=1)
        for column, weights in enumerate([self.count[whole], cost, *self.total[whole].T]):
            total[:, column] += np.bincount(at, weights, minlength=len(centers))
        x = self.x[np.repeat(~whole, self.count.astype(int))]
        at, cost = _nearest(x, centers)
        for column, weights in enumerate([None, cost, *x.T]):
            total[:, column] += np.bincount(at, weights, minlength=len(centers))
        return total


def _pass(points: DataFrame, names: Sequence[str], fits: Sequence[_Fit]) -> pd.DataFrame:
    """Per model and centre: points (as ``_packed`` gives them), their sums and their squared distances."""
    of_period: dict[int, list[tuple[int, np.ndarray]]] = {}
    for model, fit in enumerate(fits):
        of_period.setdefault(fit.period, []).append((model, fit.centers))
    columns = ["n", "cost", *[f"s_{n}" for n in names]]

    def collect_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p not in of_period:
                    continue
                tiles = _Tiles(np.frombuffer(x.as_buffer()).reshape(-1, len(names)))
                for model, centers in of_period[p]:
                    totals[model] = totals.get(model, 0.0) + tiles.sums(centers)
        for model, total in totals.items():
            center = np.flatnonzero(total[:, 0])
            table = {"model": np.full(len(center), model, np.int32), "center": center.astype(np.int32)}
            table |= dict(zip(columns, total[center].T, strict=True))
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in table.items()})

    schema = "model int, center int, " + ", ".join(f"{c} double" for c in columns)
    parts = points.mapInArrow(collect_sums, schema)
    return parts.groupBy("model", "center").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()


def kmeans_by_period(
    rows: DataFrame,
    columns: Sequence[Column],
    id_col: str,
    ks: Mapping[int, Sequence[int]],
    n_init: int,
    seed: int,
    period: str = "p",
) -> dict[int, dict[int, tuple[float, np.ndarray]]]:
    """For each period and k the lowest cost of ``n_init`` fits and its centres.

    ``period`` is a column of small integers, ``ks`` the values of k for each. How many passes run over the rows depends on
    the fit that takes longest, not on how many there are.
    """
    names = [f"x{i}" for i in range(len(columns))]
    inputs = [c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)]
    draw = X.hash_fraction(F.col(id_col), F.lit(seed))
    points = rows.select(F.col(period).cast("int").alias("p"), *inputs, draw.alias("draw"))
    # sorted, so that an Arrow batch holds few periods, and near points stand together
    points = points.sortWithinPartitions("p", _near_order(names)).persist(StorageLevel.MEMORY_AND_DISK)
    packed = _packed(points, names).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = []
        for p, (found, weights) in sorted(_candidates(points, names).items()):
            for k in ks.get(p, ()):
                for attempt in range(n_init):
                    rng = np.random.default_rng([seed, k, attempt])
                    fits.append(_Fit(p, k, _settle(found, weights, _spread_start(found, weights, k, rng))))
        for _ in range(MAX_PASSES):
            active = [f for f in fits if not f.done]
            if not active:
                break
            _advance(active, _pass(packed, names, active), names)
    finally:
        packed.unpersist()
        points.unpersist()
    best: dict[int, dict[int, tuple[float, np.ndarray]]] = {}
    for f in fits:
        of_period = best.setdefault(f.period, {})
        if f.k not in of_period or f.cost < of_period[f.k][0]:
            of_period[f.k] = (f.cost, f.centers)
    return best


def kmeans_restarts(
    rows: DataFrame,
    columns: Sequence[Column],
    id_col: str,
    ks: Sequence[int],
    n_init: int,
    seed: int,
) -> dict[int, tuple[float, np.ndarray]]:
    """The same for rows that are all of one period."""
    one = rows.withColumn("_one", F.lit(0))
    return kmeans_by_period(one, columns, id_col, {0: ks}, n_init, seed, "_one").get(0, {})


def _advance(fits: Sequence[_Fit], sums: pd.DataFrame, names: Sequence[str]) -> None:
    """Move the centres to their means; a fit ends once they hardly move."""
    for model, found in sums.groupby("model"):
        fit = fits[model]
        moved = fit.centers.copy()
        means = found[[f"s_{n}" for n in names]].to_numpy() / found[["n"]].to_numpy()
        moved[found["center"].to_numpy()] = means
        shift = ((moved - fit.centers) ** 2).sum()
        fit.cost = float(found["cost"].sum())
        if shift <= TOLERANCE:
            fit.done = True  # cost belongs to these centres
        else:
            fit.centers = moved
