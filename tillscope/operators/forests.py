"""Random forests of large periods, grown from cells instead of rows.

A tree only sees the bins of the features, so rows of equal bins (a cell) are alike to it: their weights in its bootstrap
sample and their weighted targets add up. One pass over the rows draws the samples of all trees and adds them up by cell;
then every tree grows from its own cells. How many there are depends on the bins, not on the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import exprs as X

# Tasks get the functions below by value; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a task, and rows whose samples are drawn at once.
TASK_ROWS = 250_000
DRAW_ROWS = 4096
# Rows that bins are cut from are at least this many (or all), as in MLlib.
BIN_SAMPLE = 10_000
# Chances that a Poisson number of mean one is at most 0, 1, 2, ...
_AT_MOST = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def bin_cuts(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Cuts between all distinct values, if they are few, else between about equal numbers of rows."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < max_bins:
        return middles
    wanted = len(values) / max_bins * np.arange(1, max_bins)
    # of the two cuts beside a wanted number of rows the nearer one
    below = np.cumsum(counts)[:-1]
    after = np.clip(np.searchsorted(below, wanted), 1, len(below) - 1)
    nearer = np.where(wanted - below[after - 1] <= below[after] - wanted, after - 1, after)
    return middles[np.unique(nearer)]


def sample_weights(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each row is in the bootstrap sample of each tree (Poisson numbers), by hashes of row and tree."""
    tree = np.random.default_rng(seed).integers(0, 1 << 63, trees, dtype=np.uint64)
    h = rows.astype(np.uint64)[:, None] ^ tree
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return np.searchsorted(_AT_MOST, (h >> np.uint64(11)) * 2.0**-53, side="right")


def grow(bins: Sequence[np.ndarray], weight: np.ndarray, total: np.ndarray, max_bins: int, max_depth: int) -> np.ndarray:
    """Importance of each feature in one regression tree: what its splits take off the squared error."""
    importance = np.zeros(len(bins))
    node = np.zeros(len(weight), np.int64)
    nodes = 1
    for _ in range(max_depth):
        best = np.zeros(nodes)
        feature = np.full(nodes, -1)
        cut = np.zeros(nodes, np.int64)
        for f, b in enumerate(bins):
            place = node * max_bins + b
            n = np.bincount(place, weight, nodes * max_bins).reshape(nodes, max_bins).cumsum(axis=1)
            s = np.bincount(place, total, nodes * max_bins).reshape(nodes, max_bins).cumsum(axis=1)
            n_left, s_left, n_all, s_all = n[:, :-1], s[:, :-1], n[:, -1:], s[:, -1:]
            n_right = n_all - n_left
            both = (n_left > 0) & (n_right > 0)
            gain = s_left**2 / np.maximum(n_left, 1) + (s_all - s_left) ** 2 / np.maximum(n_right, 1) - s_all**2 / n_all
            gain = np.where(both, gain, 0.0)
            at = gain.argmax(axis=1)
            gain = gain[np.arange(nodes), at]
            # what is left of equal targets by rounding is no gain
            better = (gain > best) & (gain > 1e-12 * s_all[:, 0] ** 2 / n_all[:, 0])
            best[better], feature[better], cut[better] = gain[better], f, at[better]
        split = feature >= 0
        if not split.any():
            break
        importance += np.bincount(feature[split], best[split], len(bins))
        stay = split[node]
        node, weight, total, bins = node[stay], weight[stay], total[stay], [b[stay] for b in bins]
        own = np.choose(feature[node], bins)
        # children are numbered anew: none is empty, as both sides of a split have rows
        node = (np.cumsum(split) - 1)[node] * 2 + (own > cut[node])
        nodes = 2 * int(split.sum())
    return importance


def cell_importance(
    data: DataFrame,
    sizes: Mapping[str | None, int],
    features: Sequence[str],
    target: str,
    trees: int,
    max_depth: int,
    max_bins: int,
    seed: int,
) -> dict[str | None, np.ndarray]:
    """Impurity importances of a forest for each period in ``sizes`` (their rows), the trees weighing the same.

    ``data`` has the period, finite features and target, and a hash of the row (``_row``).
    """
    spark = data.sparkSession
    periods = list(sizes)
    number = F.coalesce(*[F.when(F.col("period").eqNullSafe(F.lit(p)), F.lit(i)) for i, p in enumerate(periods)])
    rows = data.select(number.alias("p"), *features, F.col(target).alias("y"), F.col("_row").alias("row"))
    rows = rows.where(F.col("p").isNotNull())
    # bins from a sample of about a fixed size, as MLlib cuts them
    wanted = max(BIN_SAMPLE, max_bins**2)
    share = F.element_at(F.array(*[F.lit(min(1.0, wanted / sizes[p])) for p in periods]), F.col("p") + 1)
    sample = rows.where(X.hash_fraction(F.col("row"), F.lit(seed)) < share).select("p", *features).toPandas()
    cuts = {int(p): [bin_cuts(own[f].to_numpy(), max_bins) for f in features] for p, own in sample.groupby("p")}
    # targets are counted from the mean, which keeps sums of squares exact
    mean = {r["p"]: r["y"] for r in rows.groupBy("p").agg(F.avg("y").alias("y")).collect()}

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)).to_numpy() for n in batch.schema.names}
            cell, y = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for p in np.unique(column["p"]):
                own = column["p"] == p
                for f, cut in zip(features, cuts[p], strict=True):
                    cell[own] = cell[own] * max_bins + np.searchsorted(cut, column[f][own])
                y[own] = column["y"][own] - mean[p]
            found = {"p": column["p"].astype(np.int32), "cell": cell, "row": column["row"], "y": y}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in found.items()})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), DRAW_ROWS):
                batch = whole.slice(start, DRAW_ROWS)
                p, cell, row, y = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("p", "cell", "row", "y"))
                first = np.flatnonzero(np.r_[True, (np.diff(p) != 0) | (np.diff(cell) != 0)])
                drawn = sample_weights(row, trees, seed).astype(np.float64)
                weight = np.add.reduceat(drawn, first, axis=0)
                total = np.add.reduceat(drawn * y[:, None], first, axis=0)
                p, cell = p[first], cell[first]
                for q in np.unique(p):
                    own = p == q
                    out = []
                    for tree in range(trees):
                        some = np.flatnonzero(own & (weight[:, tree] > 0))
                        parts = cell[some].astype(np.int32), weight[some, tree], total[some, tree]
                        out.append((q, tree, *[v.tobytes() for v in parts]))
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    arrays = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["p", "tree", "cell", "weight", "total"])

    def one_tree(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        kinds = {"cell": np.int32, "weight": np.float64, "total": np.float64}
        cell, weight, total = (np.frombuffer(b"".join(own[c]), kind) for c, kind in kinds.items())
        # parts of a cell, from different batches, become one
        cell, at = np.unique(cell, return_inverse=True)
        bins = [cell // max_bins**place % max_bins for place in reversed(range(len(features)))]
        found = grow(bins, np.bincount(at, weight), np.bincount(at, total), max_bins, max_depth)
        return pd.DataFrame({"p": [key[0]], "importance": [found / (found.sum() or 1.0)]})

    # ranges of cells, so that a cell lies in few tasks; the row is part of the key, so a cell of very many rows is split
    parts = max(spark.sparkContext.defaultParallelism, -(-sum(sizes.values()) // TASK_ROWS))
    cells = rows.mapInArrow(to_cells, "p int, cell long, row long, y double")
    cells = cells.repartitionByRange(parts, "p", "cell", "row").sortWithinPartitions("p", "cell", "row")
    sums = cells.mapInArrow(add_up, "p int, tree int, cell binary, weight binary, total binary")
    grown = sums.groupBy("p", "tree").applyInPandas(one_tree, "p int, importance array<double>")
    found = {p: np.zeros(len(features)) for p in periods}
    for p, importance in sorted((r["p"], r["importance"]) for r in grown.collect()):  # in a fixed order, for equal sums
        found[periods[p]] += np.array(importance)
    return {p: v / (v.sum() or 1.0) for p, v in found.items()}
