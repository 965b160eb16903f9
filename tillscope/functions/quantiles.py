"""Exact order statistics per group, without gathering a group in one task.

Rows are first reduced to (group, value, count), which merges on the map side.
Groups with a moderate number of distinct values are ranked with one window.
For the others the values fall into buckets that keep their order, and running
counts over the buckets show which bucket holds a rank. That bucket is cut into buckets
again until it has few enough values to be ranked one by one, so no task ranks more than that,
however close the values lie. Both ways give the same, exact answer.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.exprs import as_double
from tillscope.functions.lookup import attach
from tillscope.session import stage

# A group with at most this many distinct values is ranked in one window.
WINDOW_VALUES = 500_000
# Buckets that a range of values is cut into.
BUCKETS = 1 << 16
_LARGEST = sys.float_info.max


@dataclass(frozen=True)
class Pick:
    """Two 1-based ranks as a function of the group size, and how to blend them."""

    low: Callable[[Column], Column]
    high: Callable[[Column], Column]
    blend: Callable[[Column, Column, Column], Column]


def median() -> Pick:
    return Pick(
        low=lambda n: F.floor((n + 1) / 2),
        high=lambda n: F.floor(n / 2) + 1,
        blend=lambda low, high, n: (low + high) * F.lit(Decimal("0.5")),
    )


def nearest(q: float) -> Pick:
    """The value whose zero-based position is closest to q·(n-1)."""
    rank = lambda n: F.round(F.lit(q) * (n - 1)).cast("long") + 1
    return Pick(low=rank, high=rank, blend=lambda low, high, n: low)


def linear(q: float) -> Pick:
    """Linear interpolation between the two values around q·(n-1)."""
    position = lambda n: F.lit(q) * (n - 1)
    return Pick(
        low=lambda n: F.floor(position(n)) + 1,
        high=lambda n: F.least(F.floor(position(n)) + 2, n),
        blend=lambda low, high, n: low + (high - low) * (position(n) - F.floor(position(n))),
    )


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, count: str | None = None
) -> DataFrame:
    """Rows as (keys, _v, _c); null and NaN values are left out."""
    col = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        df = df.where(col.isNotNull() & ~F.isnan(col))
    else:
        df = df.where(col.isNotNull())
    weight = F.sum(count) if count else F.count(F.lit(1))
    return df.groupBy(*keys, col.alias("_v")).agg(weight.alias("_c"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, Pick],
    count: str | None = None,
    window_values: int = WINDOW_VALUES,
) -> DataFrame:
    """One row per group: the keys, ``n`` (rows with a value) and one column per pick.

    ``count`` names a column that says how often each row occurs.
    """
    counts = stage(value_counts(df, keys, value, count), "value-counts")
    return counted_quantiles(counts, keys, picks, window_values)


def counted_quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    picks: dict[str, Pick],
    window_values: int = WINDOW_VALUES,
) -> DataFrame:
    """The same for a staged table of ``value_counts``."""
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_values"),
        F.sum("_c").alias("n"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )
    if (sizes.agg(F.max("_values")).first()[0] or 0) <= window_values:
        return _resolve(_ranked(counts, keys), keys, picks)

    wide = sizes.where(F.col("_values") > window_values)
    tagged = attach(counts, wide.select(*keys, "_values"), keys)
    narrow = tagged.where(F.col("_values").isNull()).drop("_values")
    refined = _refined(counts, keys, wide, picks, window_values)
    return _resolve(_ranked(narrow, keys), keys, picks).unionByName(_resolve(refined, keys, picks))


def _ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the group size and the ranks (_before, _upto] each value covers."""
    group = Window.partitionBy(*keys)
    running = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns(
        {"_upto": F.sum("_c").over(running), "n": F.sum("_c").over(group)}
    ).withColumn("_before", F.col("_upto") - F.col("_c"))


def _finite(value: Column) -> Column:
    """As double, infinities as the largest finite ones; never decreases when the value grows."""
    return F.least(F.greatest(as_double(value), F.lit(-_LARGEST)), F.lit(_LARGEST))


def range_bucket(value: Column, low: Column, high: Column, first: bool = True) -> Column:
    """A bucket 0..BUCKETS of the range low..high that never decreases when the value grows.

    Wide ranges are cut by magnitude, narrow ones evenly; a range that reaches zero is cut by signed magnitude
    the ``first`` time, then by sign. The ends fall into different buckets unless they are the same as doubles.
    """
    v, a, b = _finite(value), _finite(low), _finite(high)

    def even(scale: Callable[[Column], Column]) -> Column:
        return F.floor((scale(v) - scale(a)) / (scale(b) - scale(a)) * BUCKETS)

    by_sign = F.signum(v).cast("long") + 1
    return (
        F.when(~(a < b), 0)
        .when((a <= 0) & (b >= 0), even(lambda c: F.signum(c) * F.log1p(F.abs(c))) if first else by_sign)
        .when((a > 0) & (b > 2 * a), even(F.ln))
        .when((b < 0) & (a < 2 * b), even(lambda c: -F.ln(-c)))
        .otherwise(even(lambda c: c))
    )


def _inside(counts: DataFrame, ranges: DataFrame, keys: list[str], wanted: Callable[[Column], Column]) -> DataFrame:
    """The values inside the ranges of their group that are ``wanted``, each with its range (``_r``, ``_i``)."""
    some = F.filter("_ranges", lambda r: wanted(r) & F.col("_v").between(r["low"], r["high"]))
    rows = attach(counts, ranges, keys, how="inner", staged=True).withColumn("_r", F.explode(some))
    return rows.drop("_ranges").withColumn("_i", F.col("_r.before"))


def _refined(
    counts: DataFrame, keys: list[str], wide: DataFrame, picks: dict[str, Pick], window_values: int
) -> DataFrame:
    """Values of wide groups that are few enough to hold all wanted ranks, with the ranks each covers.

    A range of values knows how many rows lie before it, how many distinct values it has and the wanted ranks in it.
    Ranges of more than ``window_values`` values are cut into buckets, and those that hold a rank are
    the next ranges. A group never has more ranges than wanted ranks.
    """
    n = F.col("n")
    ranks = F.array_distinct(F.array(*[rank(n).cast("long") for p in picks.values() for rank in (p.low, p.high)]))
    whole = F.struct(
        F.lit(0).cast("long").alias("before"),
        F.col("_low").alias("low"),
        F.col("_high").alias("high"),
        F.col("_values").alias("size"),
        ranks.alias("ranks"),
    )
    ranges = stage(wide.select(*keys, "n", F.array(whole).alias("_ranges")), "ranges")

    def large(r: Column) -> Column:
        return (r["size"] > window_values) & (_finite(r["low"]) < _finite(r["high"]))

    first = True
    while not ranges.where(F.exists("_ranges", large)).isEmpty():
        cut = _inside(counts, ranges, keys, large)
        cut = cut.withColumn("_b", range_bucket(F.col("_v"), F.col("_r.low"), F.col("_r.high"), first))
        buckets = cut.groupBy(*keys, "n", "_i", "_b").agg(
            F.sum("_c").alias("_c"),
            F.count(F.lit(1)).alias("size"),
            F.min("_v").alias("low"),
            F.max("_v").alias("high"),
            F.first("_r.ranks").alias("ranks"),
        )
        running = (
            Window.partitionBy(*keys, "_i").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        upto = F.col("_i") + F.sum("_c").over(running)
        buckets = buckets.withColumn("_upto", upto).withColumn("before", F.col("_upto") - F.col("_c"))
        held = F.filter("ranks", lambda rank: (F.col("before") < rank) & (rank <= F.col("_upto")))
        buckets = buckets.withColumn("ranks", held).where(F.size("ranks") > 0)
        smaller = buckets.select(*keys, "n", F.struct("before", "low", "high", "size", "ranks").alias("_r"))
        settled = ranges.withColumn("_r", F.explode(F.filter("_ranges", lambda r: ~large(r)))).select(*keys, "n", "_r")
        again = smaller.unionByName(settled).groupBy(*keys, "n").agg(F.collect_list("_r").alias("_ranges"))
        ranges, first = stage(again, "ranges"), False
    inside = _inside(counts, ranges, keys, lambda r: F.lit(True))
    running = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_i") + F.sum("_c").over(running)
    return inside.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c")).drop("_r", "_i")


def _holds(rank: Column) -> Column:
    return (F.col("_before") < rank) & (rank <= F.col("_upto"))


def _resolve(ranked: DataFrame, keys: list[str], picks: dict[str, Pick]) -> DataFrame:
    n = F.col("n")
    found = [F.max("n").alias("n")]
    for name, pick in picks.items():
        found.append(F.max(F.when(_holds(pick.low(n)), F.col("_v"))).alias(f"_{name}_low"))
        found.append(F.max(F.when(_holds(pick.high(n)), F.col("_v"))).alias(f"_{name}_high"))
    blended = [
        pick.blend(F.col(f"_{name}_low"), F.col(f"_{name}_high"), n).alias(name)
        for name, pick in picks.items()
    ]
    return ranked.groupBy(*keys).agg(*found).select(*keys, "n", *blended)
