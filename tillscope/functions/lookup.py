"""Equi-joins of a large table with a lookup table of unknown size.

The lookup is written once and measured. If it is small it is broadcast. If not, the rows of every key are
counted: a key with more rows than a task should get is split into parts, and the lookup's row is
copied for each; all other keys take part in the same shuffle join as they are. All keys match null-safely.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.session import stage

BROADCAST_BYTES = 64 << 20
# Rows of one key that a task may get.
TASK_ROWS = 2_000_000
# Keys that are split are fewer; with that many a task gets more rows. It bounds the broadcast of their names.
HEAVY_KEYS = 100_000
_FIXED_WIDTH = 16
_ROW_OVERHEAD = 48


def lookup_bytes(lookup: DataFrame) -> int:
    """Upper estimate of the in-memory size, from row count and text lengths."""
    texts = [f.name for f in lookup.schema.fields if f.dataType.typeName() == "string"]
    fixed = _ROW_OVERHEAD + _FIXED_WIDTH * len(lookup.columns)
    row = lookup.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(c) for c in texts],
    ).first()
    return row["rows"] * fixed + sum(row[c] for c in texts)


def _match(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in on])


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, small: bool) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    side = F.broadcast(renamed) if small else renamed
    joined = left.join(side, _match(left, renamed, on), how)
    return joined if how == "left_anti" else joined.drop(*[f"_r_{k}" for k in on])


def _heavy(facts: DataFrame, on: Sequence[str], task_rows: int, most: int) -> DataFrame:
    """Keys with more rows than a task should get, and into how many parts each is split; fewer than ``most`` keys."""
    frequency = stage(facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")), "key-frequency")
    total = frequency.agg(F.sum("_rows")).first()[0] or 0
    limit = max(task_rows, -(-total // most))
    heavy = frequency.where(F.col("_rows") > limit)
    return stage(heavy.select(*on, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts")), "heavy-keys")


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    task_rows: int = TASK_ROWS,
    staged: bool = False,
) -> DataFrame:
    """Join ``lookup`` (unique on ``on``) to ``facts``; ``how`` is left or inner.

    ``staged`` says that the lookup already is a written table. ``facts`` without a key are matched like any other.
    """
    if not staged:
        lookup = stage(lookup, "lookup")
    if lookup_bytes(lookup) <= broadcast_bytes:
        return _join(facts, lookup, on, how, small=True)

    heavy = _heavy(facts, on, task_rows, HEAVY_KEYS)
    if heavy.isEmpty():
        return _join(facts, lookup, on, how, small=False)
    # rows of a heavy key are dealt by a hash of the whole row, and each part meets a copy of the lookup's row
    parts = F.coalesce("_parts", F.lit(1))
    salted = _join(facts, heavy, on, "left", small=True)
    salted = salted.withColumn("_part", F.pmod(F.xxhash64(*facts.columns), parts).cast("int")).drop("_parts")
    copied = _join(lookup, heavy, on, "left", small=True)
    copied = copied.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return _join(salted, copied, [*on, "_part"], how, small=False).drop("_part")


def attach_per_period(facts: DataFrame, stats: DataFrame, how: str = "inner") -> DataFrame:
    """Join with one row per period, null among them; bounded by the number of periods."""
    return _join(facts, stats, ["period"], how, small=True)
