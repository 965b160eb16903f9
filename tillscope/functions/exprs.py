"""Scalar column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as "true" in the point-of-sale flags.
TRUE_FLAGS = ("Y", "1", "S")
# Inclusive hour ranges that count as peak time.
PEAK_HOURS = ((12, 14), (18, 20))

EPSILON = 1e-6
CLIP_LIMIT = 1e9


def text_flag(col: Column) -> Column:
    """True when the upper-cased text is a true flag; null stays null."""
    return F.upper(col.cast("string")).isin(*TRUE_FLAGS)


def as_double(col: Column) -> Column:
    return col.cast("double")


def ratio(num: Column, den: Column) -> Column:
    """Quotient as double; null where the denominator is zero."""
    return F.try_divide(as_double(num), as_double(den))


def fill_missing(col: Column, value: float = 0.0) -> Column:
    """Null and NaN become ``value``; infinities stay."""
    return F.coalesce(F.nanvl(as_double(col), F.lit(value)), F.lit(value))


def is_finite(col: Column) -> Column:
    """False for null, NaN and infinities."""
    d = as_double(col)
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def finite_or(col: Column, value: float | None) -> Column:
    """The value where it is finite, else ``value`` (``None`` for null)."""
    return F.when(is_finite(col), as_double(col)).otherwise(F.lit(value).cast("double"))


def earliest(col: Column, *by: Column) -> Column:
    """Aggregate: the value of the first row, by ``by`` with nulls last, that has one; ties take the smallest."""
    order = [part for i, b in enumerate(by) for part in (b.isNull().alias(f"none{i}"), b.alias(f"by{i}"))]
    return F.min(F.when(col.isNotNull(), F.struct(*order, col.alias("value"))))["value"]


def model_input(col: Column) -> Column:
    """Numeric input for models: finite, zero when missing, clipped."""
    return F.least(F.greatest(finite_or(col, 0.0), F.lit(-CLIP_LIMIT)), F.lit(CLIP_LIMIT))


def parse_day(col: Column) -> Column:
    """``yyyyMMdd`` text to date; anything else is null."""
    return F.try_to_date(col.cast("string"), "yyyyMMdd")


def hour_prefix(col: Column) -> Column:
    """Hour from the first two characters of ``HH:MM`` or ``HHMMSS`` text."""
    return F.substring(col.cast("string"), 1, 2).try_cast("int")


def clock_hour(col: Column) -> Column:
    """Hour of a strict ``HH:MM`` text; anything else is null."""
    return F.hour(F.try_to_timestamp(col.cast("string"), F.lit("HH:mm")))


def iso_weekday(day: Column) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(day) + 1


def weekend_flag(day: Column) -> Column:
    return iso_weekday(day).isin(6, 7).cast("byte")


def peak_flag(hour: Column) -> Column:
    """1 inside a peak range, else 0 (also for an unknown hour)."""
    inside = F.lit(False)
    for first, last in PEAK_HOURS:
        inside = inside | hour.between(first, last)
    return F.when(inside, 1).otherwise(0)


def md5_word(col: Column, index: int) -> Column:
    """One of the four 32-bit words of the md5 digest, as a long."""
    digits = F.substring(F.md5(col.cast("string")), 8 * index + 1, 8)
    return F.conv(digits, 16, 10).cast("long")


def md5_mod(col: Column, modulus: int) -> Column:
    """The whole 128-bit md5 digest modulo a small number."""
    step = (1 << 32) % modulus
    acc = md5_word(col, 0) % modulus
    for index in (1, 2, 3):
        acc = (acc * step + md5_word(col, index)) % modulus
    return acc


def md5_bucket(col: Column, buckets: int) -> Column:
    """Stable bucket 0..buckets-1 from the first md5 word."""
    return md5_word(col, 0) % buckets


def hash_fraction(*cols: Column) -> Column:
    """Deterministic pseudo-random fraction in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))
