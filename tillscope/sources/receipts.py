"""Readers of receipt files: partitioned parquet, messy CSV, hash samples."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions import exprs as X

# Folder layout below the data path.
LINES_FOLDER = "raw_normalized/venduto"
CSV_SEPARATOR = ";"


def period_of(year: Column, month: Column) -> Column:
    """``YYYY-MM`` text."""
    text = lambda c, width: F.lpad(c.cast("int").cast("string"), width, "0")
    return F.concat(text(year, 4), F.lit("-"), text(month, 2))


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(status.getPath()) for status in fs.globStatus(path) or []]


def _folders_below(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path)
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(status.getPath()) for status in fs.listStatus(parent) if status.isDirectory()]


def month_folders(spark: SparkSession, data_path: str, year: int, area: str | None) -> list[str]:
    """Year folders of the area (or of all areas), at any depth below it.

    Walks the folders down to those of years; what lies below a year isn't listed.
    """
    waiting = _glob(spark, f"{data_path.rstrip('/')}/{LINES_FOLDER}/area={area or '*'}")
    found: list[str] = []
    while waiting:
        for folder in _folders_below(spark, waiting.pop()):
            name = folder.rsplit("/", 1)[1]
            if name == f"year={year}":
                found.append(folder)
            elif not name.startswith("year="):
                waiting.append(folder)
    return sorted(found)


def scan_period(
    spark: SparkSession,
    data_path: str,
    year: int,
    month: int,
    month_end: int | None = None,
    day: int | None = None,
    day_end: int | None = None,
    area: str | None = None,
) -> DataFrame:
    """Raw receipt lines of a range of months, or of some days of each month.

    Adds ``area``, ``year``, ``month``, ``day`` and ``period``. The folder keys
    are partition columns, so only the files asked for are opened. ``day_end``
    counts only together with ``day``.
    """
    branches = month_folders(spark, data_path, year, area)
    if not branches:
        raise FileNotFoundError(f"no folder year={year} of area {area or '*'} below {data_path}")
    wanted = F.col("month").between(month, month_end or month)
    if day is not None:
        wanted = wanted & F.col("day").between(day, day_end or day)
    parts = []
    for branch in branches:
        base = branch.rsplit("/", 1)[0]
        code = re.search(r"/area=([^/]+)", branch).group(1)
        part = spark.read.option("basePath", base).parquet(branch)
        parts.append(part.where(wanted).withColumn("area", F.lit(code)))
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return lines.withColumn("period", period_of(F.col("year"), F.col("month")))


def read_csv(
    spark: SparkSession, path: str | Sequence[str], columns: T.StructType | None = None
) -> DataFrame:
    """Semicolon CSV with a header; bad values are null, ragged rows are fitted.

    Short rows are padded with nulls, long rows cut. Without ``columns`` the
    types are inferred from all rows.
    """
    reader = spark.read.option("sep", CSV_SEPARATOR).option("header", True).option("mode", "PERMISSIVE")
    if columns is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(columns).option("enforceSchema", False).csv(path)


def read_receipts(
    spark: SparkSession, path: str, fmt: str = "auto", columns: T.StructType | None = None
) -> DataFrame:
    """Receipts below ``path``: its parquet files, or all its CSV files if it has none."""
    if fmt not in ("auto", "parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    validate_source(spark, path)
    if fmt == "csv":
        return read_csv(spark, path, columns)
    try:
        # an explicit pattern keeps stray CSV files out
        reader = spark.read if path.endswith(".parquet") else spark.read.option("pathGlobFilter", "*.parquet")
        return reader.parquet(path)
    except AnalysisException:
        if fmt == "parquet":
            raise
    return read_csv(spark, path, columns)


#: Column with the whole text of a row that doesn't fit, and what is wrong with it.
REST, PROBLEM = "_rest", "problem"
SHORT, LONG, UNPARSEABLE = "short", "long", "unparseable"


def read_csv_checked(spark: SparkSession, path: str | Sequence[str], columns: T.StructType) -> DataFrame:
    """The rows of ``read_csv`` with a ``problem``: short, long, unparseable (a value of another type), or null.

    What can be read of a bad row is in its columns. Fields between quotes may hold separators. Spark
    tells problems only together with columns, so ask for at least one of them, too.
    """
    reader = spark.read.option("sep", CSV_SEPARATOR).option("header", True).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", REST).option("enforceSchema", False)
    rows = reader.schema(T.StructType([*columns, T.StructField(REST, T.StringType())])).csv(path)
    bare = F.regexp_replace(REST, '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(CSV_SEPARATOR), F.lit(""))) + 1
    problem = (
        F.when(F.col(REST).isNull(), None)
        .when(fields < len(columns), SHORT)
        .when(fields > len(columns), LONG)
        .otherwise(UNPARSEABLE)
    )
    return rows.withColumn(PROBLEM, problem).drop(REST)


def read_folders(spark: SparkSession, folders: Sequence[str], columns: T.StructType) -> DataFrame:
    """Receipts of several folders: of each its parquet files, or all its CSV files if it has none.

    Adds ``problem`` (null for rows from parquet), ``format`` and ``file``, the path that a row comes from. All folders of one format
    are read together. The partition columns of a folder are those of its own sub-folders.
    """
    chosen: dict[str, list[str]] = {"parquet": [], "csv": []}
    for folder in folders:
        chosen["parquet" if _holds_parquet(spark, folder) else "csv"].append(folder)
    parts = []
    for kind, paths in chosen.items():
        for path in paths:
            if kind == "parquet":
                rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
                rows = rows.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in columns], "_metadata.file_path")
                rows = rows.withColumn(PROBLEM, F.lit(None).cast("string"))
            else:
                # the file is asked for on the bare scan, where its metadata are
                rows = read_csv_checked(spark, path, columns).select(
                    *[c.name for c in columns], PROBLEM, "_metadata.file_path"
                )
            parts.append(rows.withColumnRenamed("file_path", "file").withColumn("format", F.lit(kind)))
    if not parts:
        raise FileNotFoundError("no folders given")
    return reduce(DataFrame.unionByName, parts)


def _holds_parquet(spark: SparkSession, folder: str) -> bool:
    """Whether any parquet file lies in the folder or in its sub-folders; the names of the first level are enough to tell most."""
    try:
        return bool(spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).columns)
    except AnalysisException:
        validate_source(spark, folder)
        return False


def file_quality(rows: DataFrame) -> DataFrame:
    """Per file of ``read_folders``: its rows, how many have a value in every column, and how many are short, long or unparseable."""
    columns = [F.col(c).isNotNull() for c in rows.columns if c not in (PROBLEM, "file", "format")]
    bad = [F.count_if(F.col(PROBLEM).eqNullSafe(F.lit(p))).alias(f"{p}_count") for p in (SHORT, LONG, UNPARSEABLE)]
    complete = F.count_if(reduce(lambda a, b: a & b, columns)).alias("complete_count")
    return rows.groupBy("file", "format").agg(F.count(F.lit(1)).alias("line_count"), complete, *bad)


def validate_source(spark: SparkSession, path: str) -> list[str]:
    """Paths that match; ``FileNotFoundError`` when there are none."""
    found = _glob(spark, path)
    if not found:
        raise FileNotFoundError(f"no files found at {path}")
    return found


def hash_sample(rows: DataFrame, key: Column | str, rate: float) -> DataFrame:
    """Rows whose key hashes below ``rate``; the same keys on every run.

    The whole md5 digest modulo 100 decides. ``F.col("_metadata.file_path")``
    as key samples files instead of receipts.
    """
    column = F.col(key) if isinstance(key, str) else key
    return rows.where(X.md5_mod(column, 100) < F.lit(rate * 100))


def preview(rows: DataFrame, count: int = 5) -> DataFrame:
    """The first few rows, for a look at freshly read data."""
    return rows.limit(count)
