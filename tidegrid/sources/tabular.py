"""CSV and Parquet tables, and gridded text tables with loose headers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite, number
from ..session import calendar


def _empty_if_missing(spark: SparkSession, load, schema: T.StructType) -> DataFrame:
    try:
        return load()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_text_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header, every column text; a missing path is an empty table."""
    reader = spark.read.schema(schema).option("header", True)
    return _empty_if_missing(spark, lambda: reader.csv(path), schema)


def parse_csv_lines(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """The same for CSV text held in a column."""
    parsed = F.from_csv(column, schema.simpleString()[len("struct<"):-1].replace(":", " "))
    return lines.select(parsed.alias("row")).select("row.*")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet is the format of record; a same-stem CSV is read only where it is absent."""
    reader = spark.read.schema(schema)
    stem = path.removesuffix(".parquet").removesuffix(".csv")
    try:
        return nan_to_null(reader.parquet(f"{stem}.parquet"))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    csv = reader.option("header", True)
    return nan_to_null(_empty_if_missing(spark, lambda: csv.csv(f"{stem}.csv"), schema))


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(c) for c in doubles}) if doubles else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, csv: str | None = None) -> None:
    """Parquet, optionally with a CSV copy; a failed write fails the job."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    if csv:
        df.write.mode("overwrite").option("header", True).csv(csv)


def write_new_days(df: DataFrame, path: str, written: DataFrame | None = None) -> None:
    """Append only days not yet written."""
    fresh = df if written is None else df.join(calendar(written), "date", "left_anti")
    fresh.write.mode("append").partitionBy("date").parquet(path)


def resolve_grid_columns(raw: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Pick columns by lower-case header prefix, coerce to numbers, round positions to 4 places.

    ``wanted`` maps a prefix to the output name. Rows without a position are dropped; values
    above 100 are taken as Kelvin.
    """
    found = {}
    for prefix, name in wanted.items():
        matches = [c for c in raw.columns if c.lower().startswith(prefix)]
        if not matches:
            raise ValueError(f"no column starts with {prefix}: {raw.columns}")
        found[name] = number(F.col(f"`{matches[0]}`"))
    typed = raw.select(*[c.alias(n) for n, c in found.items()])
    values = [n for n in found if n not in ("lat", "lon")]
    return typed.withColumns({
        "lat": F.round("lat", 4),
        "lon": F.round("lon", 4),
        **{n: F.when(F.col(n) > 100, F.col(n) - 273.15).otherwise(F.col(n)) for n in values},
    }).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def surface_on_dates(samples: DataFrame, dates: DataFrame) -> DataFrame:
    """Surface level of a long-form raster on the wanted days."""
    surface = samples.where(F.col("level_idx") == 0).drop("level_idx")
    return surface.join(calendar(dates), "date", "left_semi")


def wide_to_long(raster: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(time, level, iy, ix, variable, value) rows from a wide raster table."""
    return raster.unpivot(keys, values, "variable", "value")
