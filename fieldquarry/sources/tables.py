"""Reading and cleaning tables, and joining cell surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import finite, in_extent

# fixed values: coordinate names in the order in which they are looked for
COORDINATES = [("latitude", "longitude"), ("_latitude", "_longitude"), ("decimalLatitude", "decimalLongitude"), ("lat", "lon"), ("lat", "lng")]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header, or Parquet; with a schema, text that is no number becomes null."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).csv(path)
    if schema is None:
        return raw
    return raw.select(*(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def named_coordinates(df: DataFrame) -> DataFrame:
    """The first known pair of coordinate columns renamed to latitude, longitude."""
    for lat, lon in COORDINATES:
        if lat in df.columns and lon in df.columns:
            return df.withColumnsRenamed({lat: "latitude", lon: "longitude"})
    raise ValueError("no known pair of coordinate columns")


def clean_occurrences(df: DataFrame, keys: list[str], minimum: int = 5, order: str = "row_id") -> DataFrame:
    """Finite coordinates, one row (the first) per place; keys with fewer than ``minimum`` places go (S3)."""
    df = df.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("latitude", "longitude")})
    df = df.filter(finite("latitude") & finite("longitude") & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    first = df.groupBy(*keys, "latitude", "longitude").agg(F.min_by(F.struct(*[c for c in df.columns if c not in (*keys, "latitude", "longitude")]), order).alias("r"))
    out = first.select(*keys, "latitude", "longitude", "r.*")
    enough = out.groupBy(*keys).count().filter(F.col("count") >= minimum).drop("count")
    return out.join(enough, keys, "left_semi")


def write_results(df: DataFrame, path: str, order: list, as_csv: bool = False) -> DataFrame:
    """Write a sorted result; returns its one-row summary."""
    writer = df.orderBy(*order).write.mode("overwrite")
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)
    return df.agg(F.count("*").alias("row_count")).withColumn("columns", F.lit(",".join(df.columns)))


def sample_surfaces(points: DataFrame, cells: DataFrame, values: list[str], x0: float, y0: float, size: float, area: str = "area", x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Values of the cell that holds each point, null outside; rows count down from ``y0``."""
    at = points.withColumns({"_c": F.floor((F.col(x) - x0) / size).cast("int"), "_r": F.floor((F.lit(y0) - F.col(y)) / size).cast("int")})
    own = cells.select(F.col(area), F.col("r").alias("_r"), F.col("c").alias("_c"), *values)
    return at.join(own, [area, "_r", "_c"], "left").drop("_r", "_c")


def candidate_grid(cells: DataFrame, step: int, extent=None) -> DataFrame:
    """Every ``step``-th cell of rows and columns, inside the box, once."""
    out = cells.filter((F.col("r") % step == 0) & (F.col("c") % step == 0))
    return (in_extent(out, extent) if extent else out).dropDuplicates(["latitude", "longitude"])


def forward_fill(df: DataFrame, column: str, source: list[str], order: str = "row_id") -> DataFrame:
    """A blank takes the last value before it in its source file."""
    w = Window.partitionBy(*source).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim(F.col(column).cast("string"))
    return df.withColumn(column, F.last(F.when(text != "", F.col(column)), ignorenulls=True).over(w))


def field_locations(df: DataFrame, area: str = "island", source: list[str] = ("source",), order: str = "row_id") -> DataFrame:
    """Areas filled forward and normalised, coordinates checked."""
    out = forward_fill(df, area, list(source), order).withColumn(area, F.lower(F.trim(area)))
    out = out.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("latitude", "longitude")})
    return out.filter(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
