"""Tables stored in parts: a change rewrites the parts it touches and lists what is current in a small directory.

``data/part=<id>`` folders are written once and never changed; a directory version names the parts that make
up the table, with one line of figures each. A writer adds its parts first and the directory version last, so
a write that fails leaves the former version current, and a reader of a version is not disturbed by later ones.
One writer at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_part(label: object) -> str:
    """A part id that no other write uses."""
    return f"{label}-{uuid.uuid4().hex[:12]}"


def write_parts(df: DataFrame, path: str) -> None:
    """Add the rows of ``df``, whose column ``part`` names the new part of each."""
    df.write.mode("append").partitionBy("part").parquet(f"{path}/data")


def read_parts(spark: SparkSession, path: str, schema: T.StructType, parts: list[str]) -> DataFrame:
    """The rows of some parts; the filter is on the partition column, so other parts are not opened."""
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("part", T.StringType())]))
    full = T.StructType([*schema.fields, T.StructField("part", T.StringType())])
    return spark.read.schema(full).parquet(f"{path}/data").where(F.col("part").isin(parts))


def write_directory(spark: SparkSession, path: str, lines: list[tuple], schema: T.StructType, version: int) -> None:
    """One line per current part: a table bounded by the number of parts."""
    df = spark.createDataFrame(lines, schema).withColumn("version", F.lit(version)).coalesce(1)
    df.write.mode("append").partitionBy("version").parquet(f"{path}/directory")


def read_directory(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> tuple[int, list[Row]]:
    full = T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])
    lines = spark.read.schema(full).parquet(f"{path}/directory")
    if version is None:
        version = lines.agg(F.max("version").alias("v")).first().v
    return version, lines.where(F.col("version") == version).collect()
