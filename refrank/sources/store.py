"""Parquet-backed tables: create empty (S11), append after a key check (S5/S7), versioned
replace (D3-D7, S12). Paths live under a shared folder (by default the session's checkpoint folder).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from refrank.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/refrank-{name}-{uuid.uuid4().hex[:12]}"


def create_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(re)create an empty table with a fixed schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` whole into a fresh shared folder and read it back: the next version of a table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


class VersionedTable:
    """A table whose every change is written as a new version folder ``v000001, v000002, …``.

    ``commit`` writes the complete next version and only then it becomes current (the newest
    folder holding a ``_SUCCESS`` marker), so a job never reads and overwrites the same path and a
    failed write leaves the previous version current."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _versions(self, complete: bool = True) -> list[int]:
        fs, p = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("v") and name[1:].isdigit():
                ok = fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
                if ok or not complete:
                    out.append(int(name[1:]))
        return sorted(out)

    def current(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{versions[-1]:06d}")

    def commit(self, df: DataFrame) -> DataFrame:
        # A failed write leaves a folder without a marker: its number is never used again.
        versions = self._versions(complete=False)
        nxt = (versions[-1] + 1) if versions else 1
        path = f"{self.root}/v{nxt:06d}"
        df.select(*[f.name for f in self.schema.fields]).write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store ``df`` hash-bucketed and sorted by ``key`` as an external table at ``path`` (a shared
    folder), registered as ``name`` in the session catalog. Joins and aggregations on ``key``
    against it then shuffle only the other side: the stored side is already partitioned.

    Typical use: ``interactions`` bucketed by ``author_id``, so per-author merges of a small batch
    (likes, sign-ups, upserts) never reshuffle the store."""
    (
        df.write.bucketBy(buckets, key)
        .sortBy(key)
        .mode("overwrite")
        .option("path", path)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)
