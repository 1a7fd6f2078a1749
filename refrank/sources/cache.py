"""Materialised results reused across refreshes, keyed by everything that determines them
(author, mode, weights, data version) — never by path alone."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from refrank.sources.store import _fs


class ResultCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, **key) -> str:
        digest = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
        return f"{self.root}/{digest}"

    def get_or_compute(self, compute, **key) -> DataFrame:
        """Read the stored result for ``key``; otherwise run ``compute()`` (a DataFrame factory),
        write it (a ``_SUCCESS`` marker makes it visible), and read it back."""
        path = self.path(**key)
        fs, p = _fs(self.spark, f"{path}/_SUCCESS")
        if not fs.exists(p):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
