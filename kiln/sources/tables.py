"""Base table scans.

Every scan is a plain ``spark.read.parquet``: Catalyst prunes columns and pushes
filters into the reader, so callers never select columns up front.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SCAN_PARTITIONS = "spark.kiln.scanPartitions"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).orders`` is a parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            df = read_table(self.spark, self.sf_dir, name)
            # a caller's option for small tables that are one scan task: off by default, as it shuffles whole rows
            parts = int(self.spark.conf.get(SCAN_PARTITIONS, "0"))
            self._cache[name] = df.repartition(parts) if parts else df
        return self._cache[name]
