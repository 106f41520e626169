"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobweave.plans.staging import even as spread
from jobweave.plans.staging import settle as cut
from jobweave.plans.staging import shared_dir, small

__all__ = ["cut", "duck", "shared_dir", "small", "spread", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck():
    """A DuckDB in memory for one task. It has no folder to spill to, so batches handed to it must be sliced."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
