"""Parquet and catalog tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.dataset import Dataset


def read_parquet(spark: SparkSession, path: str, name: str | None = None, order_by: list[str] | None = None, **options) -> Dataset:
    """A dataset over parquet files; only the columns an operator needs are read."""
    return Dataset(spark.read.parquet(path), name or path.rstrip("/").rsplit("/", 1)[-1], order_by, **options)


def read_table(spark: SparkSession, table: str, order_by: list[str] | None = None, **options) -> Dataset:
    return Dataset(spark.table(table), table, order_by, **options)
