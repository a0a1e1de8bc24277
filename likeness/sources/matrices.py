"""Sparse matrices and feature tables as Parquet; keys, never positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_coo(coo: DataFrame, path: str) -> None:
    """Triples and, beside them, the keys of both axes."""
    coo.select("entity", "target", "value").write.parquet(f"{path}/cells")
    coo.select("entity").distinct().write.parquet(f"{path}/entities")
    coo.select("target").distinct().write.parquet(f"{path}/targets")


def read_coo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("cells", "entities", "targets"))


def write_features(features: DataFrame, path: str) -> None:
    """(id, array) rows."""
    features.write.parquet(path)
