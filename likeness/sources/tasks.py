"""Benchmark tasks: CSV tables with a target column and index-based splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from likeness.functions.scalars import finite

CHUNK = 1000  # row ids per split record


def read_task_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types (one extra pass over the text)."""
    return spark.read.csv(path, header=True, inferSchema=True)


def named_or_last(df: DataFrame, target: str) -> str:
    return target if target in df.columns else df.columns[-1]


def first_numeric(df: DataFrame, ignore: Sequence[str]) -> str | None:
    """The first numeric column that is no identifier."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ignore]
    return names[0] if names else None


def write_split(rows: DataFrame, path: str) -> None:
    """(task, row_id, split) as JSON records of at most CHUNK ids each.

    One folder per task pairs the split with the data of that name.
    """
    chunk = F.floor(F.col("row_id") / CHUNK)
    (rows.groupBy("task", "split", chunk.alias("chunk"))
     .agg(F.sort_array(F.collect_list("row_id")).alias("rows"))
     .write.partitionBy("task").json(path))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(task, row_id, split)."""
    records = spark.read.schema("split string, chunk long, rows array<long>, task string").json(path)
    return records.select("task", F.explode("rows").alias("row_id"), "split")


def index_split(data: DataFrame, split: DataFrame, min_train: int = 30, min_test: int = 20) -> DataFrame:
    """Rows with a target, labelled by the split; ``skipped`` marks the rows of tasks too small to score."""
    usable = data.withColumn("y", finite("y")).filter("y IS NOT NULL").join(split, ["task", "row_id"])
    sizes = usable.groupBy("task").agg(
        F.count_if(F.col("split") == "train").alias("_train"), F.count_if(F.col("split") == "test").alias("_test"))
    small = (F.col("_train") < min_train) | (F.col("_test") < min_test)
    return usable.join(sizes.select("task", small.alias("skipped")), "task")
