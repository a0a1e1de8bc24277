"""Filtering a table to named rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def only(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``stay`` (doc_id, key) names, one for each name, with the columns they came with.

    Of rows equal in doc_id and key the one with the least hash of all its
    columns stays, whatever the partitions.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       key.alias("key"), F.xxhash64(*docs.columns).alias("whole"))
    named = stay.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "key")
    # The join leaves the rows partitioned and sorted by what the window needs.
    once = Window.partitionBy("id", "key").orderBy("whole")
    return rows.join(named, ["id", "key"], "left_semi").withColumn("n", F.row_number().over(once)).filter(
        "n = 1").select("row.*")
