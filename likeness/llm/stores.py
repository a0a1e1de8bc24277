"""Tables a query writes on its way, in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from likeness.session import discard, scratch_path


class Workspace:
    """Written tables by name. A lost executor costs a re-read of them, not the steps before.

    ``drop`` deletes one as soon as nothing reads it, which keeps the disk used
    within a few times the input.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{name}")
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        table._written_at = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            discard(self.spark, self._paths.pop(id(table)))
