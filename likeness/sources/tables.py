"""Reading tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] = (), where: Column | str | None = None
) -> DataFrame:
    """Parquet scan; the predicate and the column list reach the file reader."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_relation(
    spark: SparkSession, url: str, table: str, columns: Sequence[str], where: str | None = None,
    split_on: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 64,
) -> DataFrame:
    """The same from a relational store; filter and projection are pushed to it.

    With ``split_on`` and its ``bounds`` the extract runs as parallel range
    queries, not as one cursor.
    """
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if split_on and bounds:
        options |= {"partitionColumn": split_on, "lowerBound": str(bounds[0]),
                    "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    df = spark.read.format("jdbc").options(**options).load()
    return (df.filter(where) if where else df).select(*columns)


#: Rows of a dealt table that lie in one task on average, at most.
TASK_ROWS = 500_000


def tasks_for(*scans: DataFrame) -> int | None:
    """Tasks that keep each at TASK_ROWS rows of the largest table; None when the session's number does.

    With a fixed number of shuffle partitions a task's memory would grow with the
    table. The tables are plain scans, of which rows are counted first.
    """
    wanted = -(-max(scan.count() for scan in scans) // TASK_ROWS)
    return wanted if wanted > int(scans[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def spread(scan: DataFrame) -> DataFrame:
    """Give costly per-row work enough tasks when a scan has only a few splits.

    A scan that already has a task per core, as any large table has, is left
    alone: no shuffle is added there.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
