"""From raw documents to packed sequences; each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm import block_naming, packing, simhash_trie, toxicity
from likeness.llm.stores import Workspace
from likeness.llm.survivors import only


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores below 0.5; the classifier learns from what this stage is given."""
    score = toxicity.scorer(spark, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(score("text") < 0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id; of rows equal in both, one."""
    stay = block_naming.exact_groups(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("key"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return only(docs, F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256), stay)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near fingerprints the row with the smallest doc_id."""
    groups = simhash_trie.near_groups(docs)
    first = groups.filter("doc_id <=> component_id").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    return only(docs, F.xxhash64("text"), first.select("first.doc_id", F.col("first.text_key").alias("key")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their sequences."""
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
