"""The exact histogram of encoded lengths, and what follows from it for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likeness.llm.stores import Workspace
from likeness.llm.tokens import WORD_BPE, word_encoder

#: Lengths in one block of the running sums.
BLOCK = 1024


def _lengths(path: str):
    def measure(batches):
        encode = word_encoder(path).packed
        for batch in batches:
            n = [len(ids) // 4 for ids in encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return measure


def token_counts(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null text has no tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _lengths(tokenizer), "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """(n_tokens, docs) with sums over all lengths up to and from each one on.

    Columns: docs of that length, ``docs_from`` and ``tokens_from`` (suffix sums:
    of documents at least as long), ``docs_to`` and ``tokens_to`` (of those at most
    as long), and ``truncated_tokens``, the corpus's tokens if every document were
    cut at n_tokens. Blocks of lengths are summed first and only block sums meet
    in one window, so the work is spread whatever the longest document is.
    An empty table gives no rows.
    """
    histogram = counts.groupBy("n_tokens").agg(F.count("*").alias("docs")).withColumn(
        "tokens", F.col("docs") * F.col("n_tokens")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    # Read twice below; a row for each length, so that texts are encoded once.
    histogram = Workspace(counts.sparkSession, "lengths").write(histogram, "histogram")
    blocks = histogram.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)  # one row for each block of lengths
    whole = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("later_d"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("later_t"),
        F.sum("bd").over(whole).alias("all_d"), F.sum("bt").over(whole).alias("all_t"))
    on = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    sums = histogram.join(blocks, "block").withColumns({
        "docs_from": F.sum("docs").over(on) + F.col("later_d"),
        "tokens_from": F.sum("tokens").over(on) + F.col("later_t")})
    return sums.select(
        "n_tokens", "docs", "docs_from", "tokens_from",
        (F.col("all_d") - F.col("docs_from") + F.col("docs")).alias("docs_to"),
        (F.col("all_t") - F.col("tokens_from") + F.col("tokens")).alias("tokens_to"),
        (F.col("all_t") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"),
        "all_d", "all_t")


def length_report(counts: DataFrame) -> DataFrame:
    """The histogram with ``quantile``: the share of documents at most that long.

    A quantile q is the least n_tokens whose ``quantile`` is at least q, and the
    row of the largest length up to a limit gives what that limit keeps and cuts.
    """
    return length_histogram(counts).select(
        "n_tokens", "docs", "docs_from", "tokens_from", "docs_to", "tokens_to", "truncated_tokens",
        (F.col("docs_to") / F.col("all_d")).alias("quantile"))


def at_limits(report: DataFrame, limits: list[int]) -> DataFrame:
    """What any context limits keep and cut, present as a length or not.

    The suffix sums of the lengths from the limit on answer it: those documents
    are cut to the limit, all shorter ones stay whole.
    """
    over = F.col("n_tokens") >= F.col("context")
    every = F.explode(F.array(*(F.lit(n).cast("long") for n in limits)))
    return report.select(every.alias("context"), "n_tokens", "docs").groupBy(
        "context").agg(
        F.sum(F.when(over, 0).otherwise(F.col("docs"))).alias("docs_whole"),
        F.sum(F.when(over, F.col("docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.col("docs") * F.least("n_tokens", "context")).alias("truncated_tokens"))
