"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Distinct blocks are sorted and their
places in that order are their names; then the names of adjacent blocks are
paired, the distinct pairs are sorted and named in turn, and so on until one
name stands for the whole document. Contents are compared, never only hashed:
two documents have one name exactly if their texts are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.llm.stores import Workspace

#: Bytes in a block. Larger blocks need fewer rounds, smaller ones smaller rows.
BLOCK_BYTES = 4096
#: Text bytes in one Arrow batch on the way out of a task.
BATCH_BYTES = 16 << 20


def _cut(block_bytes: int):
    """Lower-case A-Z, digest and cut each text; one row per block."""
    names = ["row_id", "doc_id", "idx", "n", "sha", "block"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def cut(batches):
        for batch in batches:
            rows, held = [], 0
            for row_id, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_id", "text"))):
                text = text.lower()  # of bytes: A-Z only
                n = max(1, -(-len(text) // block_bytes))
                sha = hashlib.sha256(text).hexdigest()
                for i in range(n):
                    rows.append((row_id, doc_id, i, n, sha if i == 0 else None, text[i * block_bytes:(i + 1) * block_bytes]))
                held += len(text)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return cut


def _number(content: list[str], keep: list[str]):
    """Number the distinct contents of a sorted partition in order.

    Besides each row's (part, rank) it gives the contents of the partition's
    first and last hash: only those can go on in another partition.
    """
    def number(batches):
        part = TaskContext.get().partitionId()
        rank, last, first_h, first, ending = -1, None, None, [], []
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column("h"), *(batch.column(c) for c in content)]
            new = np.zeros(batch.num_rows, bool)
            for i, c in enumerate(cols):
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            new[0] = last != tuple(c[0].as_py() for c in cols)
            ranks = rank + np.cumsum(new)
            h = cols[0].to_numpy()
            if first_h is None:
                first_h = h[0]

            def taken(at):
                return [(int(ranks[i]), *(c[int(i)].as_py() for c in cols)) for i in at]

            first += taken(np.flatnonzero(new & (h == first_h)))
            ending = ([] if not ending or ending[0][1] != h[-1] else ending) + taken(np.flatnonzero(new & (h == h[-1])))
            rank, last = int(ranks[-1]), tuple(c[-1].as_py() for c in cols)
            kinds = {c: batch.schema.field(c).type for c in [*keep, "h", *content]}
            schema = pa.schema([*((c, kinds[c]) for c in keep), ("part", pa.int64()), ("rank", pa.int64()),
                                ("h", pa.int64()), *((c, kinds[c]) for c in content)])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.full(n, part, np.int64)), pa.array(ranks, pa.int64()),
                 pa.nulls(n, pa.int64()), *(pa.nulls(n, kinds[c]) for c in content)], schema=schema)
        edges = sorted(set(first + ending))
        if edges:
            n = len(edges)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, schema.field(c).type) for c in keep), pa.array([part] * n, pa.int64()),
                 *(pa.array(v, schema.field(k).type) for k, v in zip(["rank", "h", *content], zip(*edges)))], schema=schema)

    return number


def name_contents(ws: Workspace, rows: DataFrame, content: list[str], keep: list[str], spread: list[str],
                  label: str) -> DataFrame:
    """``keep`` and ``name``: equal contents get one integer, different ones never do.

    Rows are sorted by (hash, content) over range partitions. ``spread`` follows
    the hash in the range key, so a content that a third of all rows share is cut
    over many partitions; names of such contents are made one afterwards by a
    table of at most the two border hashes of each partition.
    """
    hashed = rows.withColumn("h", F.xxhash64(*content))
    ranged = hashed.repartitionByRange("h", *spread).sortWithinPartitions("h", *content)
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([
        *(T.StructField(c, fields[c]) for c in keep), T.StructField("part", T.LongType()),
        T.StructField("rank", T.LongType()), T.StructField("h", T.LongType()),
        *(T.StructField(c, fields[c]) for c in content)])
    numbered = ws.write(ranged.mapInArrow(_number(content, keep), schema), label)
    borders = numbered.filter("h is not null").groupBy("h", *content).agg(
        F.min(F.struct("part", "rank")).alias("first"), F.collect_set(F.struct("part", "rank")).alias("all"))
    again = borders.filter(F.size("all") > 1).select("first", F.explode("all").alias("own")).select(
        F.col("own.part").alias("part"), F.col("own.rank").alias("rank"),
        F.col("first.part").alias("to_part"), F.col("first.rank").alias("to_rank"))
    joined = numbered.filter("h is null").join(F.broadcast(again), ["part", "rank"], "left")
    name = F.shiftleft(F.coalesce("to_part", "part"), 40) + F.coalesce("to_rank", "rank")
    return joined.select(*keep, name.alias("name"))


def block_names(docs: DataFrame, ws: Workspace | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, text_sha256, level, name.

    Equal (level, name) means equal text after lower-casing A-Z. Null text is
    the empty text; null, repeated doc_ids and repeated rows keep rows of their
    own; other columns are not looked at. An empty table gives no rows.
    """
    ws = ws or Workspace(docs.sparkSession, "naming")
    text = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    blocks = text.mapInArrow(_cut(block_bytes), "row_id long, doc_id long, idx long, n long, sha string, block binary")
    named = name_contents(ws, blocks, ["block"], ["row_id", "doc_id", "idx", "n", "sha"], ["row_id", "idx"], "blocks")
    heads = named.filter("idx = 0")
    most = heads.agg(F.max("n")).first()[0] or 1
    done = heads.filter("n = 1").select("row_id", "doc_id", "sha", F.lit(0).alias("level"), "name")
    level, current, finished = 0, named.select("row_id", "idx", "n", "name"), []
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pairs = current.filter("n > 1").groupBy(
            "row_id", F.expr("idx div 2").alias("idx"), F.expr("(n + 1) div 2").alias("n")).agg(
            F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("left"),
            F.coalesce(F.max(F.expr("if(idx % 2 = 1, name, null)")), F.lit(-1)).alias("right"))
        current = name_contents(ws, pairs, ["left", "right"], ["row_id", "idx", "n"], ["row_id", "idx"], f"pairs{level}")
        finished.append(current.filter("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
    if finished:
        whole = finished[0]
        for more in finished[1:]:
            whole = whole.union(more)
        done = done.union(heads.filter("n > 1").select("row_id", "doc_id", "sha").join(whole, "row_id"))
    return done.withColumnRenamed("sha", "text_sha256")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, level, name for each row.

    The largest doc_id of equal texts stays (null is the smallest); if rows
    repeat a doc_id with the same text, one of them stays. Group sizes are
    summed before they are joined back, and that join's hot keys can be split.
    """
    ws = Workspace(docs.sparkSession, "exact")
    named = ws.write(block_names(docs, ws, block_bytes), "documents")
    groups = named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256", "level", "name")
