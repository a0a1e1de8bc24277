"""Packing documents into training sequences, shortest pack first over the length histogram.

Documents are cut into pieces of at most one sequence. Only the number of pieces
of each length (2048 numbers, whatever the corpus) is packed: lengths are placed
longest first, each into the open pack with the fewest tokens that has room, and
packs of one shape are one pattern with a count. Patterns are then dealt to the
pieces by their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likeness.llm.batches import by_bytes
from likeness.llm.stores import Workspace
from likeness.llm.tokens import WORD_BPE, word_encoder

#: Tokens in a sequence and the id after each document.
SEQUENCE, END_ID = 2048, 1
#: Bytes of text whose pieces leave a task together.
AT_ONCE = 3 << 20


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placing, count) that hold the whole histogram.

    ``histogram`` maps a length to its number of pieces. Pieces of a length go one
    by one to the open pack with the fewest tokens that has room, and to a new
    pack where none has; packs of one pattern move together. A length splits at
    most two patterns, so there are at most two for each length and one more,
    however many pieces there are.
    """
    packs: dict[int, dict[tuple[int, ...], int]] = {}  # tokens so far -> pattern -> count

    def put(total, pattern, count):
        shape = packs.setdefault(total, {})
        shape[pattern] = shape.get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            total = min((s for s in packs if s + length <= capacity), default=None)
            if total is None:  # new packs; each is the only one with room until it is full
                times = capacity // length
                if left >= times:
                    put(times * length, (length,) * times, left // times)
                if left % times:
                    put(left % times * length, (length,) * (left % times), 1)
                break
            pattern, count = next(iter(packs[total].items()))
            moved = min(left, count)
            del packs[total][pattern]
            if count > moved:
                packs[total][pattern] = count - moved
            elif not packs[total]:
                del packs[total]
            put(total + length, pattern + (length,), moved)
            left -= moved
    return [(pattern, count) for total in sorted(packs) for pattern, count in sorted(packs[total].items())]


PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local long")


def _pieces(path: str, end_id: int, capacity: int):
    """Cut each document's ids; number the pieces of one length within the task."""
    def cut(batches):
        encode, part = word_encoder(path).packed, TaskContext.get().partitionId()
        end, seen = np.asarray([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in by_bytes(batches, "text", AT_ONCE):
            rows = []
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                data = packed + end
                n = len(data) // 4
                for start in range(0, n, capacity):
                    piece = data[4 * start:4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, part, int(seen[length])))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return cut


def _slots(spark, patterns: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """(length, first, last, times, slot, sequence, offset) ranges of ranks.

    A pattern with ``count`` packs that holds ``times`` pieces of a length takes
    count * times consecutive ranks; rank r of them is piece r % times of pack
    r // times, at ``offset`` plus its place times the length.
    """
    taken, rows, base = Counter(), [], 0
    for pattern, count in patterns:
        offset = 0
        for length, times in Counter(pattern).items():  # in order of placing: equal lengths are adjacent
            rows.append((length, taken[length], taken[length] + count * times - 1, times, base, offset))
            taken[length] += count * times
            offset += times * length
        base += count
    return spark.createDataFrame(rows, "length long, first long, last long, times long, base long, begin long")


def packed(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID, capacity: int = SEQUENCE) -> DataFrame:
    """One row per piece with its sequence and its place there.

    Null text is empty (the end id alone), repeated and null doc_ids are
    documents of their own, no row gives no rows, other columns are not looked at.
    Ranks are local ranks within a write task plus the tasks' counts, so a length
    that a third of all pieces share is ranked by all tasks.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    pieces = ws.write(rows.mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The driver holds one number per length; patterns are bounded by the capacity, not by the corpus.
    slots = _slots(spark, shortest_pack_first(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("rank", F.col("local") + F.col("before")).alias("p")
    s = F.broadcast(slots).alias("s")
    return ranked.join(s, (F.col("p.length") == F.col("s.length")) & F.col("rank").between(
        F.col("first"), F.col("last"))).select(
        "doc_id", "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens",
        F.expr("base + (rank - first) div times").alias("sequence_id"),
        (F.col("begin") + (F.col("rank") - F.col("first")) % F.col("times") * F.col("p.length")).alias("offset"))
