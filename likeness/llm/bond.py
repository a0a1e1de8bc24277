"""Hard negatives by a vertical scan: dimensions read one after another, rows given up as soon as bounds allow.

Rows are dealt into blocks that hold one column for each dimension with its least
and largest value. An anchor reads a block's columns in the order of its own
descending magnitudes. After some columns every row has a partial score, and the
least and largest remaining contribution of each unread column bound the rest.
A bitmap of candidates loses each row that no bound lets into the result; rows
left at the end have exact scores. That is done twice: for the best rows of an
anchor's own label (its positives), then for the windows below each positive's
score (its negatives).

Anchors are a stated set of rows, met with all rows by blocks: a task holds one
block and a bounded group of anchors; only the best of a block leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.stores import Workspace

#: Components reach up to here after scaling; rows beyond take no part, for a score might not fit 64 bits.
LARGEST = 1 << 26


@dataclass(frozen=True)
class Settings:
    """``rows`` in a block and ``anchors`` in a group are expected sizes; ``step`` columns are read between two looks."""

    scale: int = 256
    every: int = 100
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    rows: int = 8192
    anchors: int = 1024
    step: int = 8
    settled: int = 64


# ------------------------------------------------------------ inside a block

class Block:
    """Columns of one block of rows with their bounds."""

    def __init__(self, ids: np.ndarray, twins: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.twins, self.labels, self.columns = ids, twins, labels, columns
        self.least = columns.min(1) if columns.size else np.zeros(len(columns), np.int64)
        self.largest = columns.max(1) if columns.size else np.zeros(len(columns), np.int64)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep: Callable, step: int, settled: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the bitmap ``alive`` that stay under ``keep`` (rows, lowest, highest score), and their exact scores.

        Columns that one side lacks count as zeros on that side.
        """
        width = min(len(anchor), len(self.columns))
        anchor = anchor[:width]
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor * self.least[:width], anchor * self.largest[:width]
        low, high = np.minimum(*ends)[order], np.maximum(*ends)[order]
        # What the columns from each place on can add.
        low, high = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (low, high))
        alive = alive.copy()
        rows = np.flatnonzero(alive)
        partial = np.zeros(len(rows), np.int64)
        read = 0
        while read < width:
            size = step if len(rows) > settled else width - read
            which = order[read:read + size]
            partial += anchor[which] @ (self.columns[which] if len(rows) == len(alive) else self.columns[np.ix_(which, rows)])
            read += len(which)
            stay = keep(rows, partial + low[read], partial + high[read])
            if not stay.all():
                alive[rows[~stay]] = False
                rows, partial = rows[stay], partial[stay]
        return rows, partial

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places of the first n: higher scores, then smaller ids."""
        if len(rows) > 4 * n:
            edge = np.partition(scores, len(scores) - n)[len(scores) - n]
            near = np.flatnonzero(scores >= edge)
        else:
            near = np.arange(len(rows))
        return near[np.lexsort((self.twins[rows[near]], self.ids[rows[near]], -scores[near]))[:n]]

    def positives(self, anchor, label, own_id, own_twin, n, floor, step, settled):
        """The first n other rows of the label; ``floor`` is a score that n rows elsewhere reach, or None."""
        alive = (self.labels == label) & ~((self.ids == own_id) & (self.twins == own_twin))

        def keep(rows, lowest, highest):
            edge = np.partition(lowest, len(lowest) - n)[len(lowest) - n] if len(lowest) >= n else None
            if floor is not None:
                edge = floor if edge is None else max(edge, floor)
            return highest >= edge if edge is not None else np.ones(len(rows), bool)

        rows, scores = self.scan(anchor, alive, keep, step, settled)
        first = self.best(rows, scores, n)
        return rows[first], scores[first]

    def negatives(self, anchor, label, windows, n, step, settled):
        """For each window (lowest, highest score) the first n rows of other labels inside."""
        def keep(rows, lowest, highest):
            stay = np.zeros(len(rows), bool)
            for floor, top in windows:
                sure = lowest[(lowest >= floor) & (highest <= top)]
                edge = max(floor, np.partition(sure, len(sure) - n)[len(sure) - n]) if len(sure) >= n else floor
                stay |= (highest >= edge) & (lowest <= top)
            return stay

        rows, scores = self.scan(anchor, self.labels != label, keep, step, settled)
        for floor, top in windows:
            inside = np.flatnonzero((scores >= floor) & (scores <= top))
            first = inside[self.best(rows[inside], scores[inside], n)]
            yield rows[first], scores[first]


# ---------------------------------------------------------------- the tables

def valid_rows(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, twin, label, v): rows that take part, once each, with whole-number components.

    Left out: null vec_id, label or vector, null or non-finite components, and
    components beyond 2^26 after scaling. ``twin`` tells rows of one vec_id apart
    that differ in label or vector.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.floor(e * settings.scale))
    fits = F.coalesce(F.forall(F.col("embedding").cast("array<double>"),
                               lambda e: F.coalesce(F.abs(e) <= LARGEST / settings.scale, F.lit(False)) & ~F.isnan(e)), F.lit(False))
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL").filter(fits).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v"))
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return rows.withColumn("label", moved).withColumn("twin", F.xxhash64("label", "v")).dropDuplicates(["vec_id", "twin"])


BLOCK = "block long, ids binary, twins binary, labels binary, columns array<binary>"
ANCHOR = "part long, vec_id long, twin long, label long, v binary, floor long"


def _int64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _packed(table: pa.Table) -> pa.Table:
    """One row for all rows of a block; shorter vectors are filled with zeros."""
    vectors = [np.asarray(v, np.int64) for v in table.column("v").to_pylist()]
    columns = np.zeros((max(map(len, vectors)), len(vectors)), "<i8")
    for i, v in enumerate(vectors):
        columns[:len(v), i] = v
    row = [table.column("block")[0].as_py(), *(table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "twin", "label")),
           [c.tobytes() for c in columns]]
    return pa.table([pa.array([x], f) for x, f in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())))],
                    ["block", "ids", "twins", "labels", "columns"])


def _block(row: dict) -> Block:
    columns = np.asarray([_int64(c) for c in row["columns"]], np.int64).reshape(len(row["columns"]), len(row["ids"]) // 8)
    return Block(_int64(row["ids"]), _int64(row["twins"]), _int64(row["labels"]), columns)


def _anchors(settings: Settings, parts: int):
    """The anchors of each block, with the score that their positives there reach already."""
    def find(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            block = _block(row)
            out = []
            for i in np.flatnonzero(block.ids % settings.every == 0):
                v = np.ascontiguousarray(block.columns[:, i])
                _, scores = block.positives(v, block.labels[i], block.ids[i], block.twins[i], settings.positives, None,
                                            settings.step, settings.settled)
                floor = int(scores[-1]) if len(scores) == settings.positives else None
                out.append((int(block.twins[i]) % parts, int(block.ids[i]), int(block.twins[i]), int(block.labels[i]), v.tobytes(), floor))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary(), pa.int64()])],
                    ["part", "vec_id", "twin", "label", "v", "floor"])

    return find


FOUND = "vec_id long, twin long, positive_id long, positive_twin long, positive_score long, other_id long, other_twin long, score long"


def _met(settings: Settings, negatives: bool):
    """The best rows of a block for each anchor of a group (or for each of its positives)."""
    def meet(batches):
        names = [c.split()[0] for c in FOUND.split(", ")]
        for row in (r for b in batches for r in b.to_pylist()):
            block, out = _block(row), []
            for a in row["anchors"]:
                v, key = _int64(a["v"]), (a["vec_id"], a["twin"])
                if not negatives:
                    rows, scores = block.positives(v, a["label"], *key, settings.positives, a["floor"], settings.step, settings.settled)
                    out += [(*key, None, None, None, int(block.ids[r]), int(block.twins[r]), int(s)) for r, s in zip(rows, scores)]
                    continue
                # Whole numbers: 100 * score >= 80 * positive is score >= the next whole number above.
                windows = [(-(-settings.low * p["score"] // settings.high), p["score"]) for p in a["found"]]
                for p, (rows, scores) in zip(a["found"], block.negatives(v, a["label"], windows, settings.negatives, settings.step, settings.settled)):
                    out += [(*key, p["id"], p["twin"], p["score"], int(block.ids[r]), int(block.twins[r]), int(s)) for r, s in zip(rows, scores)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return meet


def _cells(blocks: DataFrame, anchors: DataFrame, parts: int, fields: list[str], settings: Settings, negatives: bool) -> DataFrame:
    """Every block with every group of anchors: as many tasks as there are cells, each of bounded size."""
    groups = anchors.groupBy("part").agg(F.collect_list(F.struct(*fields)).alias("anchors"))
    spread = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    return spread.join(groups, "part").repartition("block", "part").mapInArrow(_met(settings, negatives), FOUND)


def hard_negatives(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows equal in vec_id, label and vector count once; rows of one vec_id that
    differ are rows of their own, and each may be an anchor. Vectors of different
    lengths are compared as if the shorter ended in zeros; empty ones score 0.
    Ties go to the smaller vec_id, then to a hash of the row. An anchor without
    positives or a window without rows gives no row; so does an empty table.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "bond")
    rows = ws.write(valid_rows(vectors, settings), "rows")
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % settings.every == 0, 1)).alias("anchors")).first()
    blocks_n, parts = max(1, -(-sizes["n"] // settings.rows)), max(1, -(-sizes["anchors"] // settings.anchors))
    blocks = ws.write(rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "twin"), F.lit(blocks_n))).groupBy("block").applyInArrow(
        _packed, BLOCK), "blocks")
    ws.drop(rows)
    anchors = ws.write(blocks.mapInArrow(_anchors(settings, parts), ANCHOR), "anchors")
    met = _cells(blocks, anchors, parts, ["vec_id", "twin", "label", "v", "floor"], settings, False)
    first = Window.partitionBy("vec_id", "twin").orderBy(F.desc("score"), "other_id", "other_twin")
    found = met.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= settings.positives)
    positives = found.groupBy("vec_id", "twin").agg(F.collect_list(F.struct(
        F.col("other_id").alias("id"), F.col("other_twin").alias("twin"), F.col("score").alias("score"))).alias("found"))
    with_positives = ws.write(anchors.join(positives, ["vec_id", "twin"]), "positives")
    met = _cells(blocks, with_positives, parts, ["vec_id", "twin", "label", "v", "found"], settings, True)
    first = Window.partitionBy("vec_id", "twin", "positive_id", "positive_twin").orderBy(F.desc("score"), "other_id", "other_twin")
    return met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= settings.negatives).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
