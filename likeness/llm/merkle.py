"""A Merkle manifest of a table that keeps few of its nodes and makes the others anew for proofs.

Each source is a tree of threes over its rows, and the sources' roots are the
leaves of one more tree. Only every third level is written: a row of a written
table is one aligned subtree's 27 lowest nodes. To extract proofs, a task makes
the two levels between anew from a subtree's stored nodes, adds each node's
siblings to the path that the subtree's own root has, and forgets them. So a path
is handed down by subtrees and not by rows, from the last written level to the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.stores import Workspace


@dataclass(frozen=True)
class Settings:
    """``fan`` nodes have one parent; one level of ``every`` is written."""

    fan: int = 3
    every: int = 3

    @property
    def width(self) -> int:
        return self.fan ** self.every


def _parent(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def subtree(nodes: list[bytes], total: int, settings: Settings) -> list[list[bytes]]:
    """Levels of one aligned subtree, its stored nodes first; a tree of ``total`` such nodes may end before."""
    levels = [nodes]
    while len(levels) <= settings.every and total > 1:
        below = levels[-1]
        levels.append([_parent(below[i:i + settings.fan]) for i in range(0, len(below), settings.fan)])
        total = -(-total // settings.fan)
    return levels


def siblings(levels: list[list[bytes]], place: int, fan: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(left, right) siblings of a stored node and of its ancestors below the subtree's root."""
    for level in levels[:-1]:
        first = place - place % fan
        yield level[first:place], level[place + 1:first + fan]
        place //= fan


def _path(steps) -> bytes:
    """Each step as two counts and the digests."""
    return b"".join(bytes([len(left), len(right)]) + b"".join(left) + b"".join(right) for left, right in steps)


def _steps(path: bytes) -> Iterator[tuple[list[bytes], list[bytes]]]:
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        nodes = [path[at + 2 + 32 * i:at + 34 + 32 * i] for i in range(left + right)]
        yield nodes[:left], nodes[left:]
        at += 2 + 32 * (left + right)


def fold(leaf: bytes, steps) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        leaf = _parent([*left, leaf, *right])
    return leaf


# -------------------------------------------------------------- leaf digests

def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*fields), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, source, doc_id, leaf, changed): ``changed`` is the tampered leaf where it differs, else null.

    Tampered are rows whose doc_id as text has an even crc32; their text loses its line feeds.
    """
    c = {name: F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")}
    fields = [_field(c[name]) for name in ("doc_id", "source", "lang", "n_chars")]
    leaf = _digest(*fields, _field(c["text"]))
    tampered = (F.crc32(c["doc_id"].cast("string").cast("binary")) % 2 == 0) & F.contains(c["text"], F.lit("\n"))
    changed = F.when(tampered, _digest(*fields, _field(F.translate(c["text"], "\n", ""))))
    return docs.select(_field(c["source"]).alias("key"), c["source"].cast("string").alias("source"),
                       c["doc_id"].cast("long").alias("doc_id"), leaf.alias("node"), changed.alias("changed"))


# ----------------------------------------------------------------- positions

def _local(columns: list[str]) -> Callable:
    """Add the task and each row's place among the rows of its key in the task; rows come sorted by key."""
    def number(batches):
        task, key, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for own in batch.column("key").to_pylist():
                if own != key:
                    key, seen = own, 0
                places.append(seen)
                seen += 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([task] * len(places), pa.int64()), pa.array(places, pa.int64())],
                [*columns, "task", "local"])

    return number


def positions(ws: Workspace, rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos`` among the rows of the key and their number ``total``.

    Rows are range-partitioned by key and order, so a key that holds a third of
    all rows is numbered by a third of the tasks; one row for each task and key
    gives the numbers before.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.repartitionByRange(F.col("key"), *order).sortWithinPartitions(F.col("key"), *order)
    local = ws.write(ranged.mapInArrow(_local(rows.columns), f"{kinds}, task long, local long"), "numbered")
    counts = local.groupBy("key", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                            F.sum("n").over(Window.partitionBy("key")).alias("total"))
    return local.join(offsets, ["key", "task"]).withColumn("pos", F.col("before") + F.col("local")).drop("task", "local", "before")


# --------------------------------------------------------------------- trees

BLOCK = ["key", "block", "total"]


def _blocks(rows: DataFrame, fields: list[str], width: int) -> DataFrame:
    """One row for each aligned subtree, its stored nodes in order: at most ``width``."""
    return rows.withColumn("block", F.expr(f"pos div {width}")).groupBy(*BLOCK).agg(
        F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("items"))


def _tops(settings: Settings):
    """The root of each subtree as a node of the next written level."""
    def top(batches):
        for batch in batches:
            rows = [(r["key"], r["block"], -(-r["total"] // settings.width),
                     subtree([i["node"] for i in r["items"]], r["total"], settings)[-1][0])
                    for r in batch.select([*BLOCK, "items"]).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                    ["key", "pos", "total", "node"])

    return top


def grown(ws: Workspace, rows: DataFrame, fields: list[str], settings: Settings) -> tuple[list[DataFrame], DataFrame]:
    """Written levels of the trees of all keys, lowest first, and (key, root).

    ``rows``: key, pos, total, node and ``fields``. Each level has a 27th of the
    rows of the one below; the loop ends when every key has come to one node.
    """
    levels, roots = [], None
    while True:
        blocks = ws.write(_blocks(rows, ["node", *(fields if not levels else [])], settings.width), "level")
        levels.append(blocks)
        above = ws.write(blocks.mapInArrow(_tops(settings), "key string, pos long, total long, node binary"), "nodes")
        done = above.filter("total = 1").select("key", F.col("node").alias("root"))
        roots = done if roots is None else roots.union(done)
        rows = above.filter("total > 1")
        if rows.isEmpty():
            return levels, roots


def _handed_down(settings: Settings):
    """Paths of a subtree's stored nodes: their siblings in it, then its root's path."""
    def hand(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                levels = subtree([i["node"] for i in r["items"]], r["total"], settings)
                for place, item in enumerate(r["items"]):
                    out.append((r["key"], item["pos"], r["subroot"], _path(siblings(levels, place, settings.fan)) + r["path"]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                    ["key", "block", "subroot", "path"])

    return hand


def with_paths(ws: Workspace, levels: list[DataFrame], tops: DataFrame, settings: Settings) -> DataFrame:
    """The lowest level's subtrees with the path from each one's root on.

    ``tops``: (key, subroot, path) of the trees' roots. A key joins at the level
    where it has one subtree; below, paths come from the level above.
    """
    handed = None
    for at in reversed(range(len(levels))):
        own = levels[at].filter(F.col("total") <= settings.width).join(tops, "key")
        if handed is not None:
            own = own.unionByName(levels[at].join(handed, ["key", "block"]))
        if at == 0:
            return own
        handed = ws.write(own.mapInArrow(_handed_down(settings), "key string, block long, subroot binary, path binary"), "paths")


OUT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proofs(root: bytes, settings: Settings):
    """Emit every row's proof digest and what its leaf folds to."""
    def prove(batches):
        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                levels = subtree([i["node"] for i in r["items"]], r["total"], settings)
                further = list(_steps(r["path"]))
                rest = "".join(n.hex() for step in further for side in step for n in side).encode()
                for place, item in enumerate(r["items"]):
                    near = list(siblings(levels, place, settings.fan))
                    own = "".join(n.hex() for step in near for side in step for n in side).encode()
                    folded = fold(item["changed"] or item["node"], near + further)
                    out.append((item["doc_id"], item["node"].hex(), r["subroot"].hex(), root.hex(),
                                hashlib.sha256(own + rest).hexdigest(), folded.hex(), folded == root))
            if out:
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return prove


def _listed(batches):
    """(key, place among the sources) of the blocks of the tree of sources."""
    for batch in batches:
        items = [i for r in batch.to_pylist() for i in r["items"]]
        if items:
            yield pa.RecordBatch.from_arrays(
                [pa.array([i["pos"] for i in items], pa.int64()), pa.array([i["own"] for i in items], pa.string())], ["block", "own"])


def manifest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Nulls are ``-`` in a leaf; a null source is a source of its own and comes
    first; rows of null doc_id come first in their source and are not tampered
    with. Rows of one doc_id are leaves of their own, ordered by digest; equal
    rows give equal leaves whose proofs differ by place. A lone row of a lone
    source has no siblings: its proof is the digest of nothing. No row gives no
    rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "merkle")
    hashed = ws.write(leaves(docs), "leaves")
    numbered = positions(ws, hashed.drop("source"), [F.col("doc_id").asc_nulls_first(), F.col("node"), F.col("changed")])
    levels, roots = grown(ws, numbered, ["doc_id", "changed"], settings)
    sources = hashed.select("key", "source").distinct().join(roots, "key").select(
        F.lit("").alias("key"), "source", F.col("key").alias("own"), F.col("root").alias("node"))
    placed = positions(ws, sources, [F.col("source").asc_nulls_first()])
    upper, top = grown(ws, placed, ["own"], settings)
    found = top.first()
    if found is None:
        return spark.createDataFrame([], OUT)
    root = bytes(found["root"])
    lone = top.select("key", F.col("root").alias("subroot"), F.lit(b"").alias("path"))
    paths = with_paths(ws, upper, lone, settings).mapInArrow(_handed_down(settings), "key string, block long, subroot binary, path binary")
    names = upper[0].mapInArrow(_listed, "block long, own string")
    tops = ws.write(paths.join(names, "block").select(F.col("own").alias("key"), "path").join(roots, "key").select(
        "key", F.col("root").alias("subroot"), "path"), "tops")
    return with_paths(ws, levels, tops, settings).mapInArrow(_proofs(root, settings), OUT)
