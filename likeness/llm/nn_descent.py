"""Near-duplicate vectors over a neighbour graph made by NN-descent.

Equal vectors are one node. Lists begin with the nearest nodes in leaves of random
hyperplane trees; then each node compares its neighbours and those that have it
as a neighbour with one another, and lists keep the best, until few change. A node
whose list is full of links is compared with all nodes outside its component. A draw of nodes
is compared with all others to audit recall; if it is too low, trees are added, and
if that does not help or too few have links to tell, all nodes are compared in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likeness.llm.components import components
from likeness.llm.stores import Workspace


@dataclass(frozen=True)
class Settings:
    """``neighbours``: entries of a list, the nearest whatever their cosine is.

    ``leaf``: nodes a tree's leaf should hold; ``block``: rows multiplied at once.
    ``audited`` nodes check recall; more are drawn, up to ``most_audited`` (a bound on
    what is broadcast), until ``linked`` of them have links. ``side``: nodes of one
    side of a block where all are compared.
    """

    threshold: float = 0.98
    neighbours: int = 16
    trees: int = 6
    leaf: int = 512
    block: int = 1024
    audited: int = 256
    most_audited: int = 4096
    linked: int = 64
    side: int = 4096
    recall: float = 0.97
    still: float = 0.001


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    # Scale first: squares of very large or small components would leave the range.
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pack(batches):
    """Vectors that can be compared, as bytes of doubles; others have none."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            v = None if v is None or any(x is None for x in v) else np.asarray(v, "<f8")
            good = v is not None and len(v) and np.isfinite(v).all() and v.any()
            out.append((v + 0.0).tobytes() if good else None)  # + 0.0: one kind of zero
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())],
                                         ["vec_id", "label", "vec"])


def _groups(batches, keys: list[str], columns: list[str], most: int):
    """(key, columns) of each run of a sorted partition, cut at ``most`` rows."""
    key, held = None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in keys]
        data = [batch.column(c).to_pylist() for c in columns]
        for i, now in enumerate(zip(*cols)):
            if held is not None and (now != key or len(held[0]) >= most):
                yield key, held
                held = None
            if held is None:
                key, held = now, [[] for _ in columns]
            for h, d in zip(held, data):
                h.append(d[i])
    if held is not None:
        yield key, held


EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])


def _best(ids: np.ndarray, unit: np.ndarray, k: int, block: int):
    """Of each row its ``k`` best others, one block of rows at a time."""
    for i in range(0, len(ids), block):
        sims = unit[i:i + block] @ unit.T
        sims[np.arange(len(sims)), np.arange(i, i + len(sims))] = -2
        n = min(k, sims.shape[1])
        top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        value = np.take_along_axis(sims, top, 1)
        ok = value > -2
        a = np.repeat(ids[i:i + block], ok.sum(1))
        b = ids[top[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(value[ok])], schema=EDGES)


def _leaves(s: Settings, k: int):
    def compare(batches):
        for _, (ids, vecs) in _groups(batches, ["tree", "leaf"], ["cid", "vec"], 4 * s.leaf):
            if len(ids) > 1:
                yield from _best(np.asarray(ids), _unit(vecs), k, s.block)

    return compare


def _local(s: Settings, k: int):
    def compare(batches):
        for _, (ids, vecs) in _groups(batches, ["w"], ["cid", "vec"], 8 * k):
            if len(ids) > 1:
                yield from _best(np.asarray(ids), _unit(vecs), k, s.block)

    return compare


def _lists(edges: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(best)).filter(
        F.col("r") <= k).select("u", "v", "sim")


def _codes(s: Settings, first: int, trees: int):
    """(tree, leaf) of each vector: one sign bit for each hyperplane; deeper where a label has more nodes."""
    def code(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            cids, labels, bits = (batch.column(c).to_pylist() for c in ("cid", "label", "bits"))
            vecs = batch.column("vec").to_pylist()
            out = []
            for cid, label, depth, raw in zip(cids, labels, bits, vecs):
                v = np.frombuffer(raw, "<f8")
                v = v / np.abs(v).max()
                for tree in range(first, first + trees):
                    if (tree, len(v)) not in planes:
                        planes[tree, len(v)] = np.random.default_rng([tree, len(v)]).standard_normal((len(v), 48))
                    sign = (v @ planes[tree, len(v)] > 0).astype(int)
                    code = "".join(map(str, sign))
                    out.append((tree, f"{label}/{len(v)}/{code[:depth]}", code[depth:], cid, raw))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary()))],
                    ["tree", "leaf", "rest", "cid", "vec"])

    return code


def _grow(ws: Workspace, nodes: DataFrame, s: Settings, first: int, trees: int, k: int) -> DataFrame:
    """Edges within the leaves of some trees. Leaves too large are cut in the order of further planes."""
    sizes = nodes.groupBy("label").agg(F.count("*").alias("members"))
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("members") / s.leaf)), F.lit(0)), F.lit(48)).cast("int")
    coded = nodes.join(sizes, "label").select("cid", "label", "vec", depth.alias("bits")).mapInArrow(
        _codes(s, first, trees), "tree int, leaf string, rest string, cid long, vec binary")
    dealt = coded.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "rest", F.xxhash64("cid", "tree"))
    return dealt.mapInArrow(_leaves(s, k), "u long, v long, sim double")


def _descend(ws: Workspace, nodes: DataFrame, edges: DataFrame, s: Settings, k: int) -> DataFrame:
    """Improve the lists until the share of changed entries is below ``still``."""
    lists = ws.write(_lists(edges, k), "lists")
    fresh = lists
    while True:
        back = Window.partitionBy("u").orderBy(F.xxhash64("v"))  # a bounded draw of those that have u in their list
        reverse = lists.select(F.col("v").alias("u"), F.col("u").alias("v")).withColumn(
            "r", F.row_number().over(back)).filter(F.col("r") <= k).select("u", "v")
        around = lists.select("u", "v").union(reverse).distinct()
        moved = fresh.select("u").union(fresh.select("v")).distinct()
        members = around.join(moved, "u").select(F.col("u").alias("w"), F.col("v").alias("cid"))
        dealt = members.join(nodes.select("cid", "vec"), "cid").repartition("w").sortWithinPartitions("w", "cid")
        found = dealt.mapInArrow(_local(s, k), "u long, v long, sim double")
        after = ws.write(_lists(lists.union(found), k), "lists")
        fresh = ws.write(after.join(lists, ["u", "v"], "left_anti"), "fresh")
        changed, entries = fresh.count(), after.count()
        lists = after
        if changed <= s.still * entries:
            return lists


def _within(s: Settings):
    """Exact numbers of links between two blocks of one component; pairs are counted, not given."""
    def count(batches):
        for key, (ids, sides, mult, vecs) in _groups(
                batches, ["root", "i", "j"], ["cid", "side", "n", "vec"], 1 << 62):
            cid, side, mult = np.asarray(ids), np.asarray(sides), np.asarray(mult)
            unit = _unit(vecs)
            a, b = side == key[1], side == key[2]
            hit = unit[a] @ unit[b].T >= s.threshold
            if key[1] == key[2]:
                np.fill_diagonal(hit, False)
            out = [(cid[a], hit @ mult[b])] + ([(cid[b], hit.T @ mult[a])] if key[1] != key[2] else [])
            for c, n in out:
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], ["cid", "links"])

    return count


def _link_counts(nodes: DataFrame, roots: DataFrame, s: Settings) -> DataFrame:
    """Links of each node that is in a component of several, by blocks of its component."""
    size = roots.groupBy("root").agg(F.count("*").alias("size"))
    blocks = F.expr(f"cast((size + {s.block} - 1) div {s.block} AS int)")
    placed = nodes.join(roots.join(size, "root"), nodes["cid"] == roots["node"]).select(
        "cid", "vec", "n", "root", blocks.alias("blocks")).withColumn(
        "side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = placed.select("root", "cid", "vec", "n", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("root", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "cid", "side", "n", "vec")
    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "cid").mapInArrow(
        _within(s), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, counted: DataFrame, s: Settings) -> float | None:
    """Mean share of a node's true links that were found, over drawn nodes that have some.

    The draw is compared with all nodes. Nodes of few links are averaged apart and the
    lower mean counts. None if too few nodes of the largest draw, short of all, have links.
    """
    every, size = nodes.count(), s.audited
    while True:
        shares = _shares(nodes, counted, s, size)
        if size >= every or len(shares) >= s.linked:
            few = [x for x, true in shares if true < s.neighbours]
            return min((float(np.mean(x)) for x in ([x for x, _ in shares], few) if x), default=1.0)
        if size >= s.most_audited:
            return None
        size = min(4 * size, s.most_audited)


def _shares(nodes: DataFrame, counted: DataFrame, s: Settings, size: int) -> list[tuple[float, int]]:
    """(share found, true links) of those of ``size`` drawn nodes that have links."""
    drawn = nodes.orderBy(F.xxhash64("cid")).select("cid", "label", "vec").limit(size).collect()
    want = {}
    for r in drawn:
        want.setdefault((r["label"], len(r["vec"])), []).append((r["cid"], bytes(r["vec"])))
    shared = nodes.sparkSession.sparkContext.broadcast(  # at most ``most_audited`` vectors
        {k: (np.asarray([c for c, _ in v]), _unit([x for _, x in v])) for k, v in want.items()})

    def compare(batches):
        for batch in batches:
            kinds: dict = {}
            for cid, label, n, raw in zip(*(batch.column(c).to_pylist() for c in ("cid", "label", "n", "vec"))):
                kinds.setdefault((label, len(raw)), []).append((cid, n, raw))
            for kind, rows in kinds.items():
                if kind in shared.value:
                    ids, unit = shared.value[kind]
                    for i in range(0, len(rows), s.block):
                        part = rows[i:i + s.block]
                        hit = unit @ _unit([r[2] for r in part]).T >= s.threshold
                        hit &= ids[:, None] != np.asarray([r[0] for r in part])[None, :]
                        true = hit @ np.asarray([r[1] for r in part])
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(true.astype(np.int64))], ["cid", "true"])

    true = nodes.select("cid", "label", "n", "vec").mapInArrow(compare, "cid long, true long").groupBy("cid").agg(
        F.sum("true").alias("true")).filter(F.col("true") > 0)
    rows = true.join(counted, "cid", "left").select(F.col("true"), F.coalesce("links", F.lit(0)).alias("links")).collect()
    return [(r["links"] / r["true"], r["true"]) for r in rows]


def _across(s: Settings):
    """Links of a block's nodes on side 0 with those on side 1 that are in another component."""
    def compare(batches):
        for _, (ids, roots, sides, vecs) in _groups(
                batches, ["label", "length", "i", "j"], ["cid", "root", "side", "vec"], 1 << 62):
            ids, roots, side, unit = np.asarray(ids), np.asarray(roots), np.asarray(sides), _unit(vecs)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for i in range(0, len(a), s.block):
                part = a[i:i + s.block]
                hit = (unit[part] @ unit[b].T >= s.threshold) & (roots[part][:, None] != roots[b][None, :])
                x, y = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(ids[part[x]]), pa.array(ids[b[y]])], ["u", "v"])

    return compare


def _bridges(nodes: DataFrame, roots: DataFrame, which: DataFrame, s: Settings) -> DataFrame:
    """(u, v): all links of the nodes ``which`` (column u) into other components, by blocks of their label."""
    kind = ["label", "length"]
    placed = nodes.join(roots, nodes["cid"] == roots["node"], "left").select(
        "cid", "label", F.length("vec").alias("length"), "vec", F.coalesce("root", "cid").alias("root"))
    asked = placed.join(which.select(F.col("u").alias("cid")).distinct(), "cid", "left_semi")
    parts = lambda n: F.expr(f"cast(({n} + {s.side} - 1) div {s.side} AS int)")
    sizes = placed.groupBy(*kind).agg(F.count("*").alias("q")).join(
        asked.groupBy(*kind).agg(F.count("*").alias("p")), kind).select(*kind, parts("p").alias("p"), parts("q").alias("q"))

    def deal(df, side, own, other, i, j):
        return df.join(sizes, kind).select(
            *kind, "cid", "root", "vec", F.lit(side).alias("side"), F.pmod(F.xxhash64("cid"), F.col(own)).cast("int").alias(i),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j))

    dealt = deal(asked, 0, "p", "q", "i", "j").unionByName(deal(placed, 1, "q", "p", "j", "i"))
    return dealt.repartition(*kind, "i", "j").sortWithinPartitions(*kind, "i", "j").mapInArrow(_across(s), "u long, v long")


def near_vectors(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows are compared where labels are equal and not null and vectors have the same
    length. Null, zero and empty vectors and those with null or non-finite
    components link with nothing, and neither does a row without a label. Rows
    that repeat a vector are linked with one another; a repeated vec_id counts as
    several vectors. Null vec_ids give way to others in a component. Component
    members are compared exactly, so no link below the threshold is counted.
    """
    ws = Workspace(vectors.sparkSession, "descent")
    rows = ws.write(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                                   F.col("embedding")).mapInArrow(_pack, "vec_id long, label string, vec binary"), "rows")
    good = rows.filter("vec IS NOT NULL AND label IS NOT NULL")
    nodes = ws.write(good.groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn(
        "cid", F.monotonically_increasing_id()), "nodes")
    k, trees, found, first = s.neighbours, s.trees, None, 0
    while True:
        grown = _grow(ws, nodes, s, first, trees, k)
        found = _descend(ws, nodes, grown if found is None else found.union(grown), s, k)
        links = found.filter(F.col("sim") >= s.threshold).select("u", "v")
        roots = ws.write(components(ws, links, "u", "v"), "roots")
        full = found.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("least")).filter(
            (F.col("n") >= k) & (F.col("least") >= s.threshold)).select("u")
        bridges = ws.write(_bridges(nodes, roots, full, s), "bridges")  # the list has no room for them
        links = links.union(bridges)
        roots = ws.write(components(ws, links, "u", "v"), "roots")
        counted = ws.write(_link_counts(nodes, roots, s), "links")
        recall = _audit(nodes, counted, s)
        if recall is not None and recall >= s.recall:
            break
        if recall is None or first + trees >= 16 * s.trees:
            # Recall is unknown or stays low: all pairs of different components are compared.
            missed = _bridges(nodes, roots, nodes.select(F.col("cid").alias("u")), s)
            joined = ws.write(links.union(missed), "joined")
            roots = ws.write(components(ws, joined, "u", "v"), "roots")
            counted = ws.write(_link_counts(nodes, roots, s), "links")
            break
        first, trees = first + trees, first + trees
    named = nodes.join(roots, nodes["cid"] == roots["node"], "left").join(counted, "cid", "left").select(
        "label", "vec", F.coalesce("root", "cid").alias("root"), "least",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("label", "vec", "n_links", "component_id")
    linked = good.join(named, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("vec IS NULL OR label IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
