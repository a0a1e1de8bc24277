"""Near duplicates by SimHash, found by joining the binary trie of fingerprints with itself.

A node of the trie is a prefix of fingerprints. Two nodes of one depth are
traversed together: their children are paired, differing bits add up, and a pair
over the error budget is left with all that lies below it. Spark walks the upper
levels, four bits at a time, until a pair of nodes holds few fingerprints; each
such pair is then one small unit of work, walked bit by bit in a task.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from likeness.llm.components import components
from likeness.llm.stores import Workspace

#: Words in a shingle, hash seed, most bits that linked fingerprints differ in.
WORDS, SEED, BUDGET = 3, 42, 2
#: Bits that one distributed step goes down, and fingerprints a unit of work may hold.
STRIDE, UNIT = 4, 4096
#: Pairs compared at once, and pairs of leaves below which a walk compares directly.
CHUNK, DIRECT = 1 << 21, 256
#: Shingle hashes whose bits are counted at once.
BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed integer; no words give zero."""
    found = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[i:i + BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.int64))


def _fingerprints(words: int, seed: int):
    def fold(batches):
        for batch in batches:
            fps = [fingerprint(t, words, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fps, pa.int64()), batch.column("text_key")], ["doc_id", "fp", "text_key"])

    return fold


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, text_key) of every row and whole text; text_key tells rows of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_fingerprints(words, seed), "doc_id long, fp long, text_key long")


# --- the walk within a unit -----------------------------------------------------

def _walk(a: np.ndarray, b: np.ndarray, depth: int, spent: int, total: int, same: bool):
    """Index pairs (i, j) whose a[i], b[j] differ in at most ``total`` bits; sorted unsigned input.

    All of a and all of b share their first ``depth`` bits, which differ in ``spent``.
    ``same``: a is b, and a pair is found once. Nodes are index ranges.
    """
    lo_a, hi_a, lo_b, hi_b = (np.array([x]) for x in (0, len(a), 0, len(b)))
    spent = np.array([spent])
    left, right = [], []
    while len(lo_a):
        small = ((hi_a - lo_a) * (hi_b - lo_b) <= DIRECT) if depth < 64 else np.ones(len(lo_a), bool)
        for i, j in _compare(a, b, *(x[small] for x in (lo_a, hi_a, lo_b, hi_b)), total, same):
            left.append(i)
            right.append(j)
        lo_a, hi_a, lo_b, hi_b, spent = (x[~small] for x in (lo_a, hi_a, lo_b, hi_b, spent))
        if not len(lo_a):
            break
        bit = np.uint64(63 - depth)
        ones_a = np.concatenate([[0], np.cumsum((a >> bit & np.uint64(1)).astype(np.int64))])
        ones_b = ones_a if same else np.concatenate([[0], np.cumsum((b >> bit & np.uint64(1)).astype(np.int64))])
        mid_a, mid_b = hi_a - (ones_a[hi_a] - ones_a[lo_a]), hi_b - (ones_b[hi_b] - ones_b[lo_b])
        twin = (lo_a == lo_b) & (hi_a == hi_b) if same else np.zeros(len(lo_a), bool)
        children = [(lo_a, mid_a, lo_b, mid_b, spent, None), (mid_a, hi_a, mid_b, hi_b, spent, None),
                    (lo_a, mid_a, mid_b, hi_b, spent + 1, None), (mid_a, hi_a, lo_b, mid_b, spent + 1, ~twin)]
        kept = []
        for *c, also in children:
            ok = (c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= total)
            kept.append([x[ok if also is None else ok & also] for x in c])
        lo_a, hi_a, lo_b, hi_b, spent = (np.concatenate(x) for x in zip(*kept))
        depth += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(a, b, lo_a, hi_a, lo_b, hi_b, total, same):
    """The linked pairs of small node pairs, a bounded number of candidates at a time."""
    sizes = (hi_a - lo_a) * (hi_b - lo_b)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        n = sizes[start:stop]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(hi_b[start:stop] - lo_b[start:stop], n)
        i = np.repeat(lo_a[start:stop], n) + at // wide
        j = np.repeat(lo_b[start:stop], n) + at % wide
        near = np.bitwise_count(a[i] ^ b[j]) <= total
        if same:
            near &= i < j
        yield i[near], j[near]
        start = stop


def _stars(fps: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Each linked fingerprint of a unit with the first one it is linked with over any steps."""
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _units(budget: int):
    """Walk the units of a sorted partition one after another."""
    def found(depth, mask, fps):
        keys, mask = fps.view(np.uint64), mask % 2 ** 64
        if mask == 0:
            keys = np.sort(keys)
            i, j = _walk(keys, keys, depth, 0, budget, True)
        else:
            high = np.uint64(64 - depth + mask.bit_length() - 1)
            side = (keys >> high & np.uint64(1)).astype(bool)
            a, b = np.sort(keys[~side]), np.sort(keys[side])
            keys = np.concatenate([a, b])
            i, j = _walk(a, b, depth, mask.bit_count(), budget, False)
            j = j + len(a)
        return _stars(keys.view(np.int64), i, j)

    def walk(batches):
        key, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("depth", "mask", "node", "fp")]
            if not len(cols[0]):
                continue
            cuts = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            a, b = [], []
            for start, stop in zip([0, *cuts], [*cuts, len(cols[0])]):
                now = tuple(int(c[start]) for c in cols[:3])
                if now != key and held:
                    x, y = found(key[0], key[1], np.concatenate(held))
                    a.append(x)
                    b.append(y)
                    held = []
                key = now
                held.append(cols[3][start:stop])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        if held:
            x, y = found(key[0], key[1], np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return walk


# --- the walk over the upper levels ---------------------------------------------

def _deeper(rows: DataFrame, depth: int, budget: int, stride: int) -> DataFrame:
    """(fp, mask) of ``depth - stride`` with each mask of ``depth`` that the budget allows.

    A mask is the XOR of the two nodes of a pair. Of a pair, ``node`` is the lesser
    prefix; a fingerprint below the other one has that prefix too, XORed back.
    """
    steps = F.array(*(F.lit(m).cast("long") for m in range(2 ** stride) if m.bit_count() <= budget))
    spread = rows.select("fp", "mask", F.explode(steps).alias("m")).filter(
        F.bit_count("mask") + F.bit_count("m") <= budget).select(
        "fp", (F.shiftleft("mask", stride).bitwiseOR(F.col("m"))).alias("mask"))
    prefix = F.shiftrightunsigned("fp", 64 - depth)
    return spread.withColumn("prefix", prefix).select(
        "fp", "mask", F.least("prefix", F.col("prefix").bitwiseXOR(F.col("mask"))).alias("node"),
        (F.col("prefix") > F.col("prefix").bitwiseXOR(F.col("mask"))).alias("side"))


def trie_links(ws: Workspace, distinct: DataFrame, budget: int = BUDGET, unit: int = UNIT, stride: int = STRIDE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that keep every component.

    A unit gives a star for each of its components instead of all its pairs, so
    a dense cluster gives no more links than it has members in each unit.
    """
    rows = ws.write(distinct.select("fp", F.lit(0).cast("long").alias("mask")), "depth0")
    n, depth, units = rows.count(), 0, []
    if n <= unit:
        units.append(rows.select(F.lit(0).alias("depth"), "mask", F.lit(0).cast("long").alias("node"), "fp"))
        n = 0
    while n:
        depth += stride
        placed = _deeper(rows, depth, budget, stride)
        size = placed.groupBy("node", "mask").agg(
            F.count("*").alias("n"), F.max("side").alias("ones"), F.min("side").alias("zeros"))
        alive = size.filter("n > 1 AND (mask = 0 OR (ones AND NOT zeros))")
        state = ws.write(placed.join(alive.select("node", "mask", "n"), ["node", "mask"]), f"depth{depth}")
        units.append(state.filter(F.col("n") <= unit).select(F.lit(depth).alias("depth"), "mask", "node", "fp"))
        rows = state.filter(F.col("n") > unit).select("fp", "mask")
        n = rows.count() if depth < 64 else 0
    work = units[0]
    for more in units[1:]:
        work = work.union(more)
    dealt = work.repartition("depth", "mask", "node").sortWithinPartitions("depth", "mask", "node")
    return dealt.mapInArrow(_units(budget), "a long, b long")


def near_groups(docs: DataFrame, budget: int = BUDGET, words: int = WORDS, seed: int = SEED, unit: int = UNIT,
                stride: int = STRIDE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, root and text_key of every row.

    component_id is the least doc_id reachable over fingerprints that differ in
    at most ``budget`` bits, itself included. Null and empty texts and texts
    without words have fingerprint zero and are linked like any other. Rows that
    repeat a doc_id or a text stay rows of their own; null doc_ids give way to
    any other in a component; an empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    marked = ws.write(fingerprints(docs, words, seed), "fingerprints")
    classes = ws.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(ws, trie_links(ws, classes, budget, unit, stride), "a", "b")
    linked = classes.join(roots, classes["fp"] == roots["node"]).select("fp", "root", "least")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    named = linked.join(lowest, "root").select("fp", "lowest", "root")
    ids = classes.join(named, "fp", "left").select(
        "fp", F.coalesce("lowest", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return marked.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_key")
