"""Near-equal lines: SimHash, pigeonhole blocks, edit similarity, connected groups.

Lines are normalised (A-Z lower-cased, runs of white space to one space) and
equal ones become one class. A class has the SimHash of its distinct
words (once each, or a mark that fills half of a line would be all of its hash). If two of 64
bits' fingerprints differ in at most three bits, at least two of their five
blocks are equal; so each fingerprint is put under its ten pairs of blocks
(about 26 bits each, hence few chance meetings however many lines there are), and
fingerprints that meet are compared. Only lines of near fingerprints are compared
as texts.

The rule of a link is both: fingerprints within the budget of bits, and edit
similarity. Pairs of the one and the other are all found; of all pairs of an edit
similarity of 0.8 those with near fingerprints are few (the README has a table),
since one changed word of ten moves about nine bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh3_128_digest

from likeness.llm.components import components
from likeness.llm.stores import Workspace

#: Bits that near fingerprints may differ in, blocks, and blocks that then must be equal.
BITS, BLOCKS = 3, 5
#: Least edit similarity: 1 - distance / length of the longer line.
SIMILARITY = 0.8
#: Bytes of text whose words are counted at once; words added up in one byte for each bit.
AT_ONCE, LANE = 4 << 20, 255
#: Characters of a line up to which Spark measures the edit distance itself, a cell of the table at a time.
LONG = 64
#: Words ahead in which two lines are sought to agree again.
REACH = 8
#: Fingerprints of one bucket that are compared at once.
ROWS = 2048
#: Bits of a key that say, before the exact join, whether its line may be wanted; bytes of one of Spark's bitmaps.
FILTER_BITS, BITMAP = 26, 4096


def normalise(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _simhashes(words: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the distinct words of each line; ``sizes`` words each, in order, none zero."""
    coded = words.dictionary_encode()
    hashes = np.asarray([xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    # A word's bits are 64 bytes of 0 or 1, held as 8 integers: up to 255 words add up without a carry.
    lanes = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    pairs = np.repeat(np.arange(len(sizes)) << 32, sizes) | coded.indices.to_numpy()
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    line, word = pairs >> 32, pairs & 0xFFFFFFFF
    n = np.bincount(line, minlength=len(sizes))
    first = np.cumsum(n) - n
    parts = -(-n // LANE)
    head = np.cumsum(parts) - parts
    cuts = np.repeat(first, parts) + LANE * (np.arange(parts.sum()) - np.repeat(head, parts))
    ones = np.add.reduceat(lanes[word], cuts, axis=0).view(np.uint8)
    if len(cuts) > len(n):
        ones = np.add.reduceat(ones, head, axis=0, dtype=np.int64)
    return np.packbits(2 * ones.astype(np.int64) > n[:, None], axis=1).view(">u8").ravel().astype(np.int64)


def _slices(batch):
    """Parts of a batch with about AT_ONCE bytes of text each, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


LINES = "row_id long, doc_id long, line_no long, k1 long, k2 long, fp long"


def _lines(batches):
    """The lines of all texts without their words: keys, place and fingerprint."""
    for batch in batches:
        for part in _slices(batch):
            text = pc.ascii_lower(pc.fill_null(part.column("text").cast(pa.string()), ""))
            split = pc.split_pattern(text, "\n")
            of_text = pc.list_value_length(split).to_numpy()
            row = np.repeat(np.arange(len(of_text)), of_text)
            words = pc.ascii_split_whitespace(split.flatten())
            line = pc.list_parent_indices(words).to_numpy()
            flat = words.flatten().cast(pa.binary())
            real = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty word
            line, flat = line[real], flat.filter(pa.array(real))
            sizes = np.bincount(line, minlength=len(row))
            full = sizes > 0
            k, fp = np.zeros((len(row), 2), np.uint64), np.zeros(len(row), np.int64)
            if full.any():
                offsets = np.concatenate([[0], np.cumsum(sizes[full])])
                plain = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), b" ")
                digests = b"".join(xxh3_128_digest(x) for x in plain.to_pylist())
                k[full] = np.frombuffer(digests, ">u8").reshape(-1, 2)
                fp[full] = _simhashes(flat, sizes[full])
            k = k.view(np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column("row_id").take(pa.array(row)), part.column("doc_id").take(pa.array(row)),
                pa.array(np.arange(len(row)) - np.repeat(np.cumsum(of_text) - of_text, of_text)),
                pa.array(k[:, 0], mask=~full), pa.array(k[:, 1], mask=~full), pa.array(fp, mask=~full)],
                ["row_id", "doc_id", "line_no", "k1", "k2", "fp"])


def _wanted_bits(keys: DataFrame) -> np.ndarray:
    """One bit for each value of the last FILTER_BITS bits of the keys' k1, 8 MB at any scale."""
    bit = F.col("k1").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    block = 8 * BITMAP
    parts = keys.select(F.expr(f"CAST({(1 << FILTER_BITS) - 1} & k1 AS BIGINT) div {block}").alias("part"), (bit % block).alias("bit"))
    found = parts.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    wanted = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in found.collect():  # of fixed size: at most 2 ** FILTER_BITS / 8 bytes in all
        wanted[row["part"] * BITMAP:(row["part"] + 1) * BITMAP] = np.frombuffer(row["bits"], np.uint8)
    return wanted


def _texts(wanted):
    """Normalised lines under their keys: all that are wanted and those that share a bit with one."""
    def find(batches):
        bits = wanted.value
        mask = (1 << FILTER_BITS) - 1
        for batch in batches:
            every = list(set().union(*(map(normalise, set((t or b"").split(b"\n"))) for t in batch.column("text").to_pylist())) - {b""})
            k = np.frombuffer(b"".join(map(xxh3_128_digest, every)), ">u8").reshape(-1, 2).astype(np.uint64)
            low = (k[:, 0] & np.uint64(mask)).astype(np.int64)
            at = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
            k = k[at].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array([every[i] for i in at], pa.binary()).cast(pa.string())],
                ["k1", "k2", "line"])

    return find


def _masks(bits: int, blocks: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - bits)]


def _meetings(bits: int):
    """Near fingerprints of each bucket of a sorted partition, a bounded number of rows at a time."""
    def near(new, held):
        for i in range(0, len(held), ROWS):
            d = np.bitwise_count(new[:, None] ^ held[None, i:i + ROWS]) <= bits
            a, b = np.nonzero(d)
            yield new[a], held[i + b]

    def meet(batches):
        key, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            which, bucket, fps = (batch.column(c).to_numpy() for c in ("which", "bucket", "fp"))
            if not len(fps):
                continue
            fps = fps.view(np.uint64)
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(bucket) != 0)) + 1
            starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            pairs = []
            # Buckets of one fingerprint that begin and end in the batch meet nothing.
            for i in np.flatnonzero((stops - starts > 1) | (starts == 0) | (stops == len(fps))):
                now, own = (which[starts[i]], bucket[starts[i]]), fps[starts[i]:stops[i]]
                if now != key:
                    key, held = now, np.zeros(0, np.uint64)
                for j in range(0, len(own), ROWS):
                    part = own[j:j + ROWS]
                    pairs += near(part, held)
                    a, b = np.nonzero(np.triu(np.bitwise_count(part[:, None] ^ part[None, :]) <= bits, 1))
                    pairs.append((part[a], part[b]))
                    held = np.concatenate([held, part])
            if pairs:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["fa", "fb"])

    return meet


def near_fingerprints(distinct: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(fa, fb), fa < fb: all distinct fingerprints (column ``fp``) that differ in at most ``bits`` bits."""
    keys = F.array(*(F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m - 2 ** 64 if m >> 63 else m)).alias("bucket"))
                     for i, m in enumerate(_masks(bits, blocks))))
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("k.which", "k.bucket", "fp").repartition(
        "which", "bucket").sortWithinPartitions("bucket", "which")  # the many values first: rarely a tie
    return dealt.mapInArrow(_meetings(bits), "fa long, fb long").distinct()


def _of_near_fingerprints(ws: Workspace, classes: DataFrame, bits: int, blocks: int) -> DataFrame:
    """(a, b): classes whose fingerprints differ in at most ``bits`` bits."""
    near = ws.write(near_fingerprints(classes.select("fp").distinct(), bits, blocks), "near")
    slim = classes.select("cid", "fp")
    apart = near.join(slim.select(F.col("cid").alias("a"), F.col("fp").alias("fa")), "fa").join(
        slim.select(F.col("cid").alias("b"), F.col("fp").alias("fb")), "fb").select("a", "b")
    # Different lines of one fingerprint, for instance the same words in another order.
    many = slim.join(slim.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "fp")
    same = many.select(F.col("cid").alias("a"), "fp").join(many.select(F.col("cid").alias("b"), "fp"), "fp").filter(
        "a < b").select("a", "b")
    return apart.union(same)


def fuzzy_lines(docs: DataFrame, similarity: float = SIMILARITY, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """row_id, doc_id, line_no, group_id and kept of every line of every text.

    Lines end at a newline; null text is one empty line. Lines of one group are
    connected by edit similarities of at least ``similarity`` between lines whose
    fingerprints differ in at most ``bits`` bits; the first of them by (doc_id,
    row_id, line_no) is kept. Lines without words separate paragraphs: they have
    no group and all stay. Equal lines are one class by a 128-bit key, so a line
    that fills a third of the corpus is one row before anything is joined. No row
    gives no lines; other columns are not looked at.
    """
    ws = Workspace(docs.sparkSession, "lines")
    return _marked(ws, docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                                   F.col("text").cast("binary").alias("text")), similarity, bits, blocks)


def _marked(ws: Workspace, rows: DataFrame, similarity: float, bits: int, blocks: int) -> DataFrame:
    lines = ws.write(rows.mapInArrow(_lines, LINES), "lines")
    classes = ws.write(lines.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("fp").alias("fp"), F.min(F.struct("doc_id", "row_id", "line_no")).alias("first")).withColumn(
        "cid", F.monotonically_increasing_id()), "classes")
    pairs = ws.write(_of_near_fingerprints(ws, classes, bits, blocks), "pairs")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    keys = ws.write(classes.join(wanted, "cid").select("cid", "k1", "k2"), "keys")
    hints = ws.spark.sparkContext.broadcast(_wanted_bits(keys))
    found = rows.select("text").mapInArrow(_texts(hints), "k1 long, k2 long, line string").join(keys, ["k1", "k2"]).groupBy(
        "cid").agg(F.min("line").alias("line"))
    texts = ws.write(found, "texts")
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("cid").alias("b"), F.col("line").alias("y")), "b")
    links = ws.write(near_texts(both, similarity), "links")
    ws.drop(pairs, keys, texts)
    roots = components(ws, links, "a", "b")
    grouped = classes.join(roots, classes["cid"] == roots["node"], "left").select(
        "k1", "k2", "first", F.coalesce("root", "cid").alias("group_id"))
    heads = grouped.groupBy("group_id").agg(F.min("first").alias("head"))
    named = grouped.join(heads, "group_id").select("k1", "k2", "group_id", "head")
    place = F.struct("doc_id", "row_id", "line_no")
    return lines.join(named, ["k1", "k2"], "left").select(
        "row_id", "doc_id", "line_no", "group_id",
        (F.col("group_id").isNull() | F.coalesce(place.eqNullSafe(F.col("head")), F.lit(False))).alias("kept"))


def _equal_start(a: str, b: str) -> int:
    """Characters that both begin with, by halving: slices are compared as memory."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _by_words(a: str, b: str, allowed: int) -> bool:
    """Whether some replacement of whole words, each followed by a space, takes at most ``allowed`` edits.

    Any replacement bounds the edit distance from above, so True is exact and False says nothing.
    """
    p, q = a.split(" "), b.split(" ")
    if len(p) == len(q) and sum([max(len(u), len(v)) for u, v in zip(p, q) if u != v]) <= allowed:
        return True
    i = j = spent = 0
    while i < len(p) and j < len(q):
        if p[i] == q[j]:
            i, j = i + 1, j + 1
            continue
        out, new = p[i:i + REACH], q[j:j + REACH]
        where = {w: k for k, w in reversed(list(enumerate(new)))}
        _, x, y = min(((k + where[w], k, where[w]) for k, w in enumerate(out) if w in where), default=(0, len(out), len(new)))
        spent += max(sum(map(len, out[:x])) + x, sum(map(len, new[:y])) + y)
        if spent > allowed:
            return False
        i, j = i + x, j + y
    return spent + sum(map(len, p[i:])) + len(p[i:]) + sum(map(len, q[j:])) + len(q[j:]) <= allowed


def edit_within(a: str, b: str, allowed: int) -> bool:
    """Whether the edit distance is at most ``allowed``; equal beginnings and ends are cut off first.

    Lines of near fingerprints mostly differ in a few words, which settles them without the table.
    """
    if abs(len(a) - len(b)) > allowed:
        return False
    start = _equal_start(a, b)
    a, b = a[start:], b[start:]
    end = _equal_start(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    if max(len(a), len(b)) <= allowed or _by_words(a, b, allowed):
        return True
    # One column of the distance table at a time, its steps of +1 and -1 as bits of two integers.
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1 if a else 0
    up, down, distance = full, 0, len(a)
    for i, c in enumerate(b):
        same = where.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = (down | ~(across | up)) & full, up & across
        distance += (more & last > 0) - (less & last > 0)
        if distance - (len(b) - i - 1) > allowed:
            return False
        more, less = (more << 1 | 1) & full, less << 1 & full
        kept = same | down
        up, down = (less | ~(kept | more)) & full, more & kept
    return (distance if a else len(b)) <= allowed


def near_texts(pairs: DataFrame, similarity: float, longest: int = LONG) -> DataFrame:
    """(a, b) of the pairs (a, b, x, y) of texts whose edit similarity is at least ``similarity``.

    Spark's own distance, which stops at the one allowed, settles lines of up to
    ``longest`` characters where they lie. It compares whole lines cell by cell, so
    longer ones go to Python, where equal ends are cut off first and a column of the
    table is a few operations.
    """
    length = F.greatest(F.length("x"), F.length("y"))
    allowed = F.floor(F.lit(1 - similarity) * length + F.lit(1e-9)).cast("int")
    near = F.when(length <= longest, F.call_function("levenshtein", F.col("x"), F.col("y"), allowed) >= 0)
    left = pairs.select("a", "b", near.alias("near"), allowed.alias("allowed"), *[
        F.when(length > longest, F.col(c)).alias(c) for c in ("x", "y")]).filter("near IS NULL OR near")

    def verify(batches):
        for batch in batches:
            near, allowed, x, y = (batch.column(c).to_pylist() for c in ("near", "allowed", "x", "y"))
            ok = [n or edit_within(p, q, d) for n, d, p, q in zip(near, allowed, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return left.mapInArrow(verify, "a long, b long")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and the text of its kept lines, for every row; a text that loses all lines is empty."""
    ws = Workspace(docs.sparkSession, "lines")
    # Numbered once and written: a second numbering of a shuffled input could differ.
    rows = ws.write(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                                F.col("text").cast("binary").alias("text")), "rows")
    marked = _marked(ws, rows, similarity, BITS, BLOCKS)
    lost = marked.filter("NOT kept").groupBy("row_id").agg(F.collect_set("line_no").alias("lost"))
    split = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    kept = F.filter(split, lambda _, i: ~F.array_contains(F.coalesce("lost", F.array().cast("array<bigint>")), i.cast("long")))
    return rows.join(lost, "row_id", "left").select("doc_id", F.array_join(kept, "\n").alias("text"))
