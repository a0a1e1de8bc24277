"""Language identification by partial matching: exact code lengths of whole texts under byte context trees.

Each language has a tree of contexts of up to three bytes with the counts of the
bytes that follow. A byte is coded in the longest context that the tree has; if
it never followed there, an escape is coded (as often as the context has
different followers) and the next shorter context is tried with those followers
excluded, down to all bytes alike. Statistics come from all training rows and
are frozen before the first text is scored.

Counting and choosing contexts are Spark aggregations. The tree that a worker
holds is bounded by ``Settings.grams``, whatever the corpus: deep contexts that
were seen too seldom are not kept, which makes the order vary by context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.batches import by_bytes
from likeness.llm.stores import Workspace

#: Bytes of the longest context. With the coded byte a gram fills 32 bits.
ORDER = 3
#: The prediction for a text that is null or has no letter, and where nothing was learned.
UNKNOWN = "und"
#: Bytes of text that are counted, and that are scored, at once.
COUNTED, SCORED = 4 << 20, 1 << 18
_SLOT = np.uint32(0x9E3779B1)  # multiplier of the hash table


@dataclass(frozen=True)
class Settings:
    """``grams`` bounds the grams of each context length over all languages together."""

    grams: int = 1 << 20
    folds: int = 3
    held_out: int = 1


def _codes(texts: list[bytes]) -> np.ndarray:
    """One number for each byte: its three predecessors (zero before a text) and itself, latest lowest."""
    data = np.frombuffer(b"\0\0\0" + b"\0\0\0".join(texts), np.uint8).astype(np.uint32)
    codes = data[3:] | data[2:-1] << 8 | data[1:-2] << 16 | data[:-3] << 24
    sizes = np.asarray([len(t) for t in texts])
    starts = np.cumsum(sizes + 3) - sizes - 3
    inside = np.ones(len(codes) + 3, bool)
    for pad in range(3):
        inside[starts + sizes + pad] = False
    return codes[inside[:len(codes)]]


# ---------------------------------------------------------------- statistics

def _counted(batches) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", COUNTED):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            grams, n = np.unique(_codes(own), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"])


def remainder(folds: int) -> Column:
    """crc32 of doc_id as text; a null doc_id counts as no text, which is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text): how often each four bytes stand together."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _cutoffs(contexts: DataFrame, grams: int) -> list[tuple[str, int, int]]:
    """(lang, depth, power): contexts are kept that were seen 2 ** (power - 1) times or more.

    The power is the smallest with at most ``grams`` rows of the language and
    depth, but not below that of the shorter contexts: the shorter ones of a kept
    context are kept. Read from at most 64 sums for each language and depth.
    """
    sums = contexts.groupBy("lang", "depth", "power").agg(F.sum("followers").alias("grams")).collect()
    out = []
    for lang in {r["lang"] for r in sums}:
        power = 0
        for depth in range(ORDER + 1):
            above = 0
            for r in sorted((r for r in sums if (r["lang"], r["depth"]) == (lang, depth)), key=lambda r: -r["power"]):
                above += r["grams"]
                if above > grams:
                    power = max(power, r["power"] + 1)
                    break
            out.append((lang, depth, power))
    return out


def kept_grams(ws: Workspace, table: DataFrame, grams: int) -> pa.Table:
    """(lang, depth, gram, n) of all contexts that were seen often enough; ``table`` is (lang, gram, n)."""
    shorter = F.array(*[F.struct(F.lit(d).alias("depth"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("gram"))
                        for d in range(ORDER + 1)])
    own = ws.write(table.select("lang", F.explode(shorter).alias("g"), "n").groupBy("lang", "g.depth", "g.gram").agg(
        F.sum("n").alias("n")).withColumn("context", F.shiftright("gram", 8)), "grams")
    contexts = ws.write(own.groupBy("lang", "depth", "context").agg(
        F.length(F.bin(F.sum("n"))).alias("power"), F.count("*").alias("followers")), "contexts")
    least = ws.spark.createDataFrame(_cutoffs(contexts, grams), "lang string, depth int, least int")
    frequent = contexts.join(least, ["lang", "depth"]).filter("power >= least").select("lang", "depth", "context")
    found = own.join(frequent, ["lang", "depth", "context"], "left_semi").select("lang", "depth", "gram", "n").toArrow()
    ws.drop(own, contexts)
    return found


class Tree:
    """The contexts of one language: sorted grams with counts, and for each context what its followers sum to."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.nodes = [], []
        for order, (codes, n) in enumerate(grams):
            at = np.argsort(codes)
            codes, n = codes[at], n[at]
            self.grams.append((codes, n))
            contexts, first = np.unique(codes >> 8, return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            followers = np.diff(np.append(first, len(codes)))
            self.nodes.append((contexts, total, followers))
        # What the followers of a context count in the next shorter one: excluded there after an escape.
        self.excluded = [None]
        for order in range(1, len(grams)):
            contexts = self.nodes[order][0]
            codes = self.grams[order][0]
            shorter = self._count(order - 1, codes & np.int64((1 << 8 * order) - 1))
            first = np.searchsorted(codes >> 8, contexts)
            self.excluded.append(np.add.reduceat(shorter, first) if len(codes) else shorter)

    def _count(self, order: int, codes: np.ndarray) -> np.ndarray:
        known, n = self.grams[order]
        if not len(known):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, n[at], 0)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram of four."""
        codes = codes.astype(np.int64)
        out = np.zeros(len(codes))
        left = np.arange(len(codes))  # not coded yet
        gone_total = np.zeros(len(codes), np.int64)
        gone_followers = np.zeros(len(codes), np.int64)
        for order in reversed(range(len(self.grams))):
            own = codes[left] & np.int64((1 << 8 * (order + 1)) - 1)
            contexts, total, followers = self.nodes[order]
            if not len(contexts):
                continue
            at = np.minimum(np.searchsorted(contexts, own >> 8), len(contexts) - 1)
            there = contexts[at] == own >> 8
            free, different = total[at] - gone_total[left], followers[at] - gone_followers[left]
            n = self._count(order, own)
            coded = there & (n > 0)
            out[left[coded]] += np.log2((free + different)[coded] / n[coded])
            escaped = there & (n == 0)
            costly = escaped & (different > 0)
            out[left[costly]] += np.log2((free + different)[costly] / different[costly])
            if order:
                gone_total[left[escaped]] = self.excluded[order][at[escaped]]
                gone_followers[left[escaped]] = followers[at[escaped]]
            else:
                gone_followers[left[escaped]] = followers[at[escaped]]
            left = left[~coded]
        out[left] += np.log2(256 - gone_followers[left])
        return out


class Model:
    """Trees of all languages, and the code lengths of the grams they hold in one hash table."""

    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees
        deepest = [t.grams[-1][0] for t in trees]
        self._grams = np.unique(np.concatenate(deepest)).astype(np.uint32) if deepest else np.zeros(0, np.uint32)
        self._bits = self._exact(self._grams)
        self._shift = np.uint32(32 - max(4, int(len(self._grams) * 4).bit_length()))
        self._rows = np.full(1 << int(32 - self._shift), -1, np.int32)
        place, left = self._slot(self._grams), np.arange(len(self._grams))
        while len(left):
            free = self._rows[place[left]] < 0
            self._rows[place[left[free]]] = left[free]
            left = left[self._rows[place[left]] != left]
            place[left] = (place[left] + 1) & (len(self._rows) - 1)

    def _exact(self, grams: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(grams) for t in self.trees], 1) if self.trees else np.zeros((len(grams), 0))

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _SLOT) >> self._shift).astype(np.int64)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths by gram (row) and language (column)."""
        if not len(self._grams):
            return self._exact(codes)
        place = self._slot(codes)
        row = self._rows[place]
        other = np.flatnonzero((row >= 0) & (self._grams[row] != codes))
        while len(other):
            place[other] = (place[other] + 1) & (len(self._rows) - 1)
            row[other] = self._rows[place[other]]
            found = row[other]
            other = other[(found >= 0) & (self._grams[found] != codes[other])]
        out = self._bits[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            grams, where = np.unique(codes[new], return_inverse=True)
            out[new] = self._exact(grams)[where]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every whole text (row) in every language (column)."""
        sums = np.zeros((len(texts), len(self.languages)))
        codes = _codes(texts) if texts else np.zeros(0, np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        begins = ends - [len(t) for t in texts]
        for start in range(0, len(codes), SCORED):  # a long text goes through in parts
            stop = min(start + SCORED, len(codes))
            own = np.flatnonzero((ends > start) & (begins < stop) & (ends > begins))
            sums[own] += np.add.reduceat(self.bits(codes[start:stop]), np.maximum(begins[own], start) - start)
        return sums


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """The model from all rows of ``docs`` that have a language; null text is empty.

    The driver holds the kept grams alone, at most ``settings.grams`` for each of
    four context lengths and all languages together.
    """
    ws = Workspace(docs.sparkSession, "ppm")
    rows = docs.filter("lang IS NOT NULL")
    table = ws.write(counts(rows), "counts")
    languages = [r["lang"] for r in rows.select(F.col("lang").cast("string").alias("lang")).distinct().collect()]
    languages.sort(key=lambda lang: lang.encode())
    found = kept_grams(ws, table, settings.grams // max(1, len(languages)))
    ws.drop(table)
    lang = pc.dictionary_encode(found.column("lang").combine_chunks())
    names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    depth, gram, n = (found.column(c).to_numpy() for c in ("depth", "gram", "n"))
    by = {}
    for i, name in enumerate(names):
        for order in range(ORDER + 1):
            own = (which == i) & (depth == order)
            by[name, order] = gram[own].astype(np.int64), n[own].astype(np.int64)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Model(languages, [Tree([by.get((lang, order), none) for order in range(ORDER + 1)]) for lang in languages])


# ------------------------------------------------------------------- scoring

def _identified(model):
    def identify(batches):
        own = model.value
        for batch in by_bytes(batches, "text", SCORED):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            bits = own.lengths(texts)
            if own.languages:
                best = bits.argmin(1)  # of equal lengths the first language
                score = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                found = [own.languages[i] for i in best]
            else:
                score, found = np.zeros(len(texts)), [UNKNOWN] * len(texts)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array([lang if is_text else UNKNOWN for lang, is_text in zip(found, letters)], pa.string()),
                 pa.array(np.where(letters, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return identify


def identify(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; score is the posterior of equally likely languages.

    Null text, a text without a letter and a model without languages give
    ``und`` with score 0. Equal code lengths go to the language first in byte
    order. Repeated and null doc_ids are rows of their own; a null doc_id is not
    held out; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (remainder(settings.folds) == settings.held_out).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        F.col("text").cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(model)  # bounded by Settings.grams
    return rows.mapInArrow(_identified(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def predicted(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row from its text alone."""
    learned = docs.filter(remainder(settings.folds) != settings.held_out).select("lang", "text")
    return identify(docs, fit(learned, settings), settings)
