"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else, labelled or not,
is unlabelled text in which a share ``prior`` is toxic. The risk of a linear
classifier over hashed words and word beginnings is

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

where R_p and R_u are mean losses over positives and unlabelled texts; where the
second term would fall below zero the step goes against it instead, so the
classifier can't win by remembering the positives. A few classifiers are trained
in parallel tasks, each on its own bounded draw, and their scores are averaged.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.batches import kept, release

WORD = re.compile(rb"[a-z\x80-\xff']+")
#: Letters (bytes) in the word beginnings that count as features.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Distinct words whose weights a worker remembers while it scores.
REMEMBERED = 150_000


@dataclass(frozen=True)
class Settings:
    """``positives`` and ``unlabelled`` bound the rows each member learns from.

    The draws are hashes of doc_id, so they don't depend on partitioning; scores
    are computed for every row and whole text.
    """

    members: int = 4
    positives: int = 3000
    unlabelled: int = 6000
    bits: int = 20
    steps: int = 150
    rate: float = 0.05
    decay: float = 3e-4
    least_errors: float = 4.0
    folds: int = 5


def features(word: bytes, bits: int) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings."""
    found = [zlib.crc32(b"=" + word)]
    found += [zlib.crc32(word[:n]) for n in BEGINNINGS if len(word) >= n]
    return [h & (1 << bits) - 1 for h in found]


class WordTable(dict):
    """Word to whatever ``make`` gives for it, remembered up to a bound."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, word):
        value = self._make(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def text_features(text: bytes | None, table: WordTable) -> np.ndarray:
    """Feature ids of the distinct words of one text."""
    words = sorted(set(WORD.findall(text.lower()))) if text else []
    return np.asarray([f for w in words for f in table[w]], "<i4")


def _telling(rows: list[np.ndarray], split: int, bits: int, least: float):
    """Features whose share of documents differs between positives and unlabelled texts, with log ratios.

    ``least`` is the number of standard errors that the difference has to reach;
    it keeps the many words that one draw holds by chance out of the classifier.
    Counts are made row by row, so the ids of all rows are never copied together.
    """
    n = len(rows)
    p, u = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for i, ids in enumerate(rows):
        (p if i < split else u)[np.unique(ids)] += 1
    used = np.flatnonzero(p + u)
    p, u = p[used], u[used]
    a, b = (p + 0.5) / (split + 1), (u + 0.5) / (n - split + 1)
    pooled = (p + u + 1) / (n + 2)
    z = (a - b) / np.sqrt(pooled * (1 - pooled) * (1 / split + 1 / (n - split)))
    kept = np.abs(z) >= least
    return used[kept], np.log(a / b)[kept]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings):
    """(features, weights, bias) that minimise the non-negative risk, by AdaGrad steps."""
    rows = [*positive, *unlabelled]
    n, split = len(rows), len(positive)
    b = float(np.log(prior / (1 - prior)))
    if not split or n == split:
        return np.zeros(0, np.int64), np.zeros(0), b
    used, ratio = _telling(rows, split, s.bits, s.least_errors)
    if not len(used):
        return used, ratio, b
    place = np.full(1 << s.bits, -1, np.int32)
    place[used] = np.arange(len(used))
    # Only telling features stay, a small part of each row.
    told = [at[at >= 0] for at in (place[ids] for ids in rows)]
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in told])
    at = np.concatenate(told)
    value = ratio[at]
    w = np.zeros(len(used))
    sum_w, sum_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(s.steps):
        score = np.bincount(owner, w[at] * value, n) + b
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        loss = np.logaddexp(0, score)  # of the negative label
        grad = np.zeros(n)
        if loss[split:].mean() >= prior * loss[:split].mean():
            grad[:split] = -prior / split  # prior * ((p - 1) - p): both risks of a positive
            grad[split:] = p[split:] / (n - split)
        else:
            grad[:split] = prior * p[:split] / split
            grad[split:] = -p[split:] / (n - split)
        gw = np.bincount(at, grad[owner] * value, len(used)) + s.decay * w
        gb = grad.sum()
        sum_w += gw * gw
        sum_b += gb * gb
        w -= s.rate * gw / np.sqrt(sum_w)
        b -= s.rate * gb / np.sqrt(sum_b)
    return used, w * ratio, b


# --- on Spark ---------------------------------------------------------------------

def held_out(doc_id, folds: int):
    """Rows whose labels are never learned from; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def _draw(ids: DataFrame, member: int, n: int) -> DataFrame:
    """The ``n`` ids with the least hashes: kept per partition first, never sorted as a whole."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(member)), "doc_id").limit(n)


def _featurise(bits: int):
    def fold(batches):
        table = kept(("features", bits), lambda: WordTable(lambda w: features(w, bits)))
        for batch in batches:
            found = [text_features(t, table).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("member", "toxic", "doc_id")), pa.array(found, pa.binary())],
                ["member", "toxic", "doc_id", "features"])
        release()

    return fold


@dataclass(frozen=True)
class Model:
    """Mean of the members: feature weights that aren't zero, and the bias."""

    bits: int
    weights: dict[int, float]
    bias: float


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Train the members on their draws, one task each; only their weights come to the driver.

    Labels are read for rows outside the held-out fold only: those with toxic = 1
    are positives, and their share among the labelled rows is the class prior.
    Unlabelled texts are drawn from all documents outside the fold. Repeated
    doc_ids count once. With no positives or nothing else the model has no weights.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out("doc_id", s.folds)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    prior = min(max(share or 0.0, 1e-4), 1 - 1e-4)  # as the labels have it; a risk needs both classes
    free = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(
        "doc_id IS NOT NULL").filter(~held_out("doc_id", s.folds)).distinct()
    present = known.filter("toxic = 1").select("doc_id").join(free, "doc_id", "left_semi")
    drawn = None
    for member in range(s.members):
        for toxic, ids, n in ((1, present, s.positives), (0, free, s.unlabelled)):
            part = _draw(ids, member, n).select(
                F.lit(member).alias("member"), F.lit(toxic).alias("toxic"), "doc_id")
            drawn = part if drawn is None else drawn.union(part)
    # At most members * (positives + unlabelled) rows of two numbers, by the settings.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(
        F.broadcast(drawn.distinct()), "doc_id")
    rows = texts.mapInArrow(_featurise(s.bits), "member int, toxic int, doc_id long, features binary").groupBy(
        "member", "toxic", "doc_id").agg(F.min("features").alias("features"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.doc_id.to_numpy().argsort(kind="stable")
        toxic = pdf.toxic.to_numpy()
        found = [[np.frombuffer(pdf.features.iat[i], "<i4") for i in order if toxic[i] == y] for y in (1, 0)]
        used, w, b = train(*found, prior, s)
        del found
        release()
        return pd.DataFrame({"feature": [-1, *used.tolist()], "weight": [b, *w.tolist()]})

    mean = rows.groupBy("member").applyInPandas(learn, "feature long, weight double").groupBy("feature").agg(
        F.sum("weight").alias("weight")).filter("weight <> 0").collect()  # at most 2 ** bits rows
    weights = {r["feature"]: r["weight"] / s.members for r in mean}
    return Model(s.bits, weights, weights.pop(-1, float(np.log(prior / (1 - prior)))))


def _weights(model_id: str, model: Model) -> WordTable:
    """The worker's one table of word weights, that of the model it scores with now."""
    weight = model.weights.get
    return kept(("weights", model_id), lambda: WordTable(lambda w: math.fsum(weight(f, 0.0) for f in features(w, model.bits))))


def scorer(spark, model: Model):
    """A column function: the probability that a text (as bytes) is toxic."""
    shared = spark.sparkContext.broadcast(model)  # bounded by 2 ** bits weights
    model_id = uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        look = _weights(model_id, model).__getitem__

        def one(text):
            words = set(WORD.findall(text.lower())) if text else ()
            z = model.bias + math.fsum(map(look, words))
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return pd.Series([one(t) for t in texts], dtype="float64")

    return lambda text: score(F.col(text).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row and whole text.

    Only the text goes into a score; null and empty texts get the one of the bias.
    Repeated rows get equal scores; an empty table gives no rows.
    """
    score = scorer(docs.sparkSession, fit(docs, labels, s))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", s.folds).alias("held_out"),
                       score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
