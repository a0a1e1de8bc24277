"""Hard negatives, language by code length and the Merkle manifest against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from likeness.llm import bond, merkle, ppm
from test_corpus import AWKWARD, table

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


# ------------------------------------------------------------- hard negatives

def plain_negatives(rows):
    valid = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if all(abs(float(np.float32(c))) <= (1 << 26) / 256 for c in v):
            valid[vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, x] = 1
    valid = list(valid)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in valid:
        if a[0] % 100:
            continue
        own = sorted((-dot(a[2], b[2]), b[0]) for b in valid if b is not a and b[1] == a[1])[:5]
        other = sorted((-dot(a[2], b[2]), b[0]) for b in valid if b[1] != a[1])
        for score, p in own:
            window = [(s, n) for s, n in other if 80 * -score <= 100 * -s <= 100 * -score][:5]
            out += [(a[0], p, k + 1, n, -score, -s) for k, (s, n) in enumerate(window)]
    return sorted(out)


def clustered(n, seed, labels=4, width=12):
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(6, width))
    near = centres[gen.integers(0, 6, n)] + 0.4 * gen.normal(size=(n, width))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    return [(i, [float(x) for x in np.float32(v)], int(gen.integers(0, labels))) for i, v in enumerate(near)]


AWKWARD_VECTORS = [
    (700, None, 1), (800, [0.5, None], 1), (900, [float("nan"), 0.1], 1), (1000, [float("inf"), 0.1], 1), (1100, [], 1),
    (None, [0.5] * 12, 1), (1200, [0.5] * 12, None), (1300, [0.0] * 12, 2), (1400, [0.3] * 5, 2), (1500, [0.25] * 20, 3),
    (1600, [0.5] * 12, 1), (1600, [0.5] * 12, 1), (1600, [0.4] * 12, 1), (1700, [1e30] * 12, 1), (1800, [1000.0] * 12, 1),
] + [(2000 + i, [0.5] * 12, i % 3) for i in range(60)]


@pytest.mark.parametrize("rows", [clustered(500, 1), clustered(300, 2) + AWKWARD_VECTORS, []], ids=["given", "awkward", "empty"])
def test_hard_negatives(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                               "vec_id long, embedding array<float>, label int, block int, twin string, score int").repartition(3)
    want = plain_negatives(rows)
    for settings in (bond.Settings(), bond.Settings(rows=40, anchors=2, step=2, settled=3)):
        got = sorted(map(tuple, bond.hard_negatives(df, settings).collect()))
        assert got == want
    assert len(want) > 100 or not rows


def test_scan_gives_rows_up():
    """With clear winners most rows leave the bitmap before their last column is read."""
    gen = np.random.default_rng(4)
    columns = gen.integers(-20, 20, (64, 4000))
    columns[:, :8] += 60
    block = bond.Block(np.arange(4000), np.zeros(4000, np.int64), np.zeros(4000, np.int64), columns)
    seen = []
    anchor = np.sort(gen.integers(1, 200, 64))

    def keep(rows, lowest, highest):
        seen.append(len(rows))
        return highest >= np.partition(lowest, len(lowest) - 5)[len(lowest) - 5]

    rows, scores = block.scan(anchor, np.ones(4000, bool), keep, 8, 16)
    exact = anchor @ columns
    assert (scores == exact[rows]).all() and set(np.argsort(-exact)[:5]) <= set(rows.tolist())
    assert seen[0] == 4000 and seen[-1] < 400


# ------------------------------------------------------------------- language

class PlainModel:
    """Escapes as frequent as the context has followers, with exclusion, by dictionaries."""

    def __init__(self, texts, order=3):
        self.order = order
        self.seen = defaultdict(Counter)
        for text in texts:
            data = b"\0" * order + text
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.seen[data[i - k:i]][data[i]] += 1

    def bits(self, text):
        data, out = b"\0" * self.order + text, 0.0
        for i in range(self.order, len(data)):
            excluded = set()
            for k in range(self.order, -1, -1):
                if data[i - k:i] not in self.seen:
                    continue
                followers = {s: n for s, n in self.seen[data[i - k:i]].items() if s not in excluded}
                total = sum(followers.values())
                if data[i] in followers:
                    out -= math.log2(followers[data[i]] / (total + len(followers)))
                    break
                if followers:
                    out -= math.log2(len(followers) / (total + len(followers)))
                excluded |= set(followers)
            else:
                out += math.log2(256 - len(excluded))
        return out


def test_code_lengths(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text")
    rows = [(r["lang"], r["text"].encode()[:600]) for r in docs.limit(60).collect()]
    rows += [("zz", b""), ("de", "größer ẞ".encode())]
    learned = spark.createDataFrame([(lang, text.decode(errors="replace")) for lang, text in rows], "lang string, text string")
    own = [(lang, text.decode(errors="replace").encode()) for lang, text in rows]
    model = ppm.fit(learned.repartition(5))
    assert model.languages == sorted({lang for lang, _ in own})
    plain = [PlainModel([t for lang, t in own if lang == language]) for language in model.languages]
    texts = [t for _, t in own[:12]] + [b"", b"q", "日本語 \x00\x01".encode(), bytes(range(128)), b"the the the " * 50]
    want = [[p.bits(t) for p in plain] for t in texts]
    assert np.allclose(model.lengths(texts), want, rtol=1e-10)
    whole = b"a long text of many parts, " * 30_000  # longer than what is scored at once
    parts = model.lengths([b"ab", whole, b"", b"cd"])
    assert np.allclose(parts[[0, 3]], [[p.bits(t) for p in plain] for t in (b"ab", b"cd")])
    one = model.bits(ppm._codes([whole])).sum(0)
    assert np.allclose(parts[1], one, rtol=1e-9) and not parts[2].any()


def test_probabilities_sum_to_one(spark):
    """What all bytes that may follow a context cost together: their probabilities are one, none left out."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang = 'de'").limit(20)
    for grams in (1 << 20, 600):  # with few grams deep contexts are not kept
        model = ppm.fit(docs, ppm.Settings(grams=grams))
        assert sum(len(codes) for codes, _ in model.trees[0].grams) <= 4 * grams
        for context in (b"der", b"zzz", b"\0\0\0", "ü".encode() + b"b"):
            codes = np.asarray([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint32)
            assert math.isclose(np.exp2(-model.bits(codes)[:, 0]).sum(), 1.0, rel_tol=1e-9)


def test_language_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op12_ppm_language"](spark, FOLDER).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = 0
    for r in rows:
        own = got[r["doc_id"]]
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= own["score"] <= 1
        right += own["held_out"] and own["lang_pred"] == r["lang"]
    assert right >= 0.97 * sum(r["held_out"] for r in got.values())


def test_labels_are_no_inputs(spark):
    """Other languages of held-out rows change nothing; nor do source, order and partitions."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = ppm.remainder(3) == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string")).repartition(7)
    assert sorted(map(tuple, ppm.predicted(docs).collect())) == sorted(map(tuple, ppm.predicted(other).collect()))


def test_language_of_awkward_rows(spark):
    df = table(spark, AWKWARD)
    got = ppm.predicted(df).collect()  # no language at all
    assert len(got) == len(AWKWARD) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    got = ppm.predicted(df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a"))).collect()
    assert len(got) == len(AWKWARD)
    want = Counter((d, t is None or not any(ch.isalpha() for ch in t)) for d, t in AWKWARD)
    assert Counter((r["doc_id"], r["lang_pred"] == "und") for r in got) == want
    assert ppm.predicted(table(spark, [])).collect() == []


# ------------------------------------------------------------------- manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, s, lang, n, t: h(*map(field, (d, s, lang, n, t)))
    by = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        now = leaf(*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])
        by[r[1]].append(((r[0] is not None, r[0]), leaf(*r), now))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[1] for x in sorted(by[s])]) for s in order]
    crown = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, (s, tree) in enumerate(zip(order, trees)):
        for i, (key, own, now) in enumerate(sorted(by[s])):
            proof, folded = [], now
            for levels, place in ((tree, i), (crown, k)):
                for level in levels[:-1]:
                    first = place // 3 * 3
                    run = level[first:first + 3]
                    proof += run[:place - first] + run[place - first + 1:]
                    folded = h(*run[:place - first], folded, *run[place - first + 1:])
                    place //= 3
            out.append((key[1], own, tree[-1][0], crown[-1][0], h(*proof), folded, folded == crown[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key string, pos int, node string, total long"


def manifest_rows(kind, spark):
    if kind == "empty":
        return []
    if kind == "lone":
        return [(5, "s", None, 1, "a\nb")]
    if kind == "given":
        return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])
                for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = [(d, [None, "", "-", "a", "é", "a"][k % 6], "l" if k % 5 else None, k if k % 4 else None, t) for k, (d, t) in enumerate(AWKWARD)]
    rows += [(d, "hot", "x", 1, f"line {d}\nmore") for d in range(1000, 1000 + 3 * 81 + 1)] + [(7, "hot", "x", 1, "same\n")] * 3
    return rows + [(d, f"source {d}", None, None, "\n") for d in range(40)]


@pytest.mark.parametrize("kind", ["given", "awkward", "lone", "empty"])
def test_manifest(spark, kind):
    rows = manifest_rows(kind, spark)
    df = spark.createDataFrame([(d, t, s, lang, n, "k", 1, "n", 2) for d, s, lang, n, t in rows], SCHEMA).repartition(5)
    want = plain_manifest(rows) if rows else []
    for settings in (merkle.Settings(), merkle.Settings(every=1)):
        assert sorted(map(tuple, merkle.manifest(df, settings).collect()), key=str) == want
    if kind == "awkward":
        assert 0 < sum(not r[-1] for r in want) < len(want)


def test_only_some_levels_are_written(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ws = merkle.Workspace(spark, "test")
    rows = merkle.positions(ws, merkle.leaves(docs).drop("source"), [F.col("doc_id"), F.col("node"), F.col("changed")])
    levels, roots = merkle.grown(ws, rows, ["doc_id"], merkle.Settings())
    assert len(levels) == 2 and roots.count() == 20  # 50 leaves a source: written as two blocks, then their tops
    assert levels[0].selectExpr("max(size(items))").first()[0] == 27 and levels[1].count() == 20
