"""Corpus operators against plain versions, on given and on awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
import brute
import corpus_pipeline
from likeness.llm import (
    block_naming, chat, fuzzy_lines, lengths, nn_descent, packing, pieces, simhash_trie, tokens, toxicity, wavelet)
from likeness.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "One two three four"), (5, "ONE TWO THREE FOUR"), (6, "one two three four"),
    (6, "one two three four"), (7, "É é À " * 40), (8, "x" * 9000), (9, "x" * 9000), (10, "ab " * 30000), (None, "one two three four"),
    (None, None), (11, "<|endoftext|> [INST] </s> ▁▁  　 \x1c end"), (12, "𝔘𝔫𝔦 🙂🙂 naïvé \x00 ﬁ"), (13, "a  b   c \n"),
    (12, "another text of the same id"), (14, "one\nOne  \none"),
]
rnd = random.Random(5)
WORDS = ["red", "blue", "green", "house", "tree", "sky", "water", "stone", "Bird", "road", "night", "river"]
for k in range(20, 60):
    words = [rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(rnd.choice([3, 40, 400]))]
    AWKWARD.append((k, " ".join(words)))
    words[rnd.randrange(len(words))] = "changed"
    AWKWARD.append((100 + k, "\n".join([" ".join(words), "a shared line of some length"])))


def table(spark, rows):
    """Documents with columns whose names operators use themselves."""
    schema = f"{SCHEMA}, row_id string, idx int, fp string, name string, part int, `rank` int, h string, key string"
    return spark.createDataFrame(
        [(d, t, None, None, None, "r", 1, "f", "n", 3, 4, "h", "k") for d, t in rows], schema).repartition(3)


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.fixture(params=["given", "awkward", "empty"])
def case(request, spark):
    rows = {"given": documents(spark), "awkward": AWKWARD, "empty": []}[request.param]
    return rows, table(spark, rows)


def test_exact(case):
    rows, df = case
    for size in (4096, 7):
        got = block_naming.exact_groups(df, size)
        same(got.select("doc_id", "keep_id", "group_size", "text_sha256").collect(), brute.exact(rows))
        assert got.filter("kept").count() == len({brute.fold(t) for _, t in rows})
        assert got.select("level", "name").distinct().count() == len({brute.fold(t) for _, t in rows})


def test_near(case):
    rows, df = case
    for unit, stride in ((4096, 4), (3, 4), (2, 1)):
        got = simhash_trie.near_groups(df, unit=unit, stride=stride).select("doc_id", "fingerprint", "component_id")
        same(got.collect(), brute.near_components(rows))


def test_trie_walk_is_whole():
    gen = np.random.default_rng(3)
    base = gen.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << gen.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    i, j = simhash_trie._walk(fps, fps, 0, 0, 2, True)
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(a.tolist(), b.tolist())) and len(i) == len(a) > 100


def test_word_ids(case):
    rows, _ = case
    encoder = tokens.WordEncoder(tokens.WORD_BPE)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.packed((t or "").encode() for _, t in rows)]
    assert got == (brute.token_ids([t for _, t in rows], end=False) if rows else [])


def test_wavelet_documents(spark, case):
    rows, df = case
    got = wavelet.encoded_documents(df, shard_tokens=500).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32")
    ids = brute.token_ids([t for _, t in rows]) if rows else []
    same([(r[0], r[2], r[3]) for r in got.collect()], [(d, len(x), brute.crc(x)) for (d, _), x in zip(rows, ids)])
    at, last = 0, -1
    for r in got.collect():
        assert r["start"] == at and (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        at, last = at + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 60, n).astype("<u4") * 821
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (m.decode() == ids).all()
    for i in range(0, n, 37):
        assert m.access(i) == ids[i]
    for token in (0, 821, 821 * 59, 3, 1 << 20):
        where = np.flatnonzero(ids == token)
        assert m.positions(token)[:200] == where.tolist()[:200] and m.select(token, len(where)) == -1
        assert m.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()


def test_wavelet_occurrences(spark):
    df = spark.createDataFrame([(2, "b a a"), (1, "a b")], "doc_id long, text string")
    path = scratch_path(spark, "test")
    wavelet.write_shards(df.coalesce(1), path)
    a, b = (x[0] for x in brute.token_ids(["a", "b"]))
    ids = [a, b, 1, b, a, a, 1]
    found = {tuple(r) for r in wavelet.occurrences(spark, path, a).select("part", "position").collect()}
    base = {r["part"]: r["start"] for r in wavelet.read_documents(spark, path).groupBy("part").agg({"start": "min"})
            .withColumnRenamed("min(start)", "start").collect()}
    assert sorted(base[p] + i for p, i in found) == [i for i, x in enumerate(ids) if x == a]


def test_pieces(spark, case):
    rows, df = case
    got = pieces.encoded(df).collect()
    want = brute.pieces([t for _, t in rows])
    import hashlib
    same([(r["doc_id"], len(r["ids"]) // 4, hashlib.sha256(r["ids"]).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest())
          for r in got], [(d, *w) for (d, _), w in zip(rows, want)])


def test_piece_spans_are_the_librarys():
    encoder = pieces.piece_encoder(pieces.PIECE_BPE)
    for _, text in AWKWARD:
        data = (text or "").encode()
        (ids, spans), = encoder.encode([data])
        proto = encoder.library.encode(text or "", out_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces]
        assert [tuple(s) for s in spans.tolist()] == [(p.begin, p.end) for p in proto.pieces]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    base = pb.ModelProto()
    with open(pieces.PIECE_BPE, "rb") as f:
        base.ParseFromString(f.read())
    for tidy in (False, True):
        base.normalizer_spec.CopyFrom(spec.normalizer_spec)
        base.normalizer_spec.add_dummy_prefix = True
        base.normalizer_spec.remove_extra_whitespaces = tidy
        base.normalizer_spec.escape_whitespaces = True
        encoder = pieces.PieceEncoder(proto=base.SerializeToString())
        for text in ("", " ", "  Ｆｕｌｌ  width ", "ﬁne ½ ①", "á ¨ x　y", "ＡＢＣ İ ß", "tab\there ｶﾞ"):
            proto = encoder.library.encode(text, out_type="proto")
            (ids, spans), = encoder.encode([text.encode()])
            assert ids.tolist() == [p.id for p in proto.pieces], text
            assert [tuple(s) for s in spans.tolist()] == [(p.begin, p.end) for p in proto.pieces], text


def test_unknown_pieces():
    """A model without byte pieces: unknown pieces are as wide as what they stand for."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    base = pb.ModelProto()
    with open(pieces.PIECE_BPE, "rb") as f:
        base.ParseFromString(f.read())
    base.trainer_spec.byte_fallback = False
    for p in base.pieces:
        if p.type == pb.ModelProto.SentencePiece.BYTE:
            p.type = pb.ModelProto.SentencePiece.UNUSED
    encoder = pieces.PieceEncoder(proto=base.SerializeToString())
    seen = 0
    for text in ("hello 𐍈 world", "𐍈𐍉𐍈 world", "a𐍈b𐍉 c 𐍈", "𐍈", "plain words", ""):
        proto = encoder.library.encode(text, out_type="proto")
        (ids, spans), = encoder.encode([text.encode()])
        assert ids.tolist() == [p.id for p in proto.pieces], text
        # The library counts characters.
        want = [(len(text[:p.begin].encode()), len(text[:p.end].encode())) for p in proto.pieces]
        bytes_of = [(p.begin, p.end) for p in proto.pieces]
        assert [tuple(s) for s in spans.tolist()] in (want, bytes_of), (text, spans.tolist(), want)
        seen += int((ids == encoder.library.unk_id()).sum())
    assert seen >= 5


def test_length_report(spark, case):
    rows, df = case
    counts = lengths.token_counts(df)
    n = [len(x) for x in brute.token_ids([t for _, t in rows], end=False)] if rows else []
    got = lengths.length_report(counts)
    want = []
    for k in sorted(set(n)):
        up, down = [x for x in n if x >= k], [x for x in n if x <= k]
        want.append((k, n.count(k), len(up), sum(up), len(down), sum(down), sum(min(x, k) for x in n), len(down) / len(n)))
    same(got.collect(), want)
    limits = [0, 1, 5, 100, 1 << 40]
    same(lengths.at_limits(got, limits).collect(),
         [(c, sum(x < c for x in n), sum(x >= c for x in n), sum(min(x, c) for x in n)) for c in limits] if n else [])


def check_packing(rows, got, capacity):
    ids = {}
    for (d, _), x in zip(rows, brute.token_ids([t for _, t in rows]) if rows else []):
        ids.setdefault((d, len(x)), []).append(x)
    found, packs = {}, {}
    for r in got:
        found.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: len(v) for k, v in ids.items()}.keys() == found.keys()
    for key, xs in ids.items():
        same(found[key], [(i, len(x[i:i + capacity]), brute.crc(x[i:i + capacity])) for x in xs for i in range(0, len(x), capacity)])
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(n for p in packs.values() for _, n in p) / (capacity * len(packs)) if packs else 1


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(case, capacity):
    rows, df = case
    full = check_packing(rows, packing.packed(df, capacity=capacity).collect(), capacity)
    assert full > 0.7  # few pieces; real histograms are below


def test_histogram_packing_is_small_and_dense():
    gen = np.random.default_rng(1)
    for scale in (1, 1000):
        hist = {int(n): int(c) * scale for n, c in zip(*np.unique(gen.integers(1, 2049, 50_000), return_counts=True))}
        patterns = packing.shortest_pack_first(hist, 2048)
        held = {}
        for p, c in patterns:
            assert sum(p) <= 2048
            for n in p:
                held[n] = held.get(n, 0) + c
        assert held == hist and len(patterns) <= 2 * 2048 + 1
        assert sum(sum(p) * c for p, c in patterns) / (2048 * sum(c for _, c in patterns)) > 0.97


def test_chat(spark):
    rows = [(1, 0, "user", "hi \\ <s> [x"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"),
            (2, 5, "tool\nx<", "  "), (2, None, "assistant", ""), (2, 6, None, None), (None, 0, "assistant", "a\\\\[\n"),
            (3, 0, "assistant", chat.MARKER), (3, 1, "system", "\n\n"), (3, 2, "assistant", " </s>"), (4, 1, "user", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "o") for r in rows], "conv_id long, turn int, role string, text string, loss string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(df).collect()}
    assert got == brute.chats(rows)
    assert chat.read_back(df.limit(0)).count() == 0
    whole = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    got = {r["conv_id"]: tuple(r)[1:5] for r in QUERIES["op4_chat_rendering"](spark, FOLDER).collect()}
    assert got == brute.chats([*whole, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_chat_template_that_rewrites_history():
    def last_only(turns):  # shows only the last turn's text in full
        return "".join(f"<{r}>{t if i == len(turns) - 1 else '..'}" for i, (r, t) in enumerate(turns))

    turns = [("user", "a question"), ("assistant", "an answer"), ("user", "more")]
    assert chat.locate(last_only, turns).rewritten_at == 1
    found = chat.locate(chat.render, turns)
    assert found.rewritten_at is None and [found.output[a:b] for a, b in found.texts] == [t for _, t in turns]
    assert [chat.parse(found.output[a:b]) for a, b in found.turns] == turns
    assert all(c not in chat.escape("".join(chat.CONTROL)) for c in chat.CONTROL)


def vector_rows():
    gen = np.random.default_rng(2)
    rows = [(i, gen.standard_normal(8).tolist(), i % 2) for i in range(60)]
    for i in range(60, 200):
        base = np.asarray(rows[i % 7][1])
        rows.append((i, (base + gen.standard_normal(8) * 0.02 * (i % 4)).tolist(), rows[i % 7][2] if i % 9 else None))
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 8, 0), (303, [float("nan")] + [1.0] * 7, 0), (304, [None] * 8, 0),
             (305, [float("inf")] * 8, 0), (306, [1e200] * 8, 0), (307, [1e-200] * 8, 0), (307, [1e-200] * 8, 0), (None, [1.0] * 8, 0),
             (308, [1.0] * 4, 0), (309, [2.0] * 4, 0)]
    return rows


SMALL = nn_descent.Settings(neighbours=4, trees=3, leaf=16, block=16)


def test_vectors(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n string")
    got = nn_descent.near_vectors(df, SMALL).collect()
    want = brute.vectors([(v, None if e is None else [x if x is None or not np.isfinite(x) or not x else x / max(map(abs, e)) for x in e], y)
                          for v, e, y in rows])
    same(got, want)
    assert nn_descent.near_vectors(df.limit(0), SMALL).count() == 0


def test_vectors_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    gen = np.random.default_rng(4)
    for i in range(300):  # a large group that saturates lists
        rows.append((10_000 + i, (np.asarray(rows[0][1]) + gen.standard_normal(64) * 0.01).tolist(), rows[0][2]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: tuple(r) for r in nn_descent.near_vectors(df).collect()}
    want = brute.vectors(rows)
    true = sum(w[1] for w in want)
    assert sum(min(got[w[0]][1], w[1]) for w in want) >= 0.9 * true > 0
    assert all(got[w[0]][1] <= w[1] for w in want)


def test_vectors_bridge_of_full_lists(spark):
    """One link between two dense groups, which ranks behind those within each group."""
    gen = np.random.default_rng(3)
    e = np.eye(12)
    a = np.radians([0, 16])  # the centres are too far apart to link, the nodes between them are not
    ends = [np.cos(x) * e[0] + np.sin(x) * e[1] for x in a]
    rows = [(100 * g + i, (c + gen.standard_normal(12) * 1e-4).tolist(), 0) for g, c in enumerate(ends) for i in range(40)]
    step = [np.cos(x) * e[0] + np.sin(x) * e[1] for x in np.radians([3, 13])]
    rows += [(500 + i, v.tolist(), 0) for i, v in enumerate(step)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute.vectors(rows)
    assert {w[2] for w in want} == {0}
    same(nn_descent.near_vectors(df, nn_descent.Settings(neighbours=4, trees=1, leaf=16, block=16, audited=1, linked=1, recall=0)).collect(), want)


def test_vectors_audit_fails_closed(spark, monkeypatch):
    """Descent finds nothing: the rare pairs are found all the same, whether the draw has links or not."""
    gen = np.random.default_rng(8)
    rows = [(i, gen.standard_normal(16).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, (np.asarray(rows[i][1]) * 1.001 + 1e-3).tolist(), 0) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    none = spark.createDataFrame([], "u long, v long, sim double")
    monkeypatch.setattr(nn_descent, "_descend", lambda *a: none)
    for settings in (nn_descent.Settings(audited=2, most_audited=8, side=100), nn_descent.Settings(trees=1, audited=500, side=100)):
        same(nn_descent.near_vectors(df, settings).collect(), brute.vectors(rows))


def test_fuzzy_lines(spark, case):
    rows, df = case
    rows = [(d, t) for d, t in {d: t for d, t in rows if d is not None}.items() if len(t or "") < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string") if rows else df
    got = fuzzy_lines.fuzzy_lines(df).select("doc_id", "line_no", "kept").collect()
    want = brute.lines(rows)
    same(got, want)


def test_fuzzy_lines_of_the_rule_are_all_found(spark):
    """All pairs of both near fingerprints and edit similarity, planted with edits spread evenly."""
    gen, lines = random.Random(11), []
    for size in (20, 40, 60, 100, 200, 400):
        for share in (0.05, 0.1, 0.15, 0.2):
            for _ in range(6):
                words = "".join(gen.choice("abcdefghij  ") for _ in range(size))
                edited = list(words)
                for i in gen.sample(range(size), max(1, int(size * share))):
                    edited[i] = "Z"
                lines += [words, "".join(edited), " ".join(reversed(words.split()))]
    rows = list(enumerate(lines))
    got = fuzzy_lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    same(got.select("doc_id", "line_no", "kept").collect(), brute.lines(rows))


def test_fuzzy_lines_of_very_long_and_equal_lines(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, long), (2, long.upper()), (3, long.replace("w777 ", "w77 ")), (4, "a b"), (4, "a b"), (None, "A  B"), (5, None), (6, "")]
    got = sorted((r["doc_id"] or 0, r["kept"]) for r in fuzzy_lines.fuzzy_lines(table(spark, rows)).collect())
    assert got == [(0, True), (1, True), (2, False), (3, False), (4, False), (4, False), (5, True), (6, True)]
    assert fuzzy_lines.fuzzy_lines(table(spark, [])).count() == 0


def test_edit_within():
    gen = random.Random(7)
    for _ in range(3000):
        a = "".join(gen.choice("abc ") for _ in range(gen.randrange(14)))
        b = a if gen.random() < 0.3 else "".join(gen.choice("abc ") for _ in range(gen.randrange(14)))
        d = brute.edit_distance(a, b)
        assert [fuzzy_lines.edit_within(a, b, n) for n in range(15)] == [d <= n for n in range(15)], (a, b)


def test_workers_give_memory_back(monkeypatch):
    from likeness.llm import batches

    calls = []
    monkeypatch.setattr(batches, "_TRIM", calls.append)
    batches.kept(("one",), dict)
    batches.kept(("two",), dict)
    assert len(calls) == 2 and batches.kept(("two",), list) == {} and len(calls) == 2


def test_near_texts_by_both_ways(spark):
    gen, pairs = random.Random(8), []
    for i in range(400):
        a = "".join(gen.choice("ab\u00e9 \U0001f600") for _ in range(gen.randrange(1, 24)))
        b = list(a)
        for _ in range(gen.randrange(6)):
            b[gen.randrange(len(b))] = gen.choice(["", "a", "b", "\u00e9\u00e9"])
        pairs.append((i, -i, a, "".join(b)))
    df = spark.createDataFrame(pairs, "a long, b long, x string, y string")
    want = {i for i, _, a, b in pairs if brute.edit_distance(a, b) <= int((1 - 0.8) * max(len(a), len(b)) + 1e-9)}
    for longest in (0, 10, 100):  # Python alone, both, Spark alone
        assert {r["a"] for r in fuzzy_lines.near_texts(df, 0.8, longest).collect()} == want
    plan = fuzzy_lines.near_texts(df, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan


def test_fuzzy_lines_awkward_rows_and_text(spark):
    got = fuzzy_lines.fuzzy_lines(table(spark, AWKWARD))
    assert got.count() == sum((t or "").count("\n") + 1 for _, t in AWKWARD)
    df = spark.createDataFrame([(1, "A line that is here\n\nother"), (2, "a  line that is here\nlast\nlast"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, fuzzy_lines.deduplicated(df).collect())) == [(1, "A line that is here\n\nother"), (2, "last"), (3, "")]


def test_toxicity(spark):
    gen = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        text = [gen.choice(words) for _ in range(60)] + (["vile", "nastyness"] if bad else [])
        gen.shuffle(text)
        rows.append((i, " ".join(text)))
        labels += [(i, int(bad))] if i % 2 == 0 else []
    rows += [(None, None), (9000, ""), (9000, ""), (9001, "vile " * 50_000)]
    schema = "doc_id long, toxic int"
    df, known = table(spark, rows), spark.createDataFrame([*labels, (None, 1), (9001, None), (70_000, 1)], schema)
    got = {r["doc_id"]: r for r in toxicity.scored(df, known).collect()}
    wrong = sum(got[i]["predicted"] != int(i % 8 == 0) for i in range(1500))
    assert wrong <= 15 and got[None]["predicted"] == 0 and got[9000]["score"] == got[None]["score"]
    for none in (known.limit(0), known.filter("toxic = 0"), known.filter("toxic = 1")):
        assert toxicity.scored(df, none).count() == len(rows)
    assert toxicity.scored(df.limit(0), known).count() == 0


def plain_risk(weights, bias, positive, unlabelled, prior):
    """The non-negative risk on a dense table: prior * E+[l(s)] + max(0, Eu[l(-s)] - prior * E+[l(-s)])."""
    score = lambda rows: np.asarray([sum(weights.get(f, 0.0) for f in set(r.tolist())) + bias for r in rows])
    p, u = score(positive), score(unlabelled)
    loss = lambda s: np.logaddexp(0, -s)
    return prior * loss(p).mean() + max(0.0, loss(-u).mean() - prior * loss(-p).mean())


def test_training_finds_the_least_risk():
    gen = np.random.default_rng(0)
    rows = lambda n, share: [np.asarray([f for f in range(12) if gen.random() < (0.8 if f < 4 and gen.random() < share else 0.2)], "<i4")
                             for _ in range(n)]
    positive, unlabelled, prior = rows(300, 1.0), rows(300, 1.0) + rows(700, 0.0), 0.3
    settings = toxicity.Settings(bits=6, steps=12000, rate=0.1, decay=0.0, least_errors=0.5)
    used, weights, bias = toxicity.train(positive, unlabelled, prior, settings)
    found = dict(zip(used.tolist(), weights.tolist()))
    least = plain_risk(found, bias, positive, unlabelled, prior)
    assert set(range(4)) <= set(found) and least < plain_risk({}, float(np.log(prior / (1 - prior))), positive, unlabelled, prior) - 0.05

    def slope(weights, bias, f):  # by central differences
        up, down = dict(weights), dict(weights)
        if f is not None:
            up[f], down[f] = up.get(f, 0.0) + 1e-4, down.get(f, 0.0) - 1e-4
        step = 1e-4 if f is None else 0.0
        return (plain_risk(up, bias + step, positive, unlabelled, prior) - plain_risk(down, bias - step, positive, unlabelled, prior)) / 2e-4

    first = max(abs(slope({}, float(np.log(prior / (1 - prior))), f)) for f in found)
    assert all(abs(slope(found, bias, f)) < 0.1 * first for f in [*found, None])


def test_repeated_ids_are_drawn_once(spark):
    """Eight thousand rows of one id leave the draw to the others."""
    rows = [(1, "same text of one id")] * 8000 + [(i, f"clean words number {i}") for i in range(2, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(2, 300)], "doc_id long, toxic int")
    kept = docs.select("doc_id").filter(~toxicity.held_out("doc_id", 5)).distinct()
    assert toxicity._draw(kept, 0, 6000).count() == kept.count() > 200
    assert toxicity.scored(docs, labels, toxicity.Settings(members=1, steps=5)).count() == len(rows)


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    rank = got.score.rank()
    y = got.toxic == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95 and (got.predicted[~y].mean() < 0.02) and got.predicted[y].mean() > 0.85


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, FOLDER)
    assert clean.columns == columns and clean.count() <= docs.count()
    rows = AWKWARD
    df = table(spark, rows)
    once = stages["exact_dedup"](spark, df, FOLDER)
    assert once.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in once.collect()]
    best = {}
    for d, t in rows:
        best[brute.fold(t)] = max(best.get(brute.fold(t), -1), -1 if d is None else d)
    same([(-1 if d is None else d, brute.fold(t)) for d, t in kept], [(d, t) for t, d in best.items()])
    near = stages["near_dedup"](spark, df, FOLDER)
    assert near.columns == df.columns
    # One row for each component, with the component's least doc_id.
    a = np.asarray([brute.fingerprint(t) for _, t in rows], np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2, 1))
    root = brute.roots(len(rows), zip(i.tolist(), j.tolist()))
    least = {}
    for r, (d, _) in zip(root, rows):
        least[r] = min(1 << 40 if d is None else d, least.get(r, 1 << 40))
    same([(1 << 40 if r["doc_id"] is None else r["doc_id"],) for r in near.collect()], [(d,) for d in least.values()])
    for stage in ("exact_dedup", "near_dedup", "packing"):
        assert stages[stage](spark, df.limit(0), FOLDER).count() == 0


def test_pipeline_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_packing(rows, QUERIES["pipeline"](spark, FOLDER).collect(), 2048)


def test_a_worker_keeps_the_tables_of_one_operator():
    """What the tokenizer remembers is dropped when the worker turns to scores, and the other way round."""
    import gc
    import weakref

    from likeness.llm import batches, tokens, toxicity

    encoder = tokens.word_encoder(tokens.WORD_BPE)
    assert tokens.word_encoder(tokens.WORD_BPE) is encoder
    held = weakref.ref(encoder)
    del encoder
    table = toxicity._weights("m", toxicity.Model(4, {1: 0.5}, 0.0))
    gc.collect()
    assert held() is None and toxicity._weights("m", toxicity.Model(4, {1: 0.5}, 0.0)) is table
    assert len(batches._KEPT) == 1
