"""Fingerprints, descriptors, similarity joins and neighbour profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions import fingerprints as FP
from likeness.functions import vectors as V
from likeness.functions.draws import digest
from likeness.functions.scalars import distance_to_similarity
from likeness.operators import similarity as SIM
from likeness.operators.closeness import CONTAINMENT, near_records, overlap_join
from likeness.operators.neighbours import neighbour_profile
from likeness.operators.ordering import sample_n
from likeness.operators.sampling import random_pairs
from likeness.plans import sqlparts as Q
from likeness.plans.base import CLOSE
from likeness.plans.registry import query
from likeness.session import cut_lineage
from likeness.sources.tables import spread

micro = lambda c: F.array_join(F.transform(c, lambda x: F.bround(x * 1e6).cast("long")), ",")


def doc_prints(t, kind="ngram2"):
    return spread(t.documents).select(F.col("doc_id").alias("id"), FP.bits(FP.tokens(F.col("text")), kind).alias("bits"))


def _register_fingerprint(name, kind):
    sql = f"""WITH {Q.doc_tokens()}, {Q.fp('fp', 'tok', kind)}
SELECT tok.id AS doc_id, count(bit) AS n_bits, md5(coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit), '')) AS digest
FROM tok LEFT JOIN fp USING (id) GROUP BY tok.id"""

    @query(name, sql)
    def _(t):
        return doc_prints(t, kind).select(
            F.col("id").alias("doc_id"), F.size("bits").cast("long").alias("n_bits"),
            F.md5(F.array_join("bits", ",")).alias("digest"))


for _name, _kind in (("fp_ngram2", "ngram2"), ("fp_ngram3", "ngram3"), ("fp_class", "class"),
                     ("fp_path", "path"), ("fp_pair", "pair"), ("fp_quad", "quad")):
    _register_fingerprint(_name, _kind)


@query("fp_counts", f"""WITH {Q.doc_tokens()}, {Q.fp('fp', 'tok', 'ngram2', distinct=False)},
c AS (SELECT id, bit, count(*) AS n FROM fp GROUP BY 1, 2)
SELECT id AS doc_id, count(*) AS n_bits, sum(n)::BIGINT AS total, max(n) AS highest, sum(n*bit)::BIGINT AS checksum FROM c GROUP BY 1""")
def _(t):
    feats = FP.features(FP.tokens(F.col("text")), "ngram2")
    counts = (spread(t.documents).select("doc_id", F.explode(feats).alias("f"))
              .groupBy("doc_id", FP.position(F.col("f")).cast("long").alias("bit"))
              .agg(F.count("*").alias("n")))
    return counts.groupBy("doc_id").agg(
        F.count("*").alias("n_bits"), F.sum("n").alias("total"), F.max("n").alias("highest"),
        F.sum(F.col("n") * F.col("bit")).alias("checksum"))


def descriptors(text):
    """Name -> column: the one-number baseline (chars) and the rest of the block."""
    words = FP.tokens(text)
    n = F.size(words)
    chars = F.length(text)
    return {
        "chars": chars.cast("double"),
        "lines": (chars - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("double"),
        "words": n.cast("double"),
        "vocabulary": F.size(F.array_distinct(words)).cast("double"),
        "word_length": F.coalesce(
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)) / F.nullif(n, F.lit(0)), F.lit(0.0)),
        "digits": F.regexp_count(text, F.lit("[0-9]")).cast("double"),
        "capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("double"),
        "marks": F.regexp_count(text, F.lit("[.,;:!?]")).cast("double"),
    }


DESCRIPTORS = """descr AS (SELECT doc_id, length(text)::DOUBLE AS chars,
 (length(text)-length(replace(text, chr(10), '')))::DOUBLE AS lines, len(w)::DOUBLE AS words,
 len(list_distinct(w))::DOUBLE AS vocabulary,
 coalesce(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE/nullif(len(w),0),0.0) AS word_length,
 length(regexp_replace(text,'[^0-9]','','g'))::DOUBLE AS digits,
 length(regexp_replace(text,'[^A-Z]','','g'))::DOUBLE AS capitals,
 length(regexp_replace(text,'[^.,;:!?]','','g'))::DOUBLE AS marks FROM documents JOIN tok ON id=doc_id)"""


def doc_descriptors(t):
    return spread(t.documents).select("doc_id", *[c.alias(n) for n, c in descriptors(F.col("text")).items()])


@query("descriptor_block", f"""WITH {Q.doc_tokens()}, {DESCRIPTORS}
SELECT doc_id, chars, lines, words, vocabulary, round(word_length,6) AS word_length, digits, capitals, marks FROM descr""")
def _(t):
    return doc_descriptors(t).withColumn("word_length", F.round("word_length", 6))


# --- pairs --------------------------------------------------------------------

DOC_PAIRS = Q.random_pairs("rp", "documents", "doc_id", 10, "docs")
VEC_PAIRS = Q.random_pairs("vp", "embeddings", "vec_id", 10, "vecs")


@query("tanimoto_pairs", f"WITH {Q.doc_tokens()}, {Q.fp('fp', 'tok')}, {DOC_PAIRS}, {Q.tanimoto_pairs('tp', 'rp', 'fp')} "
       "SELECT a, b, round(sim,6) AS sim FROM tp")
def _(t):
    pairs = random_pairs(t.documents, "doc_id", 10, "docs").select("a", "b").distinct()
    return SIM.tanimoto_of_pairs(pairs, doc_prints(t)).withColumn("sim", F.round("sim", 6))


def vectors(t):
    return t.embeddings.select("vec_id", "label", V.as_double("embedding").alias("v"))


def gathered(t):
    v = vectors(t).select("vec_id", "v")
    pairs = random_pairs(v, "vec_id", 10, "vecs").select("a", "b").distinct()
    return (pairs.join(v.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), "a")
            .join(v.select(F.col("vec_id").alias("b"), F.col("v").alias("vb")), "b"))


GATHER = f"""{VEC_PAIRS}, g AS (SELECT DISTINCT p.a, p.b, x.embedding::DOUBLE[] AS va, y.embedding::DOUBLE[] AS vb FROM vp p
 JOIN embeddings x ON x.vec_id=p.a JOIN embeddings y ON y.vec_id=p.b)"""


@query("pair_gather", f"WITH {GATHER} SELECT a, b, round(list_inner_product(va, vb),6) AS dot FROM g")
def _(t):
    return gathered(t).select("a", "b", F.round(V.dot(F.col("va"), F.col("vb")), 6).alias("dot"))


@query("cosine_pairs", f"WITH {GATHER} SELECT a, b, round(list_cosine_similarity(va, vb),6) AS cosine FROM g")
def _(t):
    return gathered(t).select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@query("distance_to_similarity", f"WITH {GATHER} SELECT a, b, round(exp(-4.0*list_distance(va, vb)),6) AS similarity FROM g")
def _(t):
    d = V.euclidean(F.col("va"), F.col("vb"))
    return gathered(t).select("a", "b", F.round(distance_to_similarity(d), 6).alias("similarity"))


@query("l2_normalise", """WITH u AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding,1) AS pos,
 greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])),1e-8) AS n FROM embeddings)
SELECT vec_id, pos::BIGINT AS pos, round(x/n,6) AS value FROM u""")
def _(t):
    return vectors(t).select("vec_id", F.posexplode(V.unit(F.col("v"))).alias("pos", "value")).select(
        "vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("hybrid_features", f"""WITH {Q.doc_tokens()}, {DESCRIPTORS},
h AS (SELECT doc_id, list_concat([chars, words, digits], coalesce(embedding::DOUBLE[], list_transform(range(64), lambda i: 0.0::DOUBLE))) AS f
 FROM descr LEFT JOIN embeddings ON vec_id=doc_id)
SELECT doc_id, len(f) AS width, round(list_sum(list_transform(f, lambda x, i: x*i)),4) AS checksum FROM h""")
def _(t):
    block = doc_descriptors(t).select("doc_id", F.array("chars", "words", "digits").alias("d"))
    zero = F.array_repeat(F.lit(0.0), 64)
    joined = block.join(vectors(t).select(F.col("vec_id").alias("doc_id"), "v"), "doc_id", "left")
    f = F.concat("d", F.coalesce("v", zero))
    return joined.select("doc_id", f.alias("f")).select(
        "doc_id", F.size("f").cast("long").alias("width"),
        F.round(V.total(F.transform("f", lambda x, i: x * (i + 1))), 4).alias("checksum"))


@query("embedding_lookup", """SELECT doc_id, vec_id IS NOT NULL AS found, round(list_sum(coalesce(embedding::DOUBLE[],
 list_transform(range(64), lambda i: 0.0::DOUBLE))),6) AS total FROM documents LEFT JOIN embeddings ON vec_id=doc_id""")
def _(t):
    joined = t.documents.select("doc_id").join(
        vectors(t).select(F.col("vec_id").alias("doc_id"), "v", F.lit(True).alias("hit")), "doc_id", "left")
    v = F.coalesce("v", F.array_repeat(F.lit(0.0), 64))
    return joined.select("doc_id", F.coalesce("hit", F.lit(False)).alias("found"), F.round(V.total(v), 6).alias("total"))


# --- joins --------------------------------------------------------------------


def doc_features(t, kind="ngram2"):
    """(id, feats): n-grams of each document, unfolded, as 64-bit hashes."""
    return spread(t.documents).select(F.col("doc_id").alias("id"), hashed(FP.features(FP.tokens(F.col("text")), kind)).alias("feats"))


def hashed(features):
    return F.transform(F.array_distinct(features), lambda f: F.xxhash64(f))


@query("tanimoto_topk_join", f"""WITH {Q.doc_tokens()}, {Q.features('ff', 'tok')}, {Q.close_pairs('ts', 'ff', CLOSE)}
SELECT a, b, round(sim,6) AS sim, rank FROM (SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank
 FROM ts WHERE sim <= 0.999) WHERE rank <= 8""")
def _(t):
    # Made twice from the texts: as a table they would lie on disk beside their own shuffles.
    return near_records(doc_features(t), 8, CLOSE, 0.999).select(
        "a", "b", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("tanimoto_matrix", f"""WITH {Q.doc_tokens()}, {Q.doc_tokens('btok', 'benchmark', 'item_id')}, {Q.fp('fp', 'tok')}, {Q.fp('bfp', 'btok')},
{Q.tanimoto_all('ts', 'fp', 'bfp')},
g AS (SELECT doc_id AS a, item_id AS b FROM documents CROSS JOIN benchmark)
SELECT a AS doc_id, string_agg(round_even((1.0-coalesce(sim,0.0))*1e6,0)::BIGINT::VARCHAR, ',' ORDER BY b) AS distances
FROM g LEFT JOIN ts USING (a, b) GROUP BY a""")
def _(t):
    items = t.benchmark.select(F.col("item_id").alias("id"), FP.bits(FP.tokens(F.col("text"))).alias("bits"))
    return SIM.matrix_rows(cut_lineage(doc_prints(t), "prints"), items, SIM.tanimoto_distances).select(
        F.col("id").alias("doc_id"), "distances")


DEDUP = """cg AS (SELECT md5(text) AS content, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1)"""


@query("tanimoto_threshold_join", f"""WITH {Q.doc_tokens()}, {DEDUP}, own AS (SELECT tok.* FROM tok JOIN cg USING (id)), {Q.features('ff', 'own')}, {Q.close_pairs('ts', 'ff', 0.6)}
SELECT a, b, round(sim,6) AS sim, (x.copies*y.copies)::BIGINT AS pairs FROM ts JOIN cg x ON x.id=a JOIN cg y ON y.id=b
WHERE a < b""")
def _(t):
    groups, _members = SIM.content_groups(t.documents, "doc_id", F.md5("text"))
    groups = cut_lineage(groups, "groups")
    found = overlap_join(doc_features(t).join(groups, "id", "left_semi"), 0.6)  # read once, so features are not written
    copies = groups.select("id", "copies")
    return (found.join(copies.toDF("a", "ca"), "a").join(copies.toDF("b", "cb"), "b")
            .select("a", "b", F.round("sim", 6).alias("sim"), (F.col("ca") * F.col("cb")).alias("pairs")))


def char_kmers(text, k=5):
    grams = lambda chars: FP.windows(chars, k, lambda i: F.array_join(F.slice(chars, i, k), ""))
    return F.array_distinct(V.let(F.split(text, ""), grams))


@query("sequence_identity_join", """WITH g AS MATERIALIZED (SELECT DISTINCT doc_id AS id, unnest(list_transform(range(1, length(text)-8+2), lambda i: substr(text, i, 8))) AS gram FROM documents),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT gram, row_number() OVER () AS code FROM g GROUP BY 1 HAVING count(*) > 1),
k AS MATERIALIZED (SELECT id, code FROM g JOIN c USING (gram))
SELECT a, b, round(s::DOUBLE/least(x.n, y.n),6) AS identity FROM (SELECT l.id AS a, r.id AS b, count(*) AS s FROM k l JOIN k r USING (code)
 WHERE l.id < r.id GROUP BY 1,2) JOIN n x ON x.id=a JOIN n y ON y.id=b WHERE s::DOUBLE/least(x.n,y.n) >= 0.3""")
def _(t):
    # Copies are one text while pairs are sought, and pairs of their own in the result.
    groups, members = SIM.content_groups(t.documents, "doc_id", F.md5("text"))
    members = cut_lineage(members.select("doc_id", F.col("id").alias("leader")), "members")
    sets = (spread(t.documents).select(F.col("doc_id").alias("id"), hashed(char_kmers(F.col("text"), 8)).alias("feats"))
            .join(groups, "id", "left_semi"))
    sets = cut_lineage(sets, "grams")
    found = overlap_join(sets, 0.3, CONTAINMENT, "identity")
    own = sets.filter(F.size("feats") > 0).select(F.col("id").alias("leader"))
    return SIM.every_copy(found, members, own, "identity").withColumn("identity", F.round("identity", 6))


@query("target_relatedness", """WITH nm AS (SELECT DISTINCT p_name FROM part),
k AS (SELECT DISTINCT p_name, unnest(list_transform(range(1, length(p_name)-3+2), lambda i: substr(p_name, i, 3))) AS kmer FROM nm),
n AS (SELECT p_name, count(*) AS n FROM k GROUP BY 1),
sq AS (SELECT l.p_name AS t1, r.p_name AS t2, count(*)::DOUBLE/least(any_value(x.n), any_value(y.n)) AS value FROM k l JOIN k r USING (kmer)
 JOIN n x ON x.p_name=l.p_name JOIN n y ON y.p_name=r.p_name WHERE l.p_name <> r.p_name GROUP BY 1,2
 HAVING count(*)::DOUBLE/least(any_value(x.n), any_value(y.n)) >= 0.3),
fm AS (SELECT x.p_name AS t1, y.p_name AS t2, 0.5::DOUBLE AS value FROM nm x JOIN nm y
 ON split_part(x.p_name,' ',2)=split_part(y.p_name,' ',2) AND x.p_name<>y.p_name),
st AS (SELECT p_name AS t1, p_name AS t2, 1.0::DOUBLE AS value FROM nm UNION ALL SELECT * FROM sq UNION ALL SELECT * FROM fm)
SELECT t1, t2, round(max(value),6) AS value FROM st GROUP BY 1,2""")
def _(t):
    # Targets are product names: a vocabulary of fixed size.
    from likeness.operators.lineage import lineage_similarity, max_merge

    names = t.part.select(F.col("p_name").alias("target")).distinct()
    words = F.split("target", " ")
    family = lineage_similarity(names.select("target", F.array(words[1], words[0]).alias("path")), 1, 2)
    sets = names.select(F.col("target").alias("id"), hashed(char_kmers(F.col("target"), 3)).alias("feats"))
    by_text = overlap_join(sets, 0.30, CONTAINMENT, "identity").select(
        F.col("a").alias("t1"), F.col("b").alias("t2"), F.col("identity").alias("value"))
    return max_merge([family, by_text], names).withColumn("value", F.round("value", 6))


@query("topk_per_row", """SELECT l_partkey, l_suppkey, total, rank FROM (SELECT l_partkey, l_suppkey, round(sum(l_quantity),6) AS total,
 row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1,2) WHERE rank <= 3""")
def _(t):
    from pyspark.sql import Window

    totals = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 6).alias("total"))
    order = Window.partitionBy("l_partkey").orderBy(F.desc("total"), "l_suppkey")
    return totals.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 3")


@query("landmark_cross", f"""WITH lm AS (SELECT vec_id AS lid, embedding::DOUBLE[] AS lv FROM (SELECT *, {Q.position('vec_id', 'landmark')} AS p FROM embeddings) WHERE p < 32)
SELECT vec_id, string_agg(round_even(list_distance(embedding::DOUBLE[], lv)*1e6,0)::BIGINT::VARCHAR, ',' ORDER BY lid) AS distances
FROM embeddings CROSS JOIN lm GROUP BY vec_id""")
def _(t):
    return landmark_distances(vectors(t).select("vec_id", "v"), landmarks(t, 32)).select(
        "vec_id", micro("distances").alias("distances"))


def landmarks(t, k):
    return sample_n(vectors(t).select("vec_id", "v"), "vec_id", k, "landmark")


def landmark_distances(points, marks):
    """Distances to the landmarks in id order, as one array per point.

    The landmark table has a fixed number of rows (at most 64), so it travels
    as one scalar value of the plan.
    """
    listed = marks.agg(F.array_sort(F.collect_list(F.struct("vec_id", "v")))).scalar()
    return points.withColumn("_marks", listed).select(
        *points.columns, F.transform("_marks", lambda m: V.euclidean(F.col("v"), m["v"])).alias("distances"))


@query("pair_distance_matrix", """WITH d AS (SELECT x.vec_id AS a, y.vec_id AS b, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d
 FROM embeddings x JOIN embeddings y ON x.label < 5 AND y.label >= 5)
SELECT a AS vec_id, string_agg(round_even(d*1e6,0)::BIGINT::VARCHAR, ',' ORDER BY b) AS distances FROM d GROUP BY a""")
def _(t):
    v = vectors(t).select(F.col("vec_id").alias("id"), F.col("v").alias("bits"), "label")
    some = v.filter("bits IS NOT NULL")
    sides = some.filter("label < 5").select("id", "bits"), some.filter("label >= 5").select("id", "bits")
    rows = SIM.matrix_rows(*sides, SIM.euclidean_distances)
    # Distances of components below FINITE are finite. Only where others are is the largest one sought first, without texts.
    usual = F.forall("bits", lambda x: F.coalesce(F.abs(x) < FINITE, F.lit(False)))
    if some.filter(~usual).limit(1).count():
        rows = finite_rows(rows, SIM.matrix_rows(*sides, SIM.euclidean_distances, texts=False))
    found = rows.select(F.col("id").alias("vec_id"), "distances")
    # A row without a vector has no distances.
    absent = v.filter("bits IS NULL AND label < 5").select(F.col("id").alias("vec_id"), F.lit(None).cast("string").alias("distances"))
    return found.unionByName(absent)


#: Squares of numbers below it add up to a finite one.
FINITE = 1e150


def finite_rows(rows, tops=None):
    """Entries that are no finite number become the largest finite one of ``tops`` (1 if none)."""
    top = (rows if tops is None else tops).filter("top >= 0").agg(F.bround(F.coalesce(F.max("top"), F.lit(1.0)) * 1e6).cast("long").cast("string")).scalar()
    return rows.withColumn("distances", F.replace("distances", F.lit("x"), top))


# --- neighbours ---------------------------------------------------------------


def doc_profiles(t):
    """Labels as graded calls: two targets, +1 or -1."""
    both = F.array(F.struct(F.lit("quality").alias("target"), F.col("quality").alias("x")),
                   F.struct(F.lit("toxic").alias("target"), F.col("toxic").alias("x")))
    return t.labels.select(F.col("doc_id").alias("entity"), F.inline(both)).select(
        "entity", "target", (F.col("x") * 2.0 - 1.0).alias("value"))


@query("neighbour_profile", f"""WITH {Q.doc_tokens()}, {Q.fp('fp', 'tok')},
rf AS (SELECT * FROM fp WHERE id IN (SELECT doc_id FROM labels)), qf AS (SELECT * FROM fp WHERE id NOT IN (SELECT doc_id FROM labels)),
{Q.tanimoto_all('ts', 'qf', 'rf')},
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM ts) WHERE rank <= 25),
pf AS (SELECT doc_id, 'quality' AS target, quality*2.0::DOUBLE-1.0 AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic*2.0::DOUBLE-1.0 FROM labels)
SELECT a AS doc_id, target, round(sum(sim*value)/sum(sim),6) AS value FROM nn JOIN pf ON doc_id=b GROUP BY 1,2""")
def _(t):
    prints, labels = cut_lineage(doc_prints(t), "prints"), t.labels.select(F.col("doc_id").alias("id"))
    queries = prints.join(labels, "id", "left_anti")
    references = prints.join(labels, "id", "left_semi")
    return neighbour_profile(queries, references, doc_profiles(t), 25).select(
        F.col("entity").alias("doc_id"), "target", F.round("value", 6).alias("value"))
