"""N-grams grow from one another: no window cuts its words out of the whole list."""

from pyspark.sql import functions as F

from likeness.functions import fingerprints as FP
from likeness.functions.draws import uint32


def _grams(words, n):
    return [" ".join(w for w in words[i:i + k] if w is not None) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def test_grams_grow_from_the_shorter_ones(spark):
    lists = [["a", "b", "a", "c", "d", "e", "f", "g", "a"], ["x"], [], [None, "y", None, None, "z"], ["", "q", ""]]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "id int, words array<string>")
    found = rows.select("id", FP.features(F.col("words"), "path").alias("path"), FP.features(F.col("words"), "ngram2").alias("two"))
    for row in found.collect():
        assert row["path"] == _grams(lists[row["id"]], 7)
        assert row["two"] == _grams(lists[row["id"]], 2)
    # Grams made one by one out of the list took most of the time.
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_positions_are_those_of_the_first_32_bits(spark):
    at = FP.position(F.col("id").cast("string")).alias("at")
    rows = spark.range(2000).select(at, F.pmod(uint32(F.md5(F.col("id").cast("string"))), F.lit(FP.N_BITS)).alias("want"))
    assert rows.filter("at <> want").count() == 0
