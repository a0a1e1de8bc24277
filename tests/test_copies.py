"""Pairs of copies."""

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_copies_are_pairs(spark):
    """Equal texts are as much alike as texts can be; each of them also meets what one of them meets."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    grams = {r["doc_id"]: {r["text"][i:i + 8] for i in range(len(r["text"]) - 7)} for r in docs if r["text"]}
    copies = {(a["doc_id"], b["doc_id"]) for a in docs for b in docs if a["doc_id"] < b["doc_id"] and a["text"] == b["text"] and grams.get(a["doc_id"])}
    got = {(r["a"], r["b"]): r["identity"] for r in entry.queries()["sequence_identity_join"](spark, FOLDER).collect()}
    assert copies and all(got.get(pair) == 1.0 for pair in copies)
    by_content = {}
    for a, b in got:
        for one, other in ((a, b), (b, a)):
            by_content.setdefault(one, set()).add(other)
    assert all(by_content[a] - {b} == by_content[b] - {a} for a, b in copies)
