"""Lines are compared without their equal ends, and all but short ones in Python."""

import os
import random

import brute
from likeness.llm import fuzzy_lines


def test_equal_starts():
    gen = random.Random(4)
    for _ in range(2000):
        a = "".join(gen.choice("abé\U0001f600") for _ in range(gen.randrange(30)))
        b = a[:gen.randrange(31)] + "".join(gen.choice("abé") for _ in range(gen.randrange(5)))
        assert fuzzy_lines._equal_start(a, b) == len(os.path.commonprefix([a, b]))


def test_lines_of_some_length_are_not_compared_cell_by_cell(spark):
    gen, pairs = random.Random(9), []
    for i in range(60):
        a = "".join(gen.choice("abcdef ") for _ in range(gen.randrange(40, 160)))
        b = list(a)
        for _ in range(gen.randrange(60)):
            b[gen.randrange(len(b))] = gen.choice(["", "x", "yz"])
        pairs.append((i, -i, a, "".join(b)))
    made = fuzzy_lines.near_texts(spark.createDataFrame(pairs, "a long, b long, x string, y string"), 0.8)
    want = {i for i, _, a, b in pairs if brute.edit_distance(a, b) <= int((1 - 0.8) * max(len(a), len(b)) + 1e-9)}
    assert {r["a"] for r in made.collect()} == want and 0 < len(want) < 60
    assert fuzzy_lines.LONG <= 64  # before, 4,096
