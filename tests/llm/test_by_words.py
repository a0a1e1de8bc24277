"""Lines that differ in a few words are settled by words, without the table of edits."""

import random

from likeness.llm import fuzzy_lines as L


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_words_bound_the_distance_from_above():
    rng = random.Random(3)
    settled = 0
    for _ in range(400):
        a = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 2)] = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 2))]
        x, y = " ".join(a), " ".join(b)
        allowed = rng.randint(0, 12)
        far = _distance(x, y)
        assert L.edit_within(x, y, allowed) == (far <= allowed)
        found = L._by_words(x, y, allowed)
        assert not found or far <= allowed
        settled += found
    assert settled > 100


def test_changed_words_do_not_need_the_table():
    words = [f"word{i}" for i in range(200)]
    other = ["new"] + words[:50] + ["more", "of", "it"] + words[50:120] + words[121:199] + ["end"]
    assert L._by_words(" ".join(words), " ".join(other), 60)
    assert not L._by_words(" ".join(words), " ".join(other), 5)
