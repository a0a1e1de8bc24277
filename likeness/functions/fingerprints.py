"""Hashed n-gram fingerprints of token lists, as arrays of set positions.

A record becomes a set of up to 2048 positions. The whole token list is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from likeness.functions.vectors import let

N_BITS = 2048
SKIP = 5  # widest gap of a skip pair


def tokens(text: Column) -> Column:
    """Lower-case words, split at white space."""
    return F.filter(F.split(F.lower(text), "[ \\n\\t\\r]+"), lambda w: w != "")


def windows(words: Column, width: int, make: Callable[[Column], Column]) -> Column:
    """make(start) for each start of a full window, an empty list when too short."""
    count = F.size(words) - F.lit(width - 1)
    filled = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), make)
    return F.when(count >= 1, filled).otherwise(F.array().cast("array<string>"))


def ngrams(words: Column, n: int) -> Column:
    return windows(words, n, lambda i: F.array_join(F.slice(words, i, n), " "))


def up_to(words: Column, n: int) -> Column:
    """All n-grams of 1 to ``n`` words, short ones first; each is the one before it with one word more."""
    longer = lambda g, w: F.coalesce(F.concat(g, F.lit(" "), w), g, w)

    def grow(found: list[Column], ws: Column) -> Column:
        width, last = len(found), found[-1]
        if width == n:
            return F.concat(*found)
        starts = F.slice(last, F.lit(1), F.greatest(F.size(last) - 1, F.lit(0)))
        grown = F.transform(starts, lambda g, i: longer(g, F.get(ws, i + width)))
        return let(grown, lambda g: grow([*found, g], ws))

    grams = let(F.coalesce(words, F.array().cast("array<string>")), lambda ws: grow([ws], ws))
    return F.transform(grams, lambda g: F.coalesce(g, F.lit("")))  # of null words alone


def skip_pairs(words: Column, gap: int) -> Column:
    """(word, word, gap) for words ``gap`` places apart."""
    at = lambda i: F.element_at(words, i.cast("int"))
    return windows(
        words, gap + 1, lambda i: F.concat_ws(" ", at(i), at(i + gap), F.lit(str(gap))))


def token_classes(words: Column) -> Column:
    """Each word by its shape: length up to 8, and d for words with a digit."""
    return F.transform(words, lambda w: F.concat(
        F.least(F.length(w), F.lit(8)).cast("string"),
        F.when(w.rlike("[0-9]"), F.lit("d")).otherwise(F.lit("w"))))


def features(words: Column, kind: str) -> Column:
    """All features of one kind, repeats kept."""
    if kind == "class":
        return let(token_classes(words), lambda w: _features(w, "ngram2"))
    return let(words, lambda w: _features(w, kind))


def _features(words: Column, kind: str) -> Column:
    if kind == "ngram2":
        return up_to(words, 2)
    if kind == "ngram3":
        return up_to(words, 3)
    if kind == "path":
        return up_to(words, 7)
    if kind == "pair":
        return F.concat(*[skip_pairs(words, g) for g in range(1, SKIP + 1)])
    if kind == "quad":
        return ngrams(words, 4)
    raise ValueError(f"unknown fingerprint: {kind}")


def position(feature: Column) -> Column:
    """The first 32 bits of the MD5 modulo N_BITS: as this divides 16**3, the last three of their hex digits say it."""
    return F.pmod(F.conv(F.substring(F.md5(feature), 6, 3), 16, 10).cast("int"), F.lit(N_BITS))


def bits(words: Column, kind: str = "ngram2") -> Column:
    """Sorted set positions (array<int>)."""
    return F.sort_array(F.array_distinct(F.transform(features(words, kind), position)))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over joint positions; 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    joint = F.size(a) + F.size(b) - shared
    return F.when(joint > 0, shared / F.greatest(joint, F.lit(1))).otherwise(F.lit(0.0))
