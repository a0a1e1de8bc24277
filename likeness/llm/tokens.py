"""Token ids of whole texts, by the tokenizers library.

The word tokenizer never joins anything across ASCII white space: its regular
expression matches none, normal forms don't compose over it, and the special
strings hold none. Neither does it join an ASCII letter with a mark of ``STOPS``
behind it. So a text's ids are those of its words and stops in order, and a word
is given to the library once and then remembered.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from likeness.llm.batches import kept

#: The file of the word tokenizer; any other place can be given.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: Words in one of the two generations that a worker remembers, and the longest one.
REMEMBERED, LONGEST = 300_000, 64
#: Bytes of text whose new words go to the library together.
TOGETHER = 3 << 20
STOPS = b".,;:!?"


class WordEncoder:
    """Ids of texts, packed as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._library = Tokenizer.from_file(path)
        # The same model without the steps that leave words of small ASCII letters as they are.
        self._letters_only = Tokenizer(self._library.model)
        self._letters_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = " ".join(["the", "a", "zq", "qxj", "unbelievably", "rstlne" * 9])
        if self._ids(self._letters_only, probe) != self._ids(self._library, probe):
            self._letters_only = self._library
        size = self._library.get_vocab_size()
        self._last = np.asarray([(self._library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def packed(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """The ids of each text; null gives none."""
        group, held = [], 0
        for text in texts:
            text = text or b""
            group.append(text)
            held += len(text)
            if held > TOGETHER:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        # Lower case is the tokenizer's own first step; special strings and composed letters would differ.
        split = pc.ascii_split_whitespace(_parted([t.lower() if t.isascii() and b"<|" not in t else t for t in texts]))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()  # each different word of the group once
        self._learn(set(words) - {b""})
        known = self._known
        known[b""] = b""  # white space at an end
        ids = list(map(known.__getitem__, words))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ids, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        runs = sizes[which]
        ends = np.concatenate([[0], np.cumsum(runs)])
        places = np.repeat(starts[which] - ends[:-1], runs) + np.arange(ends[-1])
        packed = ids[places].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        for start, stop in zip(bounds, bounds[1:]):
            yield packed[start:stop]
        for word in [w for w in words if len(w) > LONGEST]:
            del known[word]
        if len(known) > REMEMBERED:
            self._known, self._older = {}, known

    def _learn(self, words: set[bytes]) -> None:
        known, older = self._known, self._older
        new = words.difference(known)
        again = [w for w in new if w in older]
        known.update(zip(again, map(older.__getitem__, again)))
        new.difference_update(again)
        parts, wanted = {}, set()
        for word in [w for w in new if w[-1] in STOPS]:
            stem = word.rstrip(STOPS)
            if stem and stem[-1:].isalpha():
                parts[word] = stem, word[len(stem):]
                wanted.update(parts[word])
        new.difference_update(parts)
        new.update(wanted.difference(known))
        fresh = self._letters(new)
        if len(fresh) < len(new):
            fresh |= self._others([w for w in new if w not in fresh])
        known.update(fresh)  # the caller forgets long ones
        for word, (stem, stop) in parts.items():
            known[word] = known[stem] + known[stop]
        for stem, _ in parts.values():
            if len(stem) > LONGEST and stem not in words:
                known.pop(stem, None)

    def _letters(self, missing: Iterable[bytes]) -> dict[bytes, bytes]:
        """The words of letters only, encoded in one text: each ends with the first id that ends a word."""
        ascii_words = [w for w in missing if w.isalpha()]  # of bytes: ASCII letters
        small = [w for w in ascii_words if w.islower()]
        others = [w for w in ascii_words if not w.islower()] if len(small) < len(ascii_words) else []
        others += [w for w in missing if not w.isascii() and _composed(w.decode())]
        return self._apart(self._letters_only, small) | self._apart(self._library, others)

    def _apart(self, library, words: list[bytes]) -> dict[bytes, bytes]:
        ids = np.asarray(self._ids(library, b" ".join(words).decode()), "<u4")
        ends = (4 * (np.flatnonzero(self._last[ids]) + 1)).tolist() if len(ids) else []
        if len(ends) != len(words):  # a tokenizer without marked word ends
            return {}
        data, starts = ids.tobytes(), [0, *ends[:-1]]
        return {w: data[a:b] for w, a, b in zip(words, starts, ends)}

    def _others(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Any words, encoded in one text with a word of one id between them, that none of them holds."""
        between, fresh = b"the", {}
        mark = self._ids(self._library, between.decode())
        joined = [w for w in words if between not in w.lower()] if len(mark) == 1 else []
        if joined:
            ids = np.asarray(self._ids(self._library, b" the ".join(joined).decode()), "<u4")
            ends = (4 * np.flatnonzero(ids == mark[0])).tolist()
            if len(ends) == len(joined) - 1:
                data = ids.tobytes()
                fresh = {w: data[a:b] for w, a, b in zip(joined, [0, *(x + 4 for x in ends)], [*ends, len(data)])}
        left = [w for w in words if w not in fresh]
        for word, found in zip(left, self._library.encode_batch_fast([w.decode() for w in left], add_special_tokens=False)):
            fresh[word] = np.asarray(found.ids, "<u4").tobytes()
        return fresh

    @staticmethod
    def _ids(library, text: str) -> list[int]:
        return library.encode_batch_fast([text], add_special_tokens=False)[0].ids


_BEFORE, _STOP, _AFTER = (np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(own, np.uint8)) for own in (
    bytes(range(ord("a"), ord("z") + 1)), STOPS, b" \n"))


def _parted(texts: list[bytes]) -> pa.Array:
    """The texts with a blank between a small ASCII letter and a single stop before white space.

    The word and the stop are separate matches of the tokenizer either way; so a
    word is remembered once and not once for each stop behind it.
    """
    data = np.frombuffer(b"\n".join([*texts, b"\n"]), np.uint8)
    at = np.flatnonzero(_STOP[data[1:-1]] & _BEFORE[data[:-2]] & _AFTER[data[2:]]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])  # a text keeps the line feed behind it
    ends += np.searchsorted(at, ends)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(np.insert(data, at, 32)))


def _composed(word: str) -> bool:
    """Letters only, in the normal form that the tokenizer makes: one match of its regular expression."""
    return word.isalpha() and unicodedata.is_normalized("NFC", word)


def word_encoder(path: str) -> WordEncoder:
    """The Python worker's encoder, until it turns to something else."""
    return kept(("words", path), lambda: WordEncoder(path))
