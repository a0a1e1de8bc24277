"""Sentence pieces with the span of source bytes that each one stands for.

Text is normalised by the longest prefix that the model's compiled character map
holds, byte by byte with a record of where each came from. Pieces of the
normalised text are then projected back to the original bytes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The file of the piece model; any other place can be given.
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Chunks in one of the two generations that a worker remembers, and the longest one.
REMEMBERED, LONGEST = 250_000, 64
#: Texts whose new chunks go to the library together.
TOGETHER = 256
#: Bytes of text in one batch of results, one text at least: spans take several times the text.
AT_ONCE = 1 << 20
SPACE = "▁".encode()


class CharacterMap:
    """The compiled map of a model: a double array of source strings, then their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self._units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self._out = blob[4 + size:]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """(replacement, source bytes) of the longest source string at ``at``; one character if there is none."""
        found, length = None, 0
        if self._units:
            units, node = self._units, 0
            node ^= _offset(units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                unit = units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= _offset(unit)
                if unit >> 8 & 1:
                    found, length = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is not None:
            return self._out[found:self._out.index(b"\0", found)], length
        first = data[at]
        length = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at:at + length], length


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


class PieceEncoder:
    """Encode and decode as the library does, with source spans.

    The library itself picks the pieces: it is given normalised text under a copy
    of the model whose own normalisation is off. Where no piece holds a space mark
    behind another character, normalised text is cut before its marks, and a
    chunk's ids are asked for once and remembered.
    """

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if path else \
            sentencepiece.SentencePieceProcessor(model_proto=proto)
        model = pb.ModelProto()
        model.ParseFromString(proto or self.library.serialized_model_proto())
        self.rules = pb.NormalizerSpec()
        self.rules.CopyFrom(model.normalizer_spec)
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.remove_extra_whitespaces = False
        model.normalizer_spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        mark, size = SPACE.decode(), self.plain.get_piece_size()
        self._by_chunk = not any(mark in p.piece.lstrip(mark) for p in model.pieces)
        #: Bytes of normalised text that a piece stands for; byte pieces stand for one.
        self._wide = np.asarray([1 if self.plain.is_byte(i) else len(self.plain.id_to_piece(i).encode()) for i in range(size)])
        self._unknown = self.plain.unk_id()
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the source byte it stands for."""
        rules, at = self.rules, 0
        tidy, space = rules.remove_extra_whitespaces, SPACE if rules.escape_whitespaces else b" "
        if not (self.map or tidy):  # every character stands for itself
            source = np.frombuffer(text, np.uint8)
            starts = np.maximum.accumulate(np.where(source & 0xC0 == 0x80, 0, np.arange(len(text))))
            origin = np.repeat(starts, np.where(source == 32, len(space), 1))
            dummy = len(space) if rules.add_dummy_prefix and text else 0
            return space * (dummy > 0) + text.replace(b" ", space), np.concatenate(
                [np.zeros(dummy, np.int64), origin, [len(text)]]).astype(np.int64)
        out, origin = bytearray(), []
        while tidy and at < len(text):
            piece, n = self.map.longest(text, at)
            if piece != b" ":
                break
            at += n
        if at == len(text):
            return b"", np.asarray([at])
        if rules.add_dummy_prefix:
            out += space
            origin += [at] * len(space)
        spaced = tidy
        while at < len(text):
            piece, n = self.map.longest(text, at)
            if spaced:
                piece = piece.lstrip(b" ")
            now = piece.replace(b" ", space)
            out += now
            origin += [at] * len(now)
            if piece:
                spaced = tidy and piece.endswith(b" ")
            at += n
        end = at
        while tidy and out.endswith(space):
            end = origin[len(out) - len(space)]
            del out[-len(space):], origin[-len(space):]
        return bytes(out), np.asarray([*origin, end])

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids and their (begin, end) source bytes, without begin and end ids."""
        for start in range(0, len(texts), TOGETHER):
            normal = [self.normalise(t) for t in texts[start:start + TOGETHER]]
            chunks = [_chunks(n) if self._by_chunk else [n] for n, _ in normal]
            every = set().union(*chunks)
            self._learn(every)
            look = self._known.__getitem__
            for (_, origin), own in zip(normal, chunks):
                ids = np.frombuffer(b"".join(map(look, own)), "<u4")
                wide = self._wide[ids]
                if (ids == self._unknown).any():  # of any width; only where a model has no byte pieces
                    wide = np.concatenate([self._widths(c) for c in own])
                bounds = np.concatenate([[0], np.cumsum(wide)])
                yield ids, np.stack([origin[bounds[:-1]], origin[bounds[1:]]], 1)
            for chunk in every:
                if len(chunk) > LONGEST:
                    del self._known[chunk]
            if len(self._known) > REMEMBERED:
                self._known, self._older = {}, self._known

    def _widths(self, chunk: bytes) -> list[int]:
        """Bytes of normalised text of each piece, as the library gives them."""
        found = self.plain.encode(chunk.decode("utf-8", "replace"), out_type="proto")
        return [len(p.surface.encode()) for p in found.pieces]

    def _learn(self, chunks: set[bytes]) -> None:
        new = [c for c in chunks if c not in self._known]
        self._known.update((c, self._older[c]) for c in new if c in self._older)
        asked = [c for c in new if c not in self._known]
        found = self.plain.encode([c.decode("utf-8", "replace") for c in asked], num_threads=1)
        self._known.update((c, np.asarray(ids, "<u4").tobytes()) for c, ids in zip(asked, found))


def _chunks(normal: bytes) -> list[bytes]:
    """Normalised text cut before each run of space marks."""
    parts = normal.split(SPACE)
    if b"" not in parts[1:]:
        return [p for p in parts[:1] if p] + [SPACE + p for p in parts[1:]]
    out, marks = [p for p in parts[:1] if p], b""
    for part in parts[1:]:
        marks += SPACE
        if part:
            out.append(marks + part)
            marks = b""
    return [*out, marks] if marks else out


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each file and Python worker."""
    return PieceEncoder(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column("text")).to_pylist()])
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _encoded(path: str):
    def encode(batches):
        encoder = piece_encoder(path)
        begin, end = encoder.library.bos_id(), encoder.library.eos_id()
        for batch in itertools.chain.from_iterable(map(_slices, batches)):
            ids, spans, decoded = [], [], []
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for text, (own, where) in zip(texts, encoder.encode(texts)):
                whole = np.concatenate([[begin], own, [end]]).astype("<u4")
                n = len(text)
                ids.append(whole.tobytes())
                spans.append(np.concatenate([[[0, 0]], where, [[n, n]]]).astype("<i8").tobytes())
                decoded.append(encoder.library.decode(whole.tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(spans, pa.binary()), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "spans", "decoded"])

    return encode


def encoded(docs: DataFrame, model: str = PIECE_BPE) -> DataFrame:
    """doc_id, ids, spans and the decoded text of every row and whole text.

    ``ids`` are little-endian 32-bit integers with begin and end ids; ``spans`` are
    pairs of little-endian 64-bit byte positions, one for each id (the begin id is
    empty at 0, the end id at the end). Null text is empty. Rows are not moved;
    null and repeated doc_ids stay as they are; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _encoded(model), "doc_id long, ids binary, spans binary, decoded string")
