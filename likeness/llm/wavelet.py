"""Token ids as one wavelet matrix per shard.

A shard's file holds the ids of consecutive documents as one bit plane per bit
of an id. In each plane the bits are those of the ids in the order the planes
above left them (zeros first, then ones), with a count of ones for every 512
bits. That is enough to read any token, count an id in any range and find its
k-th occurrence without unpacking the rest.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likeness.llm.batches import by_bytes
from likeness.llm.tokens import WORD_BPE, word_encoder
from likeness.session import scratch_path

#: Id appended to each document.
END_ID = 1
#: Bytes of text that are encoded at once.
AT_ONCE = 3 << 20
#: Tokens after which a task closes a shard (at the end of a document).
SHARD_TOKENS = 1 << 20
#: Bits between two stored counts of ones.
STEP = 512
HEADER = struct.Struct("<4sBQ")


class WaveletMatrix:
    """Rank and select over a sequence of unsigned integers."""

    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray]):
        self.n, self.planes, self.counts = n, planes, counts
        #: Zeros in each plane, where its ones begin in the next one.
        self.zeros = [n - int(c[-1]) for c in counts]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, counts = [], []
        for k in reversed(range(width)):
            bit = (now & now.dtype.type(1 << k)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            counts.append(_directory(packed, len(ids)))
            following, zeros = np.empty_like(now), len(now) - int(counts[-1][-1])
            np.compress(~bit, now, out=following[:zeros])
            np.compress(bit, now, out=following[zeros:])
            now = following
        return cls(len(ids), planes, counts)

    def to_bytes(self) -> bytes:
        parts = [HEADER.pack(b"WVM1", len(self.planes), self.n)]
        for plane, count in zip(self.planes, self.counts):
            parts += [plane.tobytes(), count.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        kind, width, n = HEADER.unpack_from(data)
        if kind != b"WVM1":
            raise ValueError("not a wavelet matrix")
        at, size, steps = HEADER.size, (n + 7) // 8, -(-n // STEP) + 1
        planes, counts = [], []
        for _ in range(width):
            planes.append(np.frombuffer(data, np.uint8, size, at))
            counts.append(np.frombuffer(data, "<u4", steps, at + size))
            at += size + 4 * steps
        return cls(n, planes, counts)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        step = i // STEP
        found = int(self.counts[k][step])
        rest = self.planes[k][step * STEP // 8:(i + 7) // 8]
        if len(rest):
            found += int(np.unpackbits(rest, bitorder="little")[: i - step * STEP].sum())
        return found

    def _bit(self, k: int, i: int) -> int:
        return self.planes[k][i // 8] >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit = int(self._bit(k, i))
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences within [start, end) stand below the last plane."""
        if token >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._ones(k, start), self._ones(k, end)
            if token >> (len(self.planes) - 1 - k) & 1:
                start, end = self.zeros[k] + a, self.zeros[k] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` in positions [start, end)."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0); -1 if there are fewer."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for p in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - p) & 1
            i = self._place(p, bit, i - self.zeros[p] if bit else i)
        return i

    def _place(self, p: int, bit: int, k: int) -> int:
        """Position of the ``k``-th bit of that value in plane ``p``."""
        counts = self.counts[p].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * STEP, self.n) - counts
        step = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[p][step * STEP // 8:(step + 1) * STEP // 8], bitorder="little")
        return step * STEP + int(np.flatnonzero(bits[: self.n - step * STEP] == bit)[k - int(counts[step])])

    def positions(self, token: int) -> list[int]:
        """All places of ``token``, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """The whole sequence, by undoing the planes from the last to the first."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(now)
            before[~bit] = now[: self.zeros[k]]
            before[bit] = now[self.zeros[k]:] | now.dtype.type(1 << (len(self.planes) - 1 - k))
            now = before
        return now


def _directory(packed: np.ndarray, n: int) -> np.ndarray:
    ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (STEP // 8)))).reshape(-1, STEP // 8).sum(1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4") if n else np.zeros(1, "<u4")


SHARDS = "part long, shard long, docs long, tokens long, doc_ids binary, lengths binary, present binary, matrix binary"


def _shards(path: str, end_id: int, shard_tokens: int):
    def build(batches):
        encode, part, shard = word_encoder(path).packed, TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4").tobytes()
        ids, keys, tokens = [], [], 0

        def closed():
            lengths = np.asarray([len(x) // 4 for x in ids], "<i8")
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"))
            return pd.DataFrame([{
                "part": part, "shard": shard, "docs": len(ids), "tokens": int(lengths.sum()),
                "doc_ids": np.asarray([k or 0 for k in keys], "<i8").tobytes(), "lengths": lengths.tobytes(),
                "present": np.asarray([k is not None for k in keys]).tobytes(),
                "matrix": zstandard.ZstdCompressor(level=1).compress(matrix.to_bytes())}])

        for batch in by_bytes(batches, "text", AT_ONCE):
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                keys.append(doc_id)
                ids.append(packed + end)
                tokens += len(ids[-1]) // 4
                if tokens >= shard_tokens:
                    yield pa.RecordBatch.from_pandas(closed(), preserve_index=False)
                    ids, keys, tokens, shard = [], [], 0, shard + 1
        if ids:
            yield pa.RecordBatch.from_pandas(closed(), preserve_index=False)

    return build


def write_shards(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = END_ID,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode whole texts and write their wavelet matrices below ``path`` in ascending doc_id order.

    A row is a shard: (part, shard) ascending is the order of documents. Null
    doc_ids come first; rows that repeat a doc_id are ordered by their text's
    hash and all stay; null text is empty and only has the end id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _shards(tokenizer, end_id, shard_tokens), SHARDS).write.parquet(path)


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = WaveletMatrix.from_bytes(zstandard.decompress(row["matrix"])).decode().astype("<u4")
            lengths = np.frombuffer(row["lengths"], "<i8")
            ends = np.cumsum(lengths)
            data = memoryview(ids.tobytes())
            keys = np.frombuffer(row["doc_ids"], "<i8")
            present = np.frombuffer(row["present"], bool)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64(), mask=~present), pa.array(row["base"] + ends - lengths), pa.array(lengths),
                pa.array([zlib.crc32(data[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                pa.array(np.full(len(keys), row["part"])), pa.array(np.full(len(keys), row["shard"]))],
                ["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard"])


def read_documents(spark, path: str) -> DataFrame:
    """Per document, from the files: place of its first id, number and checksum of its ids, its shard."""
    shards = spark.read.parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each write task
    parts = sizes.select("part", F.coalesce(F.sum("tokens").over(below), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    heads = shards.select("part", "shard", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("inside"))
    base = heads.join(parts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("base"))
    return shards.join(base, ["part", "shard"]).mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long, part long, shard long")


def encoded_documents(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = END_ID,
                      shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards to a table of the shared folder and read the documents back."""
    path = scratch_path(docs.sparkSession, "wavelet")
    write_shards(docs, path, tokenizer, end_id, shard_tokens)
    return read_documents(docs.sparkSession, path)


def occurrences(spark, path: str, token: int) -> DataFrame:
    """(part, shard, position) of every place of ``token``, looked up in the compressed files."""
    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = WaveletMatrix.from_bytes(zstandard.decompress(row["matrix"])).positions(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(at), pa.int64()), pa.array([row["shard"]] * len(at), pa.int64()),
                     pa.array(at, pa.int64())], ["part", "shard", "position"])

    return spark.read.parquet(path).select("part", "shard", "matrix").mapInArrow(
        look, "part long, shard long, position long")
