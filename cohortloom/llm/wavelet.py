"""Token ids in wavelet-matrix files: access, counting and search in one compressed file.

A shard file holds the documents' ids and lengths and one bit plane per bit of a
token id, most significant first. A plane is cut into chunks of 32,768 bits, packed
one by one; a directory in front of them has each chunk's place and the number of ones
before it. ``ShardReader`` answers lookups by reading the directory and the chunks it
needs. In memory a plane has the running number of ones at every 512th bit.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import by_size, new_folder, partitions
from cohortloom.llm.tokens import END_ID, crc32_ids, encoded, tokenizer_path
from cohortloom.session import stage

MAGIC = b"WVM2"
HEADER = struct.Struct("<4sqqqqqi")
BLOCK = 512
CHUNK = 1 << 15
HELD_CHUNKS = 256
KEY_CHARS = 256
SHARD_TOKENS = 1 << 20
SHARDS_SCHEMA = "part int, shard int, n_docs long, n_tokens long"
PLACES_SCHEMA = "token_id long, doc_id long, part int, shard int, doc int, place long"
COUNTS_SCHEMA = "token_id long, n long"
DOCS_SCHEMA = "doc_id long, part int, first long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """A sequence of unsigned integers below ``2 ** levels`` as ranked bit planes."""

    def __init__(self, size: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.size, self.planes, self.ranks, self.zeros = size, planes, ranks, zeros

    @classmethod
    def build(cls, values: np.ndarray, levels: int = 16) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        values = np.asarray(values)
        for level in range(levels):
            bits = (values >> (levels - 1 - level)) & 1 != 0
            plane = np.packbits(bits, bitorder="little")
            plane = np.append(plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8))
            ones = np.bitwise_count(plane.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            zeros.append(int(len(values) - ranks[-1][-1]))
            values = np.concatenate([values[~bits], values[bits]])
        return cls(int(len(values)), planes, ranks, zeros)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK)
        held = self.planes[level][block * BLOCK // 8 : block * BLOCK // 8 + (rest + 7) // 8]
        part = int(np.bitwise_count(held).sum())
        if rest & 7:
            part -= int(held[-1] >> (rest & 7)).bit_count()
        return int(self.ranks[level][block]) + part

    def access(self, i: int) -> int:
        """The value at place ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, end: int) -> int:
        """How often ``value`` occurs before place ``end``."""
        low, high = 0, min(max(end, 0), self.size)
        for level, zeros in enumerate(self.zeros):
            low_ones, high_ones = self._ones(level, low), self._ones(level, high)
            if value >> (len(self.zeros) - 1 - level) & 1:
                low, high = zeros + low_ones, zeros + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def select(self, value: int, k: int) -> int:
        """The place of occurrence number ``k`` of ``value``, counted from 0; -1 if there are fewer."""
        if not 0 <= k < self.count(value):
            return -1
        start = 0
        for level, zeros in enumerate(self.zeros):
            ones = self._ones(level, start)
            start = zeros + ones if value >> (len(self.zeros) - 1 - level) & 1 else start - ones
        at = start + k
        for level in reversed(range(len(self.zeros))):
            if value >> (len(self.zeros) - 1 - level) & 1:
                at = self._select_bit(level, at - self.zeros[level], True)
            else:
                at = self._select_bit(level, at, False)
        return at

    def _select_bit(self, level: int, k: int, bit: bool) -> int:
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        held = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(held == bit)[k - before[block]])

    def values(self) -> np.ndarray:
        """The whole sequence, by undoing the stable partition of each plane from the last."""
        out = np.zeros(self.size, np.uint32)
        for level in reversed(range(len(self.zeros))):
            ones = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            before = np.empty_like(out)
            before[~ones] = out[: self.zeros[level]]
            before[ones] = out[self.zeros[level] :] | np.uint32(1 << (len(self.zeros) - 1 - level))
            out = before
        return out

    def to_bytes(self) -> list[bytes]:
        """The zeros of each plane, the directory, and the packed chunks plane by plane."""
        chunks = []
        for plane in self.planes:
            for at in range(0, len(plane), CHUNK // 8):
                raw = plane[at : at + CHUNK // 8].tobytes()
                packed = squeezed(raw)
                # A chunk of its full length is not packed.
                chunks.append(packed if len(packed) < len(raw) else raw)
        ends = np.cumsum([0, *map(len, chunks)])
        ones = [ranks[:-1][:: CHUNK // BLOCK] for ranks in self.ranks]
        head = [np.array(self.zeros, "<i8"), ends.astype("<i8"), np.array(ones, "<u4")]
        return [*(h.tobytes() for h in head), *chunks]

    @classmethod
    def from_bytes(cls, data: memoryview, size: int, levels: int) -> WaveletMatrix:
        directory = Directory(data, size, levels)
        planes, ranks = [], []
        for level in range(levels):
            parts = [directory.unpacked(level, c, data[slice(*directory.span(level, c))]) for c in range(directory.chunks)]
            plane = np.concatenate([np.empty(0, np.uint8), *parts])
            ones = np.bitwise_count(plane.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
            planes.append(plane)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
        return cls(size, planes, ranks, directory.zeros)


def squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(raw, asbytes=True)


class Directory:
    """Where the chunks of a wavelet matrix lie, counted from its first byte, and the ones before each."""

    def __init__(self, data: bytes | memoryview, size: int, levels: int):
        self.size, self.chunks = size, -(-size // CHUNK)
        at = 8 * levels
        self.zeros = np.frombuffer(data, "<i8", levels).tolist()
        n = levels * self.chunks
        self.places = np.frombuffer(data, "<i8", n + 1, at) + self.bytes(size, levels)
        self.ones = np.frombuffer(data, "<u4", n, at + 8 * (n + 1)).reshape(levels, self.chunks).astype(np.int64)

    @staticmethod
    def bytes(size: int, levels: int) -> int:
        n = levels * -(-size // CHUNK)
        return 8 * levels + 8 * (n + 1) + 4 * n

    def span(self, level: int, chunk: int) -> tuple[int, int]:
        k = level * self.chunks + chunk
        return int(self.places[k]), int(self.places[k + 1])

    def unpacked(self, level: int, chunk: int, stored: bytes | memoryview) -> np.ndarray:
        full = min(CHUNK, -(-self.size // BLOCK) * BLOCK - chunk * CHUNK) // 8
        return np.frombuffer(stored if len(stored) == full else pa.Codec("zstd").decompress(stored, full, asbytes=True), np.uint8)


class ShardReader:
    """Lookups in a shard file by ranged reads: the documents' lengths, the directory, and chunks as needed.

    ``file`` has ``read_at(n, offset)``. Of the chunks read, the last ``HELD_CHUNKS`` are kept.
    """

    def __init__(self, file):
        self.file = file
        magic, self.part, self.shard, self.first, n_docs, self.size, self.levels = HEADER.unpack(file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        docs = file.read_at(17 * n_docs, HEADER.size)
        known = np.frombuffer(docs, np.uint8, n_docs).astype(bool)
        ids = np.frombuffer(docs, "<i8", n_docs, n_docs)
        self.doc_ids = pa.array(ids, pa.int64(), mask=~known)
        lengths = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
        self.starts = np.cumsum(lengths) - lengths
        self.base = HEADER.size + 17 * n_docs
        self.directory = Directory(file.read_at(Directory.bytes(self.size, self.levels), self.base), self.size, self.levels)
        self.zeros = self.directory.zeros
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, level: int, chunk: int) -> np.ndarray:
        packed = self.held.pop((level, chunk), None)
        if packed is None:
            low, high = self.directory.span(level, chunk)
            packed = self.directory.unpacked(level, chunk, self.file.read_at(high - low, self.base + low))
        self.held[level, chunk] = packed
        if len(self.held) > HELD_CHUNKS:
            del self.held[next(iter(self.held))]
        return np.unpackbits(packed, bitorder="little")

    def _ones(self, level: int, i: int) -> int:
        chunk, rest = divmod(i, CHUNK)
        if i == self.size:
            return self.size - self.zeros[level]
        before = int(self.directory.ones[level, chunk])
        return before + int(self._bits(level, chunk)[:rest].sum()) if rest else before

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self._bits(level, i // CHUNK)[i % CHUNK])
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before place ``end`` lie below the last plane."""
        low, high = 0, min(max(end, 0), self.size)
        if value < 0 or value >> self.levels:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            if low == high:
                return 0, 0
            ones = self._ones(level, low), self._ones(level, high)
            if value >> (self.levels - 1 - level) & 1:
                low, high = zeros + ones[0], zeros + ones[1]
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def rank(self, value: int, end: int) -> int:
        """How often ``value`` occurs before place ``end``."""
        low, high = self._range(value, end)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.size)

    def locate(self, value: int) -> np.ndarray:
        """All places of ``value``, ascending: its run below the last plane, followed up through the planes."""
        at = np.arange(*self._range(value, self.size))
        for level in reversed(range(self.levels)):
            bit = value >> (self.levels - 1 - level) & 1
            at = self._select(level, at - self.zeros[level] if bit else at, bit)
        return at

    def _select(self, level: int, ks: np.ndarray, bit: int) -> np.ndarray:
        before = self.directory.ones[level]
        before = before if bit else np.arange(len(before)) * CHUNK - before
        chunks = np.searchsorted(before, ks, side="right") - 1
        out = np.empty(len(ks), np.int64)
        for c in np.unique(chunks).tolist():
            own = chunks == c
            out[own] = c * CHUNK + np.flatnonzero(self._bits(level, c) == bit)[ks[own] - before[c]]
        return out


def shard_bytes(part: int, shard: int, first: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> list[bytes]:
    """A shard file. ``first``: tokens of the same part before it."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    held = np.array([d or 0 for d in doc_ids], "<i8")
    head = HEADER.pack(MAGIC, part, shard, first, len(doc_ids), len(ids), 16)
    return [head, known.tobytes(), held.tobytes(), np.array(lengths, "<i8").tobytes(), *WaveletMatrix.build(ids).to_bytes()]


def read_shard(data: bytes) -> tuple[int, int, int, list[int | None], np.ndarray, WaveletMatrix]:
    """``(part, shard, first, doc_ids, lengths, tokens)`` of a shard file."""
    magic, part, shard, first, n_docs, n_tokens, levels = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet shard")
    at = HEADER.size
    known = np.frombuffer(data, np.uint8, n_docs, at)
    doc_ids = np.frombuffer(data, "<i8", n_docs, at + n_docs).tolist()
    lengths = np.frombuffer(data, "<i8", n_docs, at + 9 * n_docs)
    matrix = WaveletMatrix.from_bytes(memoryview(data)[at + 17 * n_docs :], n_tokens, levels)
    return part, shard, first, [d if k else None for d, k in zip(doc_ids, known)], lengths, matrix


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs (doc_id, text)`` in ascending order of id into shard files in ``folder``.

    Returns one stored row per shard. A shard ends with the document that takes it
    to ``SHARD_TOKENS``. A null text is empty; rows without an id come first, and
    rows with one id are ordered by text.
    """
    from cohortloom.llm.common import write_file

    path = path or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, first = TaskContext.get().partitionId(), 0, 0
        doc_ids, kept, size = [], [], 0

        def flush():
            nonlocal shard, first, doc_ids, kept, size
            ids = np.concatenate(kept)
            write_file(folder, f"part-{part:06d}-{shard:06d}.wm", shard_bytes(part, shard, first, doc_ids, [len(k) for k in kept], ids))
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]}
            )
            shard, first, doc_ids, kept, size = shard + 1, first + len(ids), [], [], 0
            return row

        for batch in by_size(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text").to_pylist(), path, end_id)):
                doc_ids.append(doc)
                kept.append(ids)
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    # Rows of one id spread by how their texts begin, which agrees with the order by text; what
    # Spark samples for the ranges stays small.
    beginning = F.substring("text", 1, KEY_CHARS)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(partitions(docs.sparkSession), F.asc_nulls_first("doc_id"), F.asc_nulls_first(beginning))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    )
    return stage(ordered.mapInArrow(write, SHARDS_SCHEMA), "wavelet-shards")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the shard files: its tokens' checksum, number and place in its part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                part, _, first, doc_ids, lengths, matrix = read_shard(data.as_py())
                ids = matrix.values().astype("<u4")
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "part": pa.array([part] * len(doc_ids), pa.int32()),
                    "first": pa.array(first + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([crc32_ids(ids[e - n : e]) for e, n in zip(ends, lengths)], pa.int64()),
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    return files.select("content").mapInArrow(read, DOCS_SCHEMA)


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard file; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def _readers(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[ShardReader]:
    system, where = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            with system.open_input_file(f"{where}/{name}") as file:
                yield ShardReader(file)


def count_tokens(spark: SparkSession, folder: str, token_ids: list[int]) -> DataFrame:
    """``(token_id, n)``: how often each of ``token_ids`` occurs in the shard files, 0 included.

    A file gives up its directory and at most two chunks per plane and id. An empty folder
    or list gives no rows.
    """
    wanted = sorted(set(token_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reader in _readers(batches, folder):
            yield pa.RecordBatch.from_pydict({"token_id": pa.array(wanted, pa.int64()), "n": pa.array([reader.count(t) for t in wanted], pa.int64())})

    found = _shards(spark, folder).mapInArrow(run, COUNTS_SCHEMA)
    return found.groupBy("token_id").agg(F.sum("n").alias("n"))


def locate_tokens(spark: SparkSession, folder: str, token_ids: list[int]) -> DataFrame:
    """``(token_id, doc_id, part, shard, doc, place)`` of every occurrence of ``token_ids`` in the shard files.

    ``doc`` numbers the documents of a shard, so that rows of one id or without an id stay apart;
    ``place`` counts the document's tokens before. A file gives up the chunks that hold an
    occurrence or lie on its way through the planes; an id has at most a shard's tokens per batch.
    """
    wanted = sorted(set(token_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reader in _readers(batches, folder):
            for token in wanted:
                at = reader.locate(token)
                docs = np.searchsorted(reader.starts, at, side="right") - 1
                yield pa.RecordBatch.from_pydict({
                    "token_id": pa.array(np.full(len(at), token, np.int64)),
                    "doc_id": reader.doc_ids.take(pa.array(docs)),
                    "part": pa.array(np.full(len(at), reader.part, np.int32)),
                    "shard": pa.array(np.full(len(at), reader.shard, np.int32)),
                    "doc": pa.array(docs, pa.int32()),
                    "place": pa.array(at - reader.starts[docs]),
                })

    return _shards(spark, folder).mapInArrow(run, PLACES_SCHEMA)


def token_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents, read back from their shard files.

    ``start`` counts the tokens of all documents before. What goes through the
    driver is one number per partition. No documents give no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "wavelet")
    shards = write_tokens(docs, folder, path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    starts = spark.createDataFrame(offsets, "part int, offset long")
    return (
        read_tokens(spark, folder)
        .join(F.broadcast(starts), "part")
        .select("doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
    )
