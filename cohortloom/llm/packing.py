"""Order-preserving packing of documents into windows of at most ``width`` tokens.

The documents of a range of ids form one stream. Cuts are chosen by dynamic
programming over document ends, sentence ends and, where neither occurs for
``GRID`` tokens, places on a grid. Each window costs its padding, each cut the
penalty of its place. With ``g(i) = f(i) + place(i)`` the best predecessor of a cut
is the least ``g`` among the cuts within ``width`` before it, which a monotone queue
gives in constant time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import bounded_batches, by_size, giving_back, partitions
from cohortloom.llm.tokens import END_ID, crc32_ids, encoded, tokenizer_path, word_encoder

WIDTH = 4096
SENTENCE_PENALTY = 2.0
GRID = 32
GRID_PENALTY = 8.0
CHUNK_TOKENS = 1 << 20
PIECES_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)


def best_cuts(places: list[int], penalties: list[float], width: int) -> list[int]:
    """Positions in ``places`` of the cheapest cuts from the first place to the last.

    ``places`` ascend and no two neighbours are further apart than ``width``. A cut
    costs its penalty, but for the first and last; a window costs ``width`` less
    its length, the last one what ``rest_cost`` says. Of equal costs the earlier
    predecessor wins.
    """
    n = len(places)
    if n < 2:
        return list(range(n))
    g = [0.0] * n
    came = [0] * n
    g[0] = places[0]
    queue = deque([0])
    last = n - 1
    for j in range(1, last):
        at = places[j]
        while at - places[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        came[j] = i
        # f(j) + place(j): the places cancel.
        value = g[i] + width + penalties[j]
        g[j] = value
        while queue and g[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    near = range(bisect_left(places, places[last] - width, 0, last), last)
    came[last] = min(near, key=lambda i: g[i] - places[i] + rest_cost(places[last] - places[i], width))
    cuts = [last]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Allowed places ``0 .. len(ids)`` and their penalties."""
    grid = min(GRID, width)
    sentences = np.flatnonzero(sentence_end[ids]) + 1
    places = np.union1d(np.union1d(sentences, doc_ends), [0, len(ids)])
    wide = np.flatnonzero(np.diff(places) > grid)
    more = [np.arange(places[k] + grid, places[k + 1], grid) for k in wide]
    penalties = np.full(len(places), SENTENCE_PENALTY)
    penalties[np.isin(places, doc_ends)] = 0.0
    if more:
        added = np.concatenate(more)
        places, penalties = np.append(places, added), np.append(penalties, np.full(len(added), GRID_PENALTY))
        order = np.argsort(places, kind="stable")
        places, penalties = places[order], penalties[order]
    return places, penalties


def rest_cost(length: int, width: int) -> float:
    """Padding and penalties of a last window once ``power_cuts`` has cut it."""
    cuts = power_cuts(length, width)
    left = length - (cuts[-1] if cuts else 0)
    return GRID_PENALTY * len(cuts) + (width - left if left & (left - 1) else 0)


def power_cuts(length: int, width: int) -> list[int]:
    """Cuts of a last window into lengths that need no padding, while one saves more than it costs."""
    cuts, left = [], length
    while left and width - left > GRID_PENALTY and left & (left - 1):
        size = 1 << (left.bit_length() - 1)
        cuts.append((cuts[-1] if cuts else 0) + size)
        left -= size
    return cuts


@lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether it is made of signs, one of them a full stop, ``!`` or ``?``, and ends a word."""
    vocabulary = word_encoder(path).tokenizer.get_vocab()
    ends = np.zeros(1 << 16, bool)
    for token, k in vocabulary.items():
        word = token.removesuffix("</w>")
        ends[k] = word != token and any(c in ".!?" for c in word) and not any(c.isalnum() for c in word)
    return ends


class Packer:
    """Packs one ordered stream; ``take`` and ``finish`` return finished pieces."""

    def __init__(self, sentence_end: np.ndarray, width: int, keep_ids: bool):
        self.sentence_end, self.width, self.keep_ids = sentence_end, width, keep_ids
        self.kept: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens, tokens before this chunk
        self.size = self.sequences = 0

    def take(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc, len(ids), 0))
        self.kept.append(ids)
        self.size += len(ids)

    def pieces(self, finish: bool, part: int) -> pa.RecordBatch:
        ids = np.concatenate(self.kept)
        lengths = np.array([len(k) for k in self.kept])
        doc_ends = np.cumsum(lengths)
        doc_starts = doc_ends - lengths
        # A document's last id is its end; a rest carried over ends there too.
        places, penalties = cut_places(ids, doc_ends, self.sentence_end, self.width)
        cuts = places[best_cuts(places.tolist(), penalties.tolist(), self.width)]
        if finish:
            rest = [c + int(cuts[-2]) for c in power_cuts(int(cuts[-1] - cuts[-2]), self.width)]
            cuts = np.unique(np.append(cuts, np.array(rest, np.int64)))
        stop = int(cuts[-1] if finish or len(cuts) < 3 else cuts[-2])
        borders = np.union1d(doc_starts, cuts)
        first = borders[borders < stop]
        last = np.append(first[1:], stop)
        which = np.searchsorted(doc_starts, first, side="right") - 1
        window = np.searchsorted(cuts, first, side="right") - 1
        before = np.array([d[2] for d in self.docs])[which]
        columns = {
            "doc_id": pa.array([self.docs[k][0] for k in which], pa.int64()),
            "start": pa.array(first - doc_starts[which] + before, pa.int64()),
            "length": pa.array(last - first, pa.int64()),
            "ids_crc32": pa.array([crc32_ids(ids[a:b]) for a, b in zip(first.tolist(), last.tolist())], pa.int64()),
            "doc_tokens": pa.array(np.array([d[1] for d in self.docs])[which], pa.int64()),
            "sequence_id": pa.array((part << 33) + self.sequences + window, pa.int64()),
            "offset": pa.array(first - cuts[window], pa.int64()),
        }
        if self.keep_ids:
            columns["ids"] = pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(first, last)], pa.binary())
        self.sequences += int(np.searchsorted(cuts, stop))
        # What follows the last finished window goes on with the next chunk.
        open_docs = np.flatnonzero(doc_ends > stop)
        self.kept = [ids[max(int(doc_starts[k]), stop) : int(doc_ends[k])] for k in open_docs]
        self.docs = [
            (self.docs[k][0], self.docs[k][1], self.docs[k][2] + max(0, stop - int(doc_starts[k]))) for k in open_docs
        ]
        self.size = sum(map(len, self.kept))
        return pa.RecordBatch.from_pydict(columns)


def pack(docs: DataFrame, path: str | None = None, width: int = WIDTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs (doc_id, text)``, packed in the order of their ids.

    Every id of a document, with ``end_id`` after them, lies in one piece. A
    sequence holds at most ``width`` tokens and its pieces follow each other without
    gaps. Only the last window of a range of ids may be cut into sequences whose
    lengths are powers of two. A null text is empty (its end id alone); rows without
    an id come first; rows of one id are documents of their own; no rows give none.
    ``keep_ids`` adds the piece's ids as little-endian unsigned 32-bit integers.
    """
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = Packer(sentence_ends(path), width, keep_ids)
        for batch in by_size(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text").to_pylist(), path, end_id)):
                packer.take(doc, ids)
                if packer.size >= CHUNK_TOKENS:
                    yield packer.pieces(False, part)
        if packer.size:
            yield packer.pieces(True, part)

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        # The text parts the rows of one id, or of none.
        .repartitionByRange(partitions(docs.sparkSession), F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    )
    return ordered.mapInArrow(giving_back(run), PIECES_SCHEMA + (", ids binary" if keep_ids else ""))
