"""Best-fit packing of whole documents by swap-based local search.

Pieces are dealt into groups of bounded size. A group is packed best-fit with falling
lengths; then its underfull bins are searched. The emptiest bin gives to fuller ones: it
moves a piece, exchanges one for a shorter one, one for two or two for one. Each step
carries tokens from an emptier to a fuller bin, so the sum of squared fills rises and the
search ends; a bin without pieces is gone. Bins that stay underfull are dealt anew, whole,
into fewer groups and searched again, until one group is left or nothing is gained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import by_size, partitions, sorted_groups
from cohortloom.llm.tokens import crc32_ids, encoded, tokenizer_path
from cohortloom.session import discard, stage, stage_measured

WIDTH = 4096
END_ID = 1
GROUP_PIECES = 1 << 14
#: Underfull bins that are searched against each other at a time.
SEARCHED = 256
#: The longest pieces of a bin that exchanges look at.
LOOKED_AT = 16
#: Bins whose room is at most this part of the width are not dealt to another group.
TIGHT = 1 / 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Bins of indices: each length, the longest first, into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(width + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[k]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
            bins[b].append(k)
        else:
            room, b = width, len(bins)
            bins.append([k])
        left = room - size
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins


class Search:
    """Local search among some bins of at most ``width``; ``bins`` lists the indices into ``lengths``."""

    def __init__(self, lengths: list[int], bins: list[list[int]], width: int):
        self.lengths, self.width = lengths, width
        self.bins = [sorted(b, key=lambda k: -lengths[k]) for b in bins]
        self.room = np.array([width - sum(lengths[k] for k in b) for b in self.bins], np.int64)
        # Bins grow by exchanges only where they hold few pieces, so the width of the tables stays.
        self.seen = min(LOOKED_AT, max(map(len, self.bins), default=1) + 2)
        self.one, self.two = np.triu_indices(self.seen, 1)
        self.singles = np.zeros((len(bins), self.seen), np.int64)
        self.pairs = np.zeros((len(bins), len(self.one)), np.int64)
        for b in range(len(bins)):
            self._changed(b)

    def _changed(self, b: int) -> None:
        held = [self.lengths[k] for k in self.bins[b][: self.seen]]
        row = np.zeros(self.seen, np.int64)
        row[: len(held)] = held
        self.singles[b] = row
        self.pairs[b] = np.where(row[self.two] > 0, row[self.one] + row[self.two], 0)

    def _put(self, giver: int, out: list[int], taker: int, back: list[int]) -> None:
        """``out`` of the giver's pieces for ``back`` of the taker's; both are places in their bins."""
        given, returned = [self.bins[giver][i] for i in out], [self.bins[taker][i] for i in back]
        carried = sum(self.lengths[k] for k in given) - sum(self.lengths[k] for k in returned)
        for b, gone, come in ((giver, out, returned), (taker, back, given)):
            kept = [k for i, k in enumerate(self.bins[b]) if i not in gone]
            self.bins[b] = sorted(kept + come, key=lambda k: -self.lengths[k])
        self.room[giver] += carried
        self.room[taker] -= carried
        for b in (giver, taker):
            self._changed(b)

    def _best_exchange(self, sizes: list[int], table: np.ndarray, others: np.ndarray) -> tuple[int, int, int, int]:
        """The greatest number of tokens that goes over, which of ``sizes``, for which column of ``table``, in which bin."""
        best = (0, 0, 0, 0)
        held = table[others]
        room = self.room[others][:, None]
        for i, size in enumerate(sizes):
            if size <= best[0]:
                continue
            over = size - held
            over[(held == 0) | (over > room)] = 0
            at = int(over.argmax())
            most = int(over.flat[at])
            if most > best[0]:
                best = (most, i, at % over.shape[1], int(others[at // over.shape[1]]))
        return best

    def step(self, giver: int) -> bool:
        """One step that carries tokens from ``giver`` to a bin at least as full; whether there is one."""
        others = np.flatnonzero((self.room > 0) & (self.room <= self.room[giver]))
        others = others[others != giver]
        if not len(others):
            return False
        room = self.room[others]
        for i, k in enumerate(self.bins[giver]):
            fits = np.where(room >= self.lengths[k], room, self.width + 1)
            at = int(fits.argmin())
            if fits[at] <= self.width:
                self._put(giver, [i], int(others[at]), [])
                return True
        sizes = [self.lengths[k] for k in self.bins[giver][: self.seen]]
        found = [
            (self._best_exchange(sizes, self.singles, others), "one for one"),
            (self._best_exchange(sizes, self.pairs, others), "one for two"),
        ]
        sums = [(i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes))]
        found.append((self._best_exchange([sizes[i] + sizes[j] for i, j in sums], self.singles, others), "two for one"))
        (carried, i, column, taker), kind = max(found, key=lambda f: f[0][0])
        if not carried:
            return False
        out = list(sums[i]) if kind == "two for one" else [i]
        back = [int(self.one[column]), int(self.two[column])] if kind == "one for two" else [column]
        self._put(giver, out, taker, back)
        return True

    def run(self, least: int) -> list[list[int]]:
        """The bins left once no bin, the emptiest asked first, can give anything or ``least`` bins are left."""
        left = len(self.bins)
        changed = True
        while changed:
            changed = False
            for giver in sorted(range(len(self.bins)), key=lambda b: -self.room[b]):
                if not self.bins[giver] or left <= least:
                    continue
                while self.bins[giver] and self.step(giver):
                    changed = True
                if not self.bins[giver]:
                    self.room[giver] = 0
                    left -= 1
        return [b for b in self.bins if b]


def least_bins(lengths: list[int], width: int) -> int:
    """A number of bins that no packing falls short of."""
    return max(-(-sum(lengths) // width), sum(2 * n > width for n in lengths))


def improved(lengths: list[int], bins: list[list[int]], width: int) -> list[list[int]]:
    """``bins`` after searching the underfull ones, in lots of ``SEARCHED``, until a turn over all lots empties no bin."""
    least = least_bins(lengths, width)
    rng = np.random.default_rng(len(bins))
    while True:
        rooms = [width - sum(lengths[k] for k in b) for b in bins]
        full = [b for b, room in zip(bins, rooms) if not room]
        under = [b for b, room in zip(bins, rooms) if room]
        # No lot can end with fewer bins than its tokens fill, nor all lots with fewer than ``least``.
        if len(bins) <= least or len(under) < 2:
            return bins
        order = rng.permutation(len(under))
        lots = np.array_split(order, -(-len(under) // SEARCHED))
        after = []
        for lot in lots:
            mine = [under[i] for i in lot]
            after += Search(lengths, mine, width).run(least_bins([lengths[k] for b in mine for k in b], width))
        gained = len(under) - len(after)
        bins = full + after
        if not gained or len(lots) == 1:
            return bins


def pieces_of(docs: DataFrame, path: str, width: int, end_id: int, keep_ids: bool) -> DataFrame:
    """A row for each piece of each document: runs of ``width`` ids, the last one as long as is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text").to_pylist(), path, end_id)):
                for piece, low in enumerate(range(0, len(ids), width)):
                    part = ids[low : low + width]
                    rows.append((doc, piece, low, len(part), crc32_ids(part), part.astype("<u4").tobytes() if keep_ids else None))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_pydict({
                n: pa.array(c, t) for n, c, t in zip(names, columns, kinds) if n != "ids" or keep_ids
            })

    schema = PIECES + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def searched(pieces: DataFrame, width: int) -> DataFrame:
    """``no, length, bin, offset, room`` after packing each ``group``; ``bin`` of the pieces is null or one to start from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, ("group",)):
            number = batch.column("group").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                group = batch.slice(low, high - low)
                lengths = group.column("length").to_pylist()
                known: dict[int, list[int]] = {}
                for k, b in enumerate(group.column("bin").to_pylist()):
                    known.setdefault(b, []).append(k)
                bins = best_fit(lengths, width) if None in known else list(known.values())
                bins = improved(lengths, bins, width)
                places = np.concatenate([np.array(b, np.int64) for b in bins])
                sizes = [[lengths[k] for k in b] for b in bins]
                offsets = np.concatenate([np.cumsum([0, *s[:-1]]) for s in sizes])
                counts = [len(b) for b in bins]
                yield pa.RecordBatch.from_pydict({
                    "no": group.column("no").take(pa.array(places)),
                    "length": group.column("length").take(pa.array(places)),
                    "bin": pa.array((int(number[low]) << 32) + np.repeat(np.arange(len(bins)), counts), pa.int64()),
                    "offset": pa.array(offsets, pa.int64()),
                    "room": pa.array(np.repeat([width - sum(s) for s in sizes], counts), pa.int64()),
                })

    dealt = pieces.select("group", "no", "length", "bin").repartition(partitions(pieces.sparkSession), "group")
    return dealt.sortWithinPartitions("group", "no").mapInArrow(run, "no long, length long, bin long, `offset` long, room long")


def pack(
    docs: DataFrame, path: str | None = None, width: int = WIDTH, end_id: int = END_ID, keep_ids: bool = False, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Pieces of all ``docs (doc_id, text)`` with the sequence and the place in it that each is packed into.

    A document is its ids and ``end_id``. One of more than ``width`` ids is cut into pieces
    of ``width``, the last one shorter; others are one piece. The pieces of a sequence follow
    each other without gaps. A null text is empty (its end id alone); rows without an id
    and repeated rows are documents of their own; no rows give none. ``keep_ids`` adds the
    piece's ids as little-endian unsigned 32-bit integers. ``group_pieces`` bounds what a
    task packs at once; it changes which sequences come out, not what they hold in all.
    """
    spark = docs.sparkSession
    # Numbers are stored with the pieces, so that later jobs and repeated tasks agree on them.
    pieces = stage(pieces_of(docs, path or tokenizer_path(), width, end_id, keep_ids).withColumn("no", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == width
    held = pieces.where(~whole).select("no", "length", F.lit(None).cast("long").alias("bin"))
    waiting = held.count()
    placed, turn, groups = [], 0, None
    while waiting and groups != 1:
        fewer = -(-waiting // group_pieces)
        if groups is not None and 2 * fewer > groups:
            # Bins that cannot be filled would only travel.
            break
        groups = fewer
        by = F.col("no") if turn == 0 else F.col("bin")
        dealt = held.withColumn("group", F.pmod(F.xxhash64(by, F.lit(turn)), F.lit(groups)))
        under = F.col("room") > int(width * TIGHT)
        packed, seen = stage_measured(searched(dealt, width), "packed", waiting=F.count_if(under))
        named = packed.withColumn("sequence_id", F.lit(turn).cast("long") * (1 << 56) + F.col("bin"))
        # The bins that are dealt again are placed by the next turn.
        placed.append((named, under))
        held, waiting, turn = packed.where(under).select("no", "length", "bin"), seen["waiting"] or 0, turn + 1
    chosen = [named.where(~under) for named, under in placed[:-1]] + [named for named, _ in placed[-1:]]
    ends = pieces.where(whole).select("no", (-F.col("no") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in chosen:
        ends = ends.unionByName(part.select("no", "sequence_id", "offset"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if keep_ids else [])
    return pieces.join(ends, "no").select(*names)
