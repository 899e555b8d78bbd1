"""Near-duplicate documents by HyperMinHash sketches, banding and exact verification.

A document's shingle hashes fall into buckets; each register keeps the number of
leading zeros of the bucket's least hash and the bits after the first one. Bands of
registers bring documents together, estimates of the Jaccard index corrected for
accidental register collisions discard hopeless pairs, and full shingle sets decide.

Documents with equal sets are one node. Inside a band group two bits of some registers,
then all registers rule pairs out before any pair leaves the task. Of the rest each node is
first compared with two others, chosen over all of its bands; when these links are known,
with two outside its component. What is then left open lies between components: the texts
of these nodes, one of each in a band group, meet in a task, which compares the pairs of
different components on their full sets. Lists of pairs are never written.

Large groups are dealt into blocks. The first two rounds look inside blocks, dealt anew
each time; the last one takes pairs of blocks, but none within a group's largest component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import (
    Workbench, bounded_batches, by_size, giving_back, partitions, restored, shielded, shuffles_dropped, sieved, smallest_reachable,
    sorted_groups,
)
from cohortloom.llm.tokens import FACTOR, piece_hashes
from cohortloom.session import discard, stage

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
EMPTY = 0xFFFF
#: Registers of a band for sets of 64 hashes and more; smaller sets take more, so that a band
#: holds two to four of their hashes.
BAND = 4
BANDS = REGISTERS // BAND
DENSE = 64
SMALLEST = 4
#: Standard deviations below the threshold at which an estimate still goes to verification.
SLACK = 5.5
#: Fields of the short sketch, two bits each.
FIELDS = 64
#: Rows, and hashes of their sets, that a block has on average at most.
BLOCK_ROWS = 2048
BLOCK_HASHES = 1 << 19
#: The low bits of a band's key: its level and number.
SLOT_BITS = 8
#: Rows of a group up to which pairs are formed for many groups at once.
SMALL = 24
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SKETCH_SCHEMA = "doc_id long, text_key long, n_shingles long, node long, registers binary, keys array<bigint>"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct 64-bit hashes, ascending, of each text's shingles of ``size`` words."""
    raw = [(t or "").encode() for t in texts]
    joined = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    edges = np.diff((~WHITE[joined]).view(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(first):
        return [np.empty(0, np.uint64)] * len(texts)
    word = mixed(piece_hashes(joined, first, last))
    cuts = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw]))
    rolled = np.full(max(0, len(word) - size + 1), size, np.uint64)
    for k in range(size):
        rolled = mixed(rolled * np.uint64(FACTOR) + word[k : k + len(rolled)])
    out, low = [], 0
    for high in cuts.tolist():
        n = high - low
        if n >= size:
            out.append(np.unique(rolled[low : high - size + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for k in range(n):
                short = mixed(short * np.uint64(FACTOR) + word[low + k : low + k + 1])
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
        low = high
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each ascending set of hashes."""
    out = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    sizes = [len(s) for s in sets]
    if not sum(sizes):
        return out
    h = np.concatenate(sets)
    at = np.repeat(np.arange(len(sets)) * REGISTERS, sizes) + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    least = np.concatenate([[True], at[1:] != at[:-1]])
    at, rest = at[least], h[least] << np.uint64(BUCKET_BITS)
    zeros = (53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    after = (rest << zeros) << np.uint64(1)
    out.reshape(-1)[at] = (zeros << np.uint64(MANTISSA_BITS) | after >> np.uint64(64 - MANTISSA_BITS)).astype(np.uint16)
    return out


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def short_sketches(regs: np.ndarray) -> np.ndarray:
    """Two bits of every second register, an empty one standing for the next that is not, in 16 bytes."""
    filled = regs.copy()
    for step in (1, 2, 4, 8, 16, 32, 64):
        filled = np.where(filled == EMPTY, np.roll(filled, -step, axis=1), filled)
    bits = (mixed(filled[:, :: REGISTERS // FIELDS].astype(np.uint64)) >> np.uint64(40) & np.uint64(3)).astype(np.uint64)
    places = np.arange(FIELDS // 2, dtype=np.uint64) * np.uint64(2)
    return np.stack([(bits[:, : FIELDS // 2] << places).sum(axis=1), (bits[:, FIELDS // 2 :] << places).sum(axis=1)], axis=1)


@lru_cache(maxsize=16)
def band_columns(level: int) -> np.ndarray:
    """The registers of each band for sets of ``2 ** level`` hashes and more, below ``2 * 2 ** level``."""
    if 1 << level >= DENSE:
        return np.arange(REGISTERS).reshape(BANDS, BAND)
    size = BAND * DENSE * 2 >> (level + 1)
    rng = np.random.default_rng(level)
    return np.stack([rng.permutation(REGISTERS)[:size] for _ in range(BANDS)])


def level_of(sizes: np.ndarray) -> np.ndarray:
    """Sets of one level share their bands; all sets of ``DENSE`` hashes and more are of one level."""
    return np.minimum(np.frexp(np.maximum(sizes, 1).astype(np.float64))[1] - 1, DENSE.bit_length() - 1)


def band_keys(regs: np.ndarray, sizes: np.ndarray, percent: int) -> list[np.ndarray]:
    """The keys of each sketch's bands that are not empty.

    A smaller set that can reach the threshold is of the same level or of the level
    of ``percent`` hundredths of the size, so a set takes the bands of both.
    """
    found: list[list[np.ndarray]] = [[] for _ in regs]
    own, lower = level_of(sizes), level_of(-(-sizes * percent // 100))
    for level in range(DENSE.bit_length()):
        rows = np.flatnonzero((own == level) | (lower == level))
        if not len(rows):
            continue
        columns = band_columns(level)
        factors = mixed(np.arange(1, columns.size + 1, dtype=np.uint64) + np.uint64(level << 32)).reshape(columns.shape)
        for part in np.array_split(rows, -(-len(rows) // 1024)):
            held = regs[part][:, columns]
            keys = mixed((mixed(held.astype(np.uint64)) * factors).sum(axis=2, dtype=np.uint64))
            slots = level * BANDS + np.arange(BANDS, dtype=np.uint64)
            keys = keys >> np.uint64(SLOT_BITS) << np.uint64(SLOT_BITS) | slots
            live = (held != EMPTY).any(axis=2)
            for r, k, ok in zip(part.tolist(), keys.view(np.int64), live):
                found[r].append(k[ok])
    return [np.concatenate(f) if f else np.empty(0, np.int64) for f in found]


def text_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, text``: the key tells the texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Sketches by document; equal sets share a node, empty ones have none.

    ``keys`` are those of the bands, for sets that are large enough to reach the
    threshold with a different one.
    """
    least = smallest_linked(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            regs = registers(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = band_keys(regs, np.where(sizes >= least, sizes, 0), percent)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "text_key": batch.column("text_key"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                "registers": pa.array([r.tobytes() for r in regs.astype("<u2")], pa.binary()),
                "keys": pa.array([k if n >= least else [] for k, n in zip(keys, sizes)], pa.list_(pa.int64())),
            })

    return text_keys(docs).mapInArrow(giving_back(run), SKETCH_SCHEMA)


def smallest_linked(percent: int) -> int:
    """The size of the smallest set that reaches the threshold with a different set."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of two disjoint sets of ``n`` and ``m`` hashes agree, worked out once for each pair of sizes."""
    sizes, at = np.unique(np.concatenate([n, m]), return_inverse=True)
    pairs, each = np.unique(at[: len(n)] * len(sizes) + at[len(n) :], return_inverse=True)
    own = np.maximum(sizes, 1)[:, None] / REGISTERS
    # The least of ``own`` uniform numbers has k leading zeros.
    k = np.arange(54)
    chances = (1 - 2.0 ** -(k + 1)) ** own - (1 - 2.0**-k) ** own
    return ((chances[pairs // len(sizes)] * chances[pairs % len(sizes)]).sum(axis=1) / (1 << MANTISSA_BITS))[each]


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates and the numbers of registers they rest on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1) / np.maximum(used, 1)
    chance = collision_rate(n, m)
    return (same - chance) / (1 - chance), used


def hopeful(regs: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs ``a, b`` of rows may reach the threshold by their corrected estimates, and these."""
    level = percent / 100
    out, guesses = np.empty(len(a), bool), np.empty(len(a))
    for low in range(0, len(a), 1 << 14):
        x, y = a[low : low + (1 << 14)], b[low : low + (1 << 14)]
        found, used = estimates(regs[x], regs[y], n[x], n[y])
        guesses[low : low + (1 << 14)] = found
        out[low : low + (1 << 14)] = found >= level - SLACK * np.sqrt(level * (1 - level) / np.maximum(used, 1))
    # Sets whose sizes differ too much cannot reach it.
    return out & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])), guesses


def pairs_in_large(regs: np.ndarray, n: np.ndarray, apart: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``a < b`` of one group's rows that two bits of some registers leave open; ``apart``: classes, a row each."""
    level, chance = percent / 100, 0.25
    short = short_sketches(regs)
    found = [np.empty((0, 2), np.int64)]
    for at in range(0, len(n), 256):
        mine, others = slice(at, at + 256), slice(at + 256)
        differ = short[mine, None, :] ^ short[None, others, :]
        other = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=2)
        guess = ((1 - other / FIELDS) - chance) / (1 - chance)
        small = np.minimum(n[mine, None], n[None, others])
        good = guess >= level - SLACK * np.sqrt(level * (1 - level) / np.minimum(small, FIELDS)) / (1 - chance)
        good &= 100 * small >= percent * np.maximum(n[mine, None], n[None, others])
        for kind in apart:
            good &= kind[mine, None] != kind[None, others]
        good &= np.arange(good.shape[1])[None, :] < np.arange(at, at + len(good))[:, None]
        found.append(np.argwhere(good)[:, ::-1] + [0, at])
    both = np.concatenate(found)
    return both[:, 0], both[:, 1]


def first_shared(regs: np.ndarray, a: np.ndarray, b: np.ndarray, slot: int) -> np.ndarray:
    """Whether the band of ``slot`` is the first of its level that the rows of each pair share."""
    columns, band = band_columns(slot // BANDS)[: slot % BANDS], slot % BANDS
    out = np.ones(len(a), bool)
    for low in range(0, len(a) if band else 0, 1 << 12):
        x, y = regs[a[low : low + (1 << 12)]][:, columns], regs[b[low : low + (1 << 12)]][:, columns]
        out[low : low + (1 << 12)] = ~((x == y).all(axis=2) & (x != EMPTY).any(axis=2)).any(axis=1)
    return out


def open_pairs(group: pa.RecordBatch, percent: int, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``a < b`` of rows in equal groups that the registers leave open, and their estimates.

    Only pairs of different components and, in a pair of blocks, of different blocks
    count. With ``once`` a pair is left to the first of the bands it shares.
    """
    key, low, high, n, component, block = (group.column(c).to_numpy() for c in ("key", "low", "high", "n_shingles", "component", "block"))
    size = len(n)
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)]))
    ends = np.append(starts[1:], size)
    regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
    end_of = np.repeat(ends, ends - starts)
    split = low != high
    short = np.repeat(ends - starts <= SMALL, ends - starts)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for gap in range(1, SMALL):
        x = np.flatnonzero(short[: size - gap] & (np.arange(gap, size) < end_of[: size - gap]))
        if not len(x):
            break
        x = x[(component[x] != component[x + gap]) & (~split[x] | (block[x] != block[x + gap]))]
        a.append(x)
        b.append(x + gap)
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s > SMALL and (component[s:e] != component[s]).any():
            apart = [component[s:e], block[s:e]] if split[s] else [component[s:e]]
            x, y = pairs_in_large(regs[s:e], n[s:e], apart, percent)
            a.append(x + s)
            b.append(y + s)
    a, b = np.concatenate(a), np.concatenate(b)
    good, guess = hopeful(regs, n.astype(np.float64), a, b, percent)
    a, b, guess = a[good], b[good], guess[good]
    if once and len(a):
        slots = key[a] & ((1 << SLOT_BITS) - 1)
        own = np.empty(len(a), bool)
        for slot in np.unique(slots).tolist():
            at = np.flatnonzero(slots == slot)
            own[at] = first_shared(regs, a[at], b[at], slot)
        a, b, guess = a[own], b[own], guess[own]
    return a, b, guess


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of groups, each group together and in the order of its nodes' ``place``."""
    return rows.repartition(partitions(rows.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "place", "node")


def first_and_likeliest(a: np.ndarray, b: np.ndarray, guess: np.ndarray, size: int) -> np.ndarray:
    """Places of the pairs with the least ``a``, or the least of those with the highest guess, for each ``b``; below ``size``."""
    first, likeliest, best = np.full(size, size), np.full(size, size), np.full(size, -np.inf)
    np.minimum.at(first, b, a)
    np.maximum.at(best, b, guess)
    high = np.flatnonzero(guess == best[b])
    np.minimum.at(likeliest, b[high], a[high])
    return np.union1d(np.flatnonzero(a == first[b]), high[a[high] == likeliest[b[high]]])


def partners(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: for each node the first and the likeliest of the nodes before it, chosen over all of its bands.

    All bands have one order of nodes, so a pair is named by its later node only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("key", "low", "high")):
            a, b, guess = open_pairs(group, percent, once=False)
            if not len(a):
                continue
            node = group.column("node").to_numpy()
            place = group.column("place").to_numpy()
            at = first_and_likeliest(a, b, guess, len(node))
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(node[b[at]]), "other": pa.array(node[a[at]]), "place": pa.array(place[a[at]]), "guess": pa.array(guess[at]),
            })

    named = dealt(rows).mapInArrow(giving_back(run), "node long, other long, place long, guess double")
    best = named.groupBy("node").agg(
        F.min(F.struct("place", "other")).alias("first"), F.max(F.struct("guess", "other")).alias("likeliest")
    )
    pairs = best.select("node", F.explode(F.array_distinct(F.array("first.other", "likeliest.other"))).alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


class Texts:
    """The texts of nodes, fetched from the documents once for each node asked for."""

    def __init__(self, bench: Workbench, nodes: DataFrame, docs: DataFrame):
        self.bench, self.docs = bench, docs
        self.names = nodes.select("node", F.col("first_id").alias("doc_id"), "text_key")
        self.held: DataFrame | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """``node, text`` of at least the ``wanted`` nodes."""
        missing = wanted.select("node").distinct()
        if self.held is not None:
            missing = self.bench.stage(missing.join(self.held, "node", "left_anti"), "missing")
            if missing.isEmpty():
                return self.held
        names = self.bench.stage(self.names.join(missing, "node"), "names")
        # Only texts that may be asked for are shuffled; equal rows of one id are one text.
        likely = sieved(text_keys(self.docs), names, "doc_id", "text_key").where("_sieved").dropDuplicates(["doc_id", "text_key"])
        more = self.bench.stage(names.join(likely, ["doc_id", "text_key"]).select("node", "text"), "texts")
        self.held = more if self.held is None else self.held.unionByName(more)
        return self.held


def checked_sets(nodes: list[int], texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sets of texts; empty where a text is not that of its node, should two texts of one id share a key."""
    return [s if len(s) and node_of(s) == n else np.empty(0, np.uint64) for n, s in zip(nodes, shingle_sets(texts, size))]


def verified(pairs: DataFrame, texts: Texts, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with ``100 * intersection >= percent * union`` of their full sets."""
    known = texts.of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    both = pairs.join(known.toDF("a", "t_a"), "a").join(known.toDF("b", "t_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in by_size(iter([big]), "t_b"):
                one, two = (
                    checked_sets(batch.column(c).to_pylist(), batch.column(f"t_{c}").to_pylist(), size) for c in ("a", "b")
                )
                good = []
                for x, y in zip(one, two):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(giving_back(run), "a long, b long")


def listed(rows: DataFrame, percent: int) -> DataFrame:
    """The nodes of each group that are in an open pair, a row each, with the nodes before them that they must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("key", "low", "high")):
            a, b, _ = open_pairs(group, percent, once=True)
            if not len(a):
                continue
            node = group.column("node").to_numpy()
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            later, counts = np.unique(b, return_counts=True)
            only_first = np.setdiff1d(a, later)
            rows_of = pa.array(np.concatenate([later, only_first]))
            borders = np.concatenate([[0], np.cumsum(counts), np.full(len(only_first), len(a))]).astype(np.int32)
            columns = {c: group.column(c).take(rows_of) for c in ("key", "low", "high", "node", "component")}
            yield pa.RecordBatch.from_pydict({**columns, "others": pa.ListArray.from_arrays(pa.array(borders), pa.array(node[a]))})

    return dealt(rows).mapInArrow(giving_back(run), "key long, low int, high int, node long, component long, others array<bigint>")


def links_between(
    nodes: list[int], components: list[int], sets: list[np.ndarray], others: list[list[int]], percent: int
) -> list[tuple[int, int]]:
    """Pairs of linked nodes, each joining two components that no earlier one joined."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return []
    _, hashes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    holders, start = owner[order], np.searchsorted(hashes[order], np.arange(hashes.max() + 2))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    place = {n: k for k, n in enumerate(nodes)}
    root = {c: c for c in components}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    for k, listed in enumerate(others):
        want = [place[n] for n in listed if find(components[place[n]]) != find(components[k])]
        if not want or not sizes[k]:
            continue
        mine = hashes[cuts[k] : cuts[k + 1]]
        low, count = start[mine], start[mine + 1] - start[mine]
        ends = np.cumsum(count)
        met = holders[np.arange(ends[-1]) + np.repeat(low - (ends - count), count)]
        shared = np.bincount(met, minlength=len(sets))[want]
        good = (shared > 0) & (100 * shared >= percent * (sizes[want] + sizes[k] - shared))
        for j in np.array(want)[good].tolist():
            x, y = find(components[j]), find(components[k])
            if x != y:
                root[x] = y
                found.append((min(nodes[j], nodes[k]), max(nodes[j], nodes[k])))
    return found


def links_of(rows: DataFrame, texts: Texts, size: int, percent: int) -> DataFrame:
    """``a, b``: links between components among the pairs ``listed``."""
    met = rows.join(texts.of(rows), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, ("key", "low", "high")):
            names = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1), [True]]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                group = batch.slice(low, high - low)
                nodes = group.column("node").to_pylist()
                sets = checked_sets(nodes, group.column("text").to_pylist(), size)
                found = links_between(nodes, group.column("component").to_pylist(), sets, group.column("others").to_pylist(), percent)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found]), "b": pa.array([f[1] for f in found])})

    ordered = met.repartition(partitions(rows.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return ordered.mapInArrow(giving_back(run), "a long, b long")


def bands(nodes: DataFrame) -> DataFrame:
    """``key, node, n_shingles`` of the bands that several nodes share, and how large the group of the key is."""
    keyed = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes")).where("n > 1")
    return keyed.join(sizes, "key")


def blocks_for(n: Column, hashes: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK_ROWS, hashes / BLOCK_HASHES)).cast("int")


def in_blocks(held: DataFrame, turn: int) -> DataFrame:
    """``key, low, high, block, place`` for rows of ``bands`` with ``component``: each in one block, which the turn chooses."""
    block = F.pmod(F.xxhash64("node", F.lit(turn)), blocks_for(F.col("n"), F.col("hashes"))).cast("int")
    return held.withColumn("block", block).select(
        "key", F.col("block").alias("low"), F.col("block").alias("high"), "block", F.xxhash64("node", F.lit(-turn)).alias("place"),
        "node", "component", "n_shingles",
    )


def between_components(held: DataFrame) -> DataFrame:
    """Rows in all pairs of blocks that may hold nodes of different components.

    The largest component of a group has blocks of its own, which meet the other blocks only.
    """
    parts = held.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("hashes"))
    whole = parts.groupBy("key").agg(
        F.max(F.struct("n", "hashes", "component")).alias("main"), F.sum("n").alias("all_n"), F.sum("hashes").alias("all_hashes")
    )
    shape = whole.select(
        "key", F.col("main.component").alias("main"),
        blocks_for(F.col("all_n") - F.col("main.n"), F.col("all_hashes") - F.col("main.hashes")).alias("strays"),
        blocks_for(F.col("main.n"), F.col("main.hashes")).alias("mains"),
    )
    is_main, dice = F.col("component") == F.col("main"), F.xxhash64("node")
    own = held.drop("n", "hashes").join(shape, "key").withColumn(
        "block", F.when(is_main, F.col("strays") + F.pmod(dice, F.col("mains"))).otherwise(F.pmod(dice, F.col("strays"))).cast("int")
    )
    last = F.when(is_main, F.col("strays")).otherwise(F.col("strays") + F.col("mains"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), (last - 1).cast("int"))))
    return met.select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", F.col("node").alias("place"),
        "node", "component", "n_shingles",
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each of ``docs (doc_id, text)``.

    Texts are split at ASCII white space after lower-casing A-Z. A text of fewer than
    ``size`` words is one shingle; without words it has none and links with nothing.
    Two documents link if their sets' Jaccard index is at least ``percent`` hundredths.
    ``component_id`` is the smallest id reachable. Rows of one id are judged by their
    own text; rows without an id link with nothing, have no component and are kept.
    """
    bounded_batches(docs.sparkSession)
    with Workbench() as bench, shuffles_dropped(docs.sparkSession):
        drawn = bench.stage(sketches(docs, size, percent), "sketches")
        linked = drawn.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
        nodes = bench.stage(
            linked.groupBy("node").agg(
                F.min(F.struct("doc_id", "text_key")).alias("first"),
                *[F.first(c).alias(c) for c in ("n_shingles", "registers", "keys")],
            ).select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("text_key"), "n_shingles", "registers", "keys"),
            "sketch-nodes",
        )
        known = bench.stage(drawn.select("doc_id", "n_shingles", "node"), "members")
        discard(drawn)
        rows = bench.stage(bands(nodes), "bands")
        texts = Texts(bench, nodes, docs)
        labels = nodes.select("node", F.col("node").alias("component"))
        tested = None
        for turn in (1, 2, 3):
            if turn == 1:
                held = rows.withColumn("component", F.col("node"))
            else:
                # Groups within one component are settled.
                held = rows.join(labels, "node")
                open_keys = held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
                held = held.join(open_keys.select("key"), "key")
            placed = in_blocks(held, turn) if turn < 3 else between_components(held)
            sketched = placed.join(nodes.select("node", "registers"), "node")
            if turn < 3:
                pairs = partners(sketched, percent)
                if tested is not None:
                    pairs = pairs.join(tested, ["a", "b"], "left_anti")
                tested = bench.stage(pairs, "pairs")
                found = verified(tested, texts, size, percent)
            else:
                found = links_of(bench.stage(listed(sketched, percent), "listed"), texts, size, percent)
            # The new links join components, so only these are walked again.
            joined = bench.stage(found, "found")
            if turn > 1:
                for end in ("a", "b"):
                    joined = joined.join(labels.toDF(end, f"c_{end}"), end)
                joined = bench.stage(joined.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "links")
            moved = smallest_reachable(
                joined.select(F.col("a").alias("id")).union(joined.select("b")), joined, "labels"
            ).toDF("component", "new")
            labels = bench.stage(
                labels.join(moved, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels"
            )
        spread = nodes.select("node", "first_id").join(labels, "node")
        smallest = spread.groupBy("component").agg(F.min("first_id").alias("component_id"))
        final = spread.join(smallest, "component").select("node", "component_id")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return stage(
            known.join(final, "node", "left")
            .select("doc_id", "n_shingles", own.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))),
            "near-duplicates",
        )


def remove(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose group has one with a smaller id."""
    found = near_duplicates(docs, size, percent)
    # An id goes only if none of its rows is kept; rows without an id stay.
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id")
    held, names = shielded(docs, "doc_id")
    marked = sieved(held.withColumn("_id", F.col("doc_id").cast("long")), gone.withColumnRenamed("doc_id", "_id"), "_id")
    # Documents that the sieve doesn't mark stay without being shuffled.
    stays = marked.where("_sieved").join(gone.withColumnRenamed("doc_id", "_id"), "_id", "left_anti")
    return restored(marked.where("NOT _sieved").unionByName(stays), names)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
