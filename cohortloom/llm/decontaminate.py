"""Benchmark decontamination by a broadcast set of normalised word windows.

The windows of a slice of the benchmark, whose size is checked, are broadcast. A
task gives each word of its documents the number the slice knows it by, rolls a
hash over the numbers, keeps the places whose hash the set holds and compares the
words there. A larger benchmark is broadcast in several slices, one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.common import Batches, by_size, giving_back, restored, shielded
from cohortloom.llm.tokens import FACTOR, powers
from cohortloom.operators.numbering import running_total
from cohortloom.session import stage

WINDOW = 13
SLICE_BYTES = 8 << 20
SLICES_PER_JOB = 4
HIT_PER_WORDS = 20
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return (text or "").encode().translate(WORD_BYTES).split()


@dataclass
class Windows:
    """All distinct windows of one length: their hashes, ascending, word numbers and items."""

    hashes: np.ndarray
    numbers: np.ndarray
    items: list[list[int]]
    maybe: np.ndarray


@dataclass
class WindowSet:
    numbers: dict[bytes, int]
    noise: np.ndarray
    by_length: dict[int, Windows]


def rolled(noise: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` over a sequence of word hashes."""
    n = 1 << max(16, len(noise).bit_length())
    sums = np.zeros(len(noise) + 1, np.uint64)
    np.cumsum(powers(n, FACTOR)[: len(noise)] * noise, out=sums[1:])
    count = max(0, len(noise) - length + 1)
    found = (sums[length : length + count] - sums[:count]) * powers(n, pow(FACTOR, -1, 1 << 64))[:count]
    return found ^ (found >> np.uint64(29))


def window_set(items: Iterable[tuple[int | None, str | None]], window: int) -> WindowSet:
    numbers: dict[bytes, int] = {}
    found: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        own = [numbers.setdefault(w, len(numbers) + 1) for w in words(text)]
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(tuple(own[i : i + n]), set()).update([] if item is None else [item])
    seed = 0
    while True:
        noise = np.random.default_rng(seed).integers(1, 1 << 63, len(numbers) + 1, np.uint64)
        by_length = {}
        for n, held in found.items():
            rows = np.array(list(held), np.int32)
            hashes = np.array([rolled(noise[r], n)[0] for r in rows], np.uint64)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(hashes):
                break
            maybe = np.zeros(1 << 20, bool)
            maybe[hashes >> np.uint64(44)] = True
            listed = [sorted(x) for x in held.values()]
            by_length[n] = Windows(hashes[order], rows[order], [listed[k] for k in order], maybe)
        else:
            return WindowSet(numbers, noise, by_length)
        seed += 1


def scan(texts: list[str | None], known: WindowSet) -> list[tuple[int, np.ndarray, np.ndarray, set[int]]]:
    """For each text its number of words, the first and last words of hits (end exclusive), and the items."""
    split = [words(t) for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    # One place between texts is no word of any window.
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    get = known.numbers.get
    ids = np.zeros(int((lengths + 1).sum()), np.int32)
    for s, at in zip(split, starts):
        ids[at : at + len(s)] = [get(w, 0) for w in s]
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    noise = known.noise[ids]
    for n, windows in known.by_length.items():
        hashes = rolled(noise, n)
        near = np.flatnonzero(windows.maybe[hashes >> np.uint64(44)])
        at = np.searchsorted(windows.hashes, hashes[near])
        keep = at < len(windows.hashes)
        near, at = near[keep], at[keep]
        keep = windows.hashes[at] == hashes[near]
        near, at = near[keep], at[keep]
        keep = (ids[near[:, None] + np.arange(n)] == windows.numbers[at]).all(axis=1)
        near, at = near[keep], at[keep]
        docs = np.searchsorted(starts, near, side="right") - 1
        for doc, place, w in zip(docs.tolist(), (near - starts[docs]).tolist(), at.tolist()):
            hits[doc].append((place, place + n))
            items[doc].update(windows.items[w])
    out = []
    for n_words, found, held in zip(lengths.tolist(), hits, items):
        first, last = merged(found)
        out.append((n_words, first, last, held))
    return out


def merged(runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open runs as sorted, disjoint runs."""
    if not runs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    held = np.array(sorted(runs), np.int64)
    reach = np.maximum.accumulate(held[:, 1])
    new = np.concatenate([[True], held[1:, 0] > reach[:-1]])
    return held[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(held) - 1)]


HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_runs", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with a struct ``hits``: number of words, runs of hit words (end exclusive) and items.

    ``docs`` needs ``text``, ``benchmark`` needs ``item_id, text``; a column ``hits`` of
    ``docs`` is replaced. Null and empty texts have no words and hit nothing; repeated
    items count once and items without an id are searched but not listed. An empty
    benchmark hits nothing.
    """
    return _searched(docs, benchmark, window, slice_bytes)


def _searched(
    docs: DataFrame, benchmark: DataFrame, window: int, slice_bytes: int, then: Callable[[Batches], Batches] | None = None
) -> DataFrame:
    """``find_hits``; ``then`` goes over its batches and keeps their columns.

    All slices of a job, and ``then`` after the last of all, are steps of one worker: each
    step in Python by itself would take one more worker for every task at a time.
    """
    spark = docs.sparkSession
    parts = benchmark_slices(benchmark, slice_bytes)
    schema = T.StructType([f for f in docs.schema.fields if f.name != "hits"] + [T.StructField("hits", HITS)])
    out = docs.select(*[f"`{f.name}`" for f in docs.schema.fields if f.name != "hits"], F.lit(None).cast(HITS).alias("hits"))
    for low in range(0, len(parts), SLICES_PER_JOB):
        if low:
            out = stage(out, "decontaminate")
        known = [
            spark.sparkContext.broadcast(window_set([tuple(r) for r in part.collect()], window))
            for part in parts[low : low + SLICES_PER_JOB]
        ]
        last = low + SLICES_PER_JOB >= len(parts)
        out = out.mapInArrow(giving_back(_scanner(known, then if last else None)), schema)
    return out


def benchmark_slices(benchmark: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """The distinct items ``(item_id, text)`` that have a text, in slices by a running sum of bytes.

    A slice has less than ``slice_bytes`` before its last item, so it is no larger than that
    and one item, however often an item is repeated. A benchmark of one slice is not stored.
    """
    size = F.octet_length("text").cast("long")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    if (rows.agg(F.sum(size)).first()[0] or 0) <= slice_bytes:
        return [rows]
    summed = running_total(rows, [], ["item_id", "text"], size, "before")
    cut = summed.select("item_id", "text", F.floor(F.col("before") / slice_bytes).alias("slice"))
    # In order of their slice, so that reading one skips the files and row groups of others.
    held = stage(cut.repartitionByRange("slice").sortWithinPartitions("slice"), "benchmark")
    # A few bytes per slice_bytes of benchmark.
    found = sorted(r.slice for r in held.select("slice").distinct().collect())
    return [held.where(F.col("slice") == k).select("item_id", "text") for k in found]


def _scanner(slices: list[Broadcast], then: Callable[[Batches], Batches] | None = None) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in by_size(batches):
            texts, held = batch.column("text").to_pylist(), batch.column("hits").to_pylist()
            for known in slices:
                held = [joined_hits(old, *new) for old, new in zip(held, scan(texts, known.value))]
            at = batch.schema.get_field_index("hits")
            kind = pa.struct([("n_words", pa.int64()), ("hit_runs", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])
            yield batch.set_column(at, pa.field("hits", kind), pa.array(held, kind))

    return run if then is None else lambda batches: then(run(batches))


def joined_hits(old: dict | None, n_words: int, first: np.ndarray, last: np.ndarray, items: set[int]) -> dict:
    """Hits of one more slice in a text, with those of the slices before."""
    runs = list(zip(first.tolist(), last.tolist()))
    if old:
        first, last = merged(runs + [tuple(r) for r in old["hit_runs"]])
        runs, items = list(zip(first.tolist(), last.tolist())), items | set(old["items"])
    return {"n_words": n_words, "hit_runs": [list(r) for r in runs], "items": sorted(items)}


def report(found: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items and the verdict. ``found``: with ``doc_id, hits``."""
    n_hit = F.aggregate("hits.hit_runs", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    names = F.array_sort(F.transform("hits.items", lambda i: i.cast("string")))
    return (
        found.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), names.alias("names"))
        .select(
            "doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"),
            F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (HIT_PER_WORDS * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


def without_runs(text: str | None, runs: list[list[int]]) -> str | None:
    """The text without its runs of hit words, each cut from its first word to the next kept word."""
    if not runs:
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for first, last in runs:
        kept.append(text[at : spans[first][0]])
        at = spans[last][0] if last < len(spans) else len(text)
    return "".join([*kept, text[at:]])


def remove(docs: DataFrame, benchmark: DataFrame, spans: bool = True, window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents and, with ``spans``, without the hit words of the others.

    A document is contaminated if a twentieth of its words is hit. Columns stay as
    they are; ``n_chars``, if there, follows the text.
    """
    held, names = shielded(docs, "text")

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            runs = [h["hit_runs"] for h in batch.column("hits").to_pylist()]
            at = batch.schema.get_field_index("text")
            new = pa.array([without_runs(t, r) for t, r in zip(texts, runs)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    found = _searched(held, benchmark, window, SLICE_BYTES, cut if spans else None)
    n_hit = F.aggregate("hits.hit_runs", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    done = found.where((n_hit == 0) | (HIT_PER_WORDS * n_hit < F.col("hits.n_words")))
    if spans and "n_chars" in names:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        old = names["n_chars"]
        done = done.withColumn(old, F.when(F.size("hits.hit_runs") > 0, size).otherwise(F.col(old)))
    return restored(done, names)


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 13) AS l FROM (
    SELECT item_id, coalesce(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, len(w) - l + 1)) AS i FROM b)
), lens AS (SELECT DISTINCT l FROM bw
), dw AS (
  SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS s
  FROM (SELECT r, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM d, lens)
), hit AS (SELECT r, l, i, item_id FROM dw JOIN bw USING (l, s)
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + l - 1)) AS p FROM hit) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(k, ',' ORDER BY k) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
