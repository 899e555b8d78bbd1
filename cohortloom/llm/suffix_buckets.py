"""Removal of long repeated byte strings by buckets of q-grams and hashes of what lies around them.

Dealt was bucket-pointer refinement: buckets of equal beginnings are sorted by the bucket
identifiers of later offsets. Sorting every suffix that way would send each text many times
over, so two things stand in for it. Each string of ``LENGTH`` bytes has a least q-gram,
which equal strings share at the same place, so only those q-grams are bucketed; the
buckets of one document drop out. Around the others the identifier for 2 k bytes at a
place is made, inside the row, of those for k bytes there and k bytes further on; two
identifiers for 32 bytes, 18 apart, name a string of 50. No identifier of one bucket is
looked up for another.

All steps exchange packed arrays between numbered buckets of bounded size. What a batch can
settle by itself is not sent: of rows that agree in everything that matters the smallest
document speaks for all. Buckets of very frequent q-grams are dealt out by whole strings.
Rows of one id are spread by their texts; rows without an id meet no others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import by_size, partitions, shuffles_dropped, sorted_groups
from cohortloom.llm.hyperminhash import mixed
from cohortloom.llm.tokens import FACTOR, powers
from cohortloom.session import stage

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM
AROUND = GRAM + 2 * REACH
BATCH_BYTES = 1 << 20
GROUP_BYTES = 1 << 23
BUCKET_ROWS = 1 << 18
#: A q-gram with more rows than this, or than a millionth of all, is dealt out by whole strings;
#: so at most a million q-grams are.
HOT_ROWS = 20_000
HOT_KEYS = 1_000_000
TEST, SURE, WITNESS = range(3)
CONTEXT, STRING, SETTLED = range(3)


def slid(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbours, by doubling."""
    held, have = values, 1
    while 2 * have <= width:
        held, have = pick(held[:-have], held[have:]), 2 * have
    return pick(held[: len(held) - (width - have)], held[width - have :]) if width > have else held


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each place, a megabyte at a time."""
    count = max(0, len(text) - GRAM + 1)
    out = np.empty(count, np.uint64)
    step = 1 << 20
    for low in range(0, count, step):
        part = text[low : low + step + GRAM - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(powers(2 * step, FACTOR)[: len(part)] * (part + np.uint64(1)), out=sums[1:])
        size = len(part) - GRAM + 1
        found = (sums[GRAM:] - sums[:size]) * powers(2 * step, pow(FACTOR, -1, 1 << 64))[:size]
        out[low : low + size] = mixed(found)
    return out


def least_grams(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the q-grams that are least in some string of ``LENGTH`` bytes of one text."""
    if len(text) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(text)
    least = slid(hashes, REACH + 1, np.minimum)
    valid = np.zeros(len(text) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - LENGTH + 1, -1)
    least[np.cumsum(valid)[: len(least)] == 0] = 0
    around = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(len(hashes) - len(least), np.uint64)])
    places = np.flatnonzero((hashes == slid(around, REACH + 1, np.maximum)[: len(hashes)]) & (hashes != 0))
    return places, hashes[places]


def in_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each run begins."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else order


TYPES = {
    "key": "<u8", "doc": "<i8", "tag": "<u4", "home": "<u4", "pos": "<u4", "n": "<u4", "left": "u1", "right": "u1",
    "at": "u1", "end": "<u4", "around": f"({AROUND},)u1",
}
# The columns that rows of each kind carry.
GRAM_COLUMNS = {TEST: ("key", "doc", "tag", "home", "pos"), SURE: ("doc", "tag", "home", "pos"), WITNESS: ("key", "doc", "n")}
KEPT_COLUMNS = {0: ("doc", "tag", "pos"), 1: ("key",)}
STRING_COLUMNS = {
    CONTEXT: ("doc", "tag", "home", "pos", "left", "right", "around"),
    STRING: ("key", "doc", "tag", "home", "pos", "at"),
    SETTLED: ("doc", "tag", "home", "pos", "end"),
}
SPAN_COLUMNS = {0: ("doc", "tag", "pos", "end")}
PACKED = "place long, kind int, n int, data binary"
PACKED_SCHEMA = pa.schema([("place", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])


def packed(columns: dict[str, np.ndarray], names: tuple[str, ...], by: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row for each value of ``by``, holding the named columns of its rows, compressed.

    Numbers are laid out byte by byte, so that their equal high bytes lie together.
    """
    order, starts = in_groups(by)
    ends = np.append(starts[1:], len(order))
    out: dict[str, list] = {"place": by[order[starts]].tolist(), "kind": [kind] * len(starts), "n": (ends - starts).tolist(), "data": []}
    held = [np.ascontiguousarray(columns[k], TYPES[k] if k != "around" else "u1")[order] for k in names]
    for s, e in zip(starts.tolist(), ends.tolist()):
        parts = [
            h[s:e].tobytes() if h.ndim > 1 else h[s:e].view("u1").reshape(e - s, -1).T.tobytes() for h in held
        ]
        out["data"].append(pa.compress(b"".join(parts), codec="zstd", asbytes=True))
    return pa.RecordBatch.from_pydict({f.name: pa.array(out[f.name], f.type) for f in PACKED_SCHEMA})


def unpacked(rows: pa.RecordBatch | pa.Table, kind: int, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The named columns of all rows of a kind, one after another."""
    out: dict[str, list[np.ndarray]] = {k: [np.empty(0, TYPES[k])] for k in names}
    width = sum(np.dtype(TYPES[k]).itemsize for k in names)
    kinds, counts = rows.column("kind").to_pylist(), rows.column("n").to_pylist()
    for own, n, data in zip(kinds, counts, rows.column("data")):
        if own != kind:
            continue
        raw = np.frombuffer(pa.decompress(data.as_py(), n * width, codec="zstd", asbytes=True), "u1")
        at = 0
        for k in names:
            size = np.dtype(TYPES[k]).itemsize
            part = raw[at : at + n * size]
            at += n * size
            if k == "around":
                out[k].append(part.reshape(n, size))
            else:
                out[k].append(np.ascontiguousarray(part.reshape(size, n).T).view(TYPES[k]).ravel())
    return {k: np.concatenate(v) for k, v in out.items()}


def loaded(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each text, all of them joined, and where each starts and ends."""
    raw = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    return raw, np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(r) for r in raw]), ends


def bucket_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """Least q-grams of ``docs (doc_id, text, home)``, packed by bucket.

    Of a q-gram that several documents of a batch hold, all rows are sure to be kept and
    one goes on as witness with their number; other rows go on to be tested.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, chars=BATCH_BYTES):
            raw, text, starts, ends = loaded(batch.column("text").to_pylist())
            places, key = least_grams(text, starts, ends)
            which = np.searchsorted(ends, places, side="right")
            if not len(places):
                continue
            tag = np.array([zlib.crc32(r) for r in raw], "<u4")[which]
            own = {
                "key": key, "doc": batch.column("doc_id").to_numpy()[which], "tag": tag,
                "home": batch.column("home").to_numpy().astype("<u4")[which], "pos": (places - starts[which]).astype("<u4"),
            }
            order, runs = in_groups(key)
            sizes = np.diff(np.append(runs, len(order)))
            docs_in = own["doc"][order]
            several = np.minimum.reduceat(docs_in, runs) != np.maximum.reduceat(docs_in, runs)
            sure = np.empty(len(order), bool)
            sure[order] = np.repeat(several, sizes)
            # Rows stay in the order of the documents, where they are compressed best.
            test = {k: v[~sure] for k, v in own.items()}
            if len(test["key"]):
                yield packed(test, GRAM_COLUMNS[TEST], (test["key"] % np.uint64(buckets)).astype(np.int64), TEST)
            if several.any():
                one = {k: own[k][order[runs[several]]] for k in ("key", "doc")} | {"n": sizes[several]}
                yield packed(one, GRAM_COLUMNS[WITNESS], (one["key"] % np.uint64(buckets)).astype(np.int64), WITNESS)
                rest = {k: v[sure] for k, v in own.items()}
                yield packed(rest, GRAM_COLUMNS[SURE], np.full(int(sure.sum()), int(key[0] % np.uint64(buckets))), SURE)

    return docs.mapInArrow(run, PACKED)


def shared_grams(grams: DataFrame, parts: int, hot_rows: int) -> DataFrame:
    """Rows of q-grams that several documents hold, packed by home; kind 1 lists the hot q-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in sorted_groups(batches, ("place",)):
            passed = [unpacked(bucket, SURE, GRAM_COLUMNS[SURE])]
            test = unpacked(bucket, TEST, GRAM_COLUMNS[TEST])
            seen = unpacked(bucket, WITNESS, GRAM_COLUMNS[WITNESS])
            key, doc = (np.concatenate([test[k], seen[k]]) for k in ("key", "doc"))
            n = np.concatenate([np.ones(len(test["key"]), np.int64), seen["n"].astype(np.int64)])
            known = np.arange(len(key)) >= len(test["key"])
            if len(key):
                order, runs = in_groups(key)
                held = doc[order]
                # A witness stands for several documents.
                good = (np.minimum.reduceat(held, runs) != np.maximum.reduceat(held, runs)) | np.logical_or.reduceat(known[order], runs)
                many = np.add.reduceat(n[order], runs) > hot_rows
                if many.any():
                    hot = key[order][runs[many]]
                    yield packed({"key": hot}, KEPT_COLUMNS[1], np.full(len(hot), -1), 1)
                keep = np.zeros(len(key), bool)
                keep[order] = np.repeat(good, np.diff(np.append(runs, len(order))))
                keep = keep[: len(test["key"])]
                passed.append({k: test[k][keep] for k in GRAM_COLUMNS[SURE]})
            both = {k: np.concatenate([p[k] for p in passed]) for k in GRAM_COLUMNS[SURE]}
            if len(both["doc"]):
                yield packed(both, KEPT_COLUMNS[0], both["home"].astype(np.int64), 0)

    return grams.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(run, PACKED)


def strings_around(rows: np.ndarray) -> np.ndarray:
    """Identifiers of the ``REACH + 1`` strings of ``LENGTH`` bytes in each row of ``AROUND`` bytes."""
    out = np.empty((len(rows), REACH + 1), np.uint64)
    for low in range(0, len(rows), 1 << 14):
        ids = rows[low : low + (1 << 14)].astype(np.uint64) + np.uint64(1)
        have = 1
        while 2 * have <= LENGTH:
            ids = mixed(ids[:, :-have] * np.uint64(FACTOR) + ids[:, have:])
            have *= 2
        gap = LENGTH - have
        if gap:
            ids = mixed(ids[:, : ids.shape[1] - gap] * np.uint64(FACTOR) + ids[:, gap:])
        out[low : low + (1 << 14)] = ids
    return out


def reach_of(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and last string number that lie inside the text; string ``REACH`` starts with the q-gram."""
    return REACH - columns["left"].astype(np.int64), columns["right"].astype(np.int64)


def spans_of(columns: dict[str, np.ndarray], first: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
    """The bytes that strings ``first .. last`` of each row cover; neighbours overlap, so it is one span."""
    pos = columns["pos"].astype(np.int64)
    return {
        "doc": columns["doc"], "tag": columns["tag"], "home": columns["home"],
        "pos": (pos - REACH + first).astype("<u4"), "end": (pos - REACH + last + LENGTH).astype("<u4"),
    }


def named(doc_ids: list[int | None], raw: list[bytes]) -> list[tuple[int | None, int]]:
    """A name for each row of a home: its id and the number of its text among the texts of the id."""
    sums = [zlib.crc32(r) for r in raw]
    texts: dict[int | None, set[int]] = {}
    for d, c in zip(doc_ids, sums):
        texts.setdefault(d, set()).add(c)
    several = {d: sorted(c) for d, c in texts.items() if len(c) > 1}
    return [(d, several[d].index(c) if d in several else 0) for d, c in zip(doc_ids, sums)]


def own_strings(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far left of a q-gram the strings begin in which it is least, the furthest and the nearest."""
    furthest, nearest = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for low in range(0, len(at), 1 << 15):
        part = at[low : low + (1 << 15)]
        back = hashes[np.maximum(part[:, None] - np.arange(1, REACH + 1), 0)] < hashes[part, None]
        ahead = hashes[np.minimum(part[:, None] + np.arange(1, REACH + 1), len(hashes) - 1)] < hashes[part, None]
        furthest[low : low + (1 << 15)] = np.where(back.any(axis=1), back.argmax(axis=1), REACH)
        nearest[low : low + (1 << 15)] = REACH - np.where(ahead.any(axis=1), ahead.argmax(axis=1), REACH)
    return furthest, nearest


def refine(docs: DataFrame, kept: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """For each kept q-gram the strings in which it is least, packed by bucket of the q-gram; hot ones one by one."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    def run(texts: pa.Table, grams: pa.Table) -> pa.Table:
        out = []
        own = unpacked(grams, 0, KEPT_COLUMNS[0])
        if texts.num_rows and len(own["doc"]):
            order = np.lexsort((own["pos"], own["tag"], own["doc"]))
            own = {k: v[order] for k, v in own.items()}
            home = texts.column("home")[0].as_py()
            doc_ids = texts.column("doc_id").to_pylist()
            raw, text, starts, ends = loaded(texts.column("text").to_pylist())
            place = {(d, zlib.crc32(r)): k for k, (d, r) in enumerate(zip(doc_ids, raw))}
            number = np.array([n for _, n in named(doc_ids, raw)])
            new = np.concatenate([[True], (np.diff(own["doc"]) != 0) | (np.diff(own["tag"].astype(np.int64)) != 0)])
            rows = np.array([place[d, t] for d, t in zip(own["doc"][new].tolist(), own["tag"][new].tolist())], np.int64)
            which = rows[np.cumsum(new) - 1]
            own["tag"] = number[which].astype("<u4")
            at = starts[which] + own["pos"]
            hashes = gram_hashes(text)
            own["key"] = hashes[at]
            furthest, nearest = own_strings(hashes, at)
            own["home"] = np.full(len(at), home, "<u4")
            own["left"] = np.minimum(furthest, own["pos"]).astype("u1")
            own["right"] = np.clip(np.minimum(REACH - nearest, ends[which] - at - GRAM), 0, REACH).astype("u1")
            text = np.concatenate([np.zeros(REACH, np.uint8), text, np.zeros(REACH, np.uint8)])
            step = 1 << 16
            for low in range(0, len(at), step):
                part = {k: v[low : low + step] for k, v in own.items()}
                around = text[at[low : low + step, None] + np.arange(AROUND)]
                number = np.arange(AROUND)
                around[(number < REACH - part["left"][:, None]) | (number >= REACH + GRAM + part["right"][:, None].astype(np.int64))] = 0
                out += settle(part, around)
        return pa.Table.from_batches(out, PACKED_SCHEMA)

    def settle(part: dict[str, np.ndarray], around: np.ndarray) -> list[pa.RecordBatch]:
        out = []
        first, last = reach_of(part)
        wide = np.zeros((len(around), -(-(AROUND + 2) // 8) * 8), np.uint8)
        wide[:, :AROUND], wide[:, AROUND], wide[:, AROUND + 1] = around, part["left"], part["right"]
        words = wide.view(np.uint64)
        whole = np.zeros(len(around), np.uint64)
        for k in range(words.shape[1]):
            whole = mixed(whole * np.uint64(FACTOR) + words[:, k])
        # Rows with equal surroundings: those of larger documents are covered in full.
        order, runs = in_groups(whole)
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(part["doc"][order], runs), np.diff(np.append(runs, len(order))))
        done = part["doc"] > least
        inside = done & (first <= last)
        if inside.any():
            held = spans_of({k: v[inside] for k, v in part.items()}, first[inside], last[inside])
            out.append(packed(held, STRING_COLUMNS[SETTLED], (held["home"] % buckets).astype(np.int64), SETTLED))
        usable = ~done & (first <= last)
        frequent = np.isin(part["key"], sent.value) & usable
        plain = usable & ~frequent
        if plain.any():
            held = {k: v[plain] for k, v in part.items()} | {"around": around[plain]}
            out.append(packed(held, STRING_COLUMNS[CONTEXT], (held["key"] % np.uint64(buckets)).astype(np.int64), CONTEXT))
        if frequent.any():
            rows = np.flatnonzero(frequent)
            ids = strings_around(around[rows])
            number = np.arange(REACH + 1)
            r, number = np.nonzero((number >= first[rows, None]) & (number <= last[rows, None]))
            held = {k: v[rows[r]] for k, v in part.items()} | {"key": ids[r, number], "at": number}
            over = covered(held["key"], held["doc"])
            if over.any():
                mine = {k: v[over] for k, v in held.items()}
                spans = spans_of(mine, mine["at"], mine["at"])
                out.append(packed(spans, STRING_COLUMNS[SETTLED], (spans["home"] % buckets).astype(np.int64), SETTLED))
            rest = {k: v[~over] for k, v in held.items()}
            out.append(packed(rest, STRING_COLUMNS[STRING], (rest["key"] % np.uint64(buckets)).astype(np.int64), STRING))
        return out

    return docs.groupBy("home").cogroup(kept.groupBy("place")).applyInArrow(run, PACKED)


def covered(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row of a smaller document has the same key."""
    order, runs = in_groups(keys)
    if not len(order):
        return np.zeros(0, bool)
    least = np.minimum.reduceat(doc[order], runs)
    out = np.empty(len(order), bool)
    out[order] = doc[order] > np.repeat(least, np.diff(np.append(runs, len(order))))
    return out


def repeated(strings: DataFrame, parts: int) -> DataFrame:
    """Spans of strings that a smaller document holds, packed by home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in sorted_groups(batches, ("place",)):
            found = [unpacked(bucket, SETTLED, STRING_COLUMNS[SETTLED])]
            single = unpacked(bucket, STRING, STRING_COLUMNS[STRING])
            over = covered(single["key"], single["doc"])
            single = {k: v[over] for k, v in single.items()}
            found.append(spans_of(single, single["at"].astype(np.int64), single["at"].astype(np.int64)))
            own = unpacked(bucket, CONTEXT, STRING_COLUMNS[CONTEXT])
            around = own.pop("around")
            if len(around):
                ids = strings_around(around)
                first, last = reach_of(own)
                low, high = np.full(len(around), REACH + 1), np.full(len(around), -1)
                for k in range(REACH + 1):
                    valid = np.flatnonzero((k >= first) & (k <= last))
                    hit = valid[covered(ids[valid, k], own["doc"][valid])]
                    low[hit] = np.minimum(low[hit], k)
                    high[hit] = k
                hit = high >= 0
                found.append(spans_of({k: v[hit] for k, v in own.items()}, low[hit], high[hit]))
            both = {k: np.concatenate([f[k] for f in found]) for k in STRING_COLUMNS[SETTLED]}
            if len(both["doc"]):
                yield packed(both, SPAN_COLUMNS[0], both["home"].astype(np.int64), 0)

    return strings.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(run, PACKED)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_out(docs: DataFrame, spans: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """What is left of each text, digested or, with ``keep_bytes``, also in full as binary."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        own = unpacked(found, 0, SPAN_COLUMNS[0])
        raw, _, _, _ = loaded(texts.column("text").to_pylist())
        doc_ids = texts.column("doc_id").to_pylist()
        order = np.lexsort((own["pos"], own["tag"], own["doc"]))
        own = {k: v[order] for k, v in own.items()}
        names = np.stack([own["doc"], own["tag"].astype(np.int64)], axis=1)
        new = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]).any(axis=1)])) if len(names) else np.empty(0, int)
        held = {tuple(names[s].tolist()): (s, e) for s, e in zip(new, np.append(new[1:], len(names)))}
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for (doc, number), data in zip(named(doc_ids, raw), raw):
            s, e = held.get((doc, number), (0, 0))
            low, reach = own["pos"][s:e].astype(np.int64), np.maximum.accumulate(own["end"][s:e].astype(np.int64))
            # Spans that touch are one run.
            starts = np.concatenate([[True], low[1:] > reach[:-1]]) if e > s else np.zeros(0, bool)
            first, last = low[starts], reach[np.append(np.flatnonzero(starts)[1:] - 1, e - s - 1)] if e > s else reach
            at, parts = 0, []
            for a, b in zip(first.tolist(), last.tolist()):
                parts.append(data[at:a])
                at = b
            kept = b"".join([*parts, data[at:]])
            for k, v in zip(out, (doc, len(data), len(data) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept)):
                out[k].append(v)
        columns = {k: pa.array(out[k], pa.int64()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")}
        columns["kept_sha256"] = pa.array(out["kept_sha256"], pa.string())
        if keep_bytes:
            columns["kept"] = pa.array(out["kept"], pa.binary())
        return pa.table(columns)

    grouped = docs.groupBy("home").cogroup(spans.groupBy("place"))
    return grouped.applyInArrow(run, RESULT + (", kept binary" if keep_bytes else ""))


def whole(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """The rows of ``cut_out`` for texts that nothing is removed from."""
    raw, none = F.coalesce("text", F.lit("")).cast("binary"), F.lit(0).cast("long")
    kept = [raw.alias("kept")] if keep_bytes else []
    return docs.select(
        "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"), *kept,
    )


def remove_repeats(docs: DataFrame, keep_bytes: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, a row for each of ``docs (doc_id, text)``.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document
    of a smaller id, judged on the input. A null text is empty. Rows of one id do not
    remove from each other; rows without an id keep everything and remove nothing.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = max(parts, -(-size // GROUP_BYTES))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = every.where("doc_id is not null")
    docs = docs.withColumn("home", F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(homes)))
    # About one place in eighteen is the least of some string.
    expected = size // 17
    buckets = max(parts, -(-expected // (4 * BUCKET_ROWS)))
    grams = bucket_grams(docs, buckets)
    with shuffles_dropped(spark):
        kept = stage(shared_grams(grams, parts, max(hot_rows, expected // HOT_KEYS)), "shared-grams")
        listed = pa.Table.from_pylist([r.asDict() for r in kept.where("kind = 1").collect()], PACKED_SCHEMA)
        hot = unpacked(listed, 1, KEPT_COLUMNS[1])["key"]
        strings = refine(docs, kept.where("kind = 0"), hot, max(parts, -(-expected // BUCKET_ROWS)))
        spans = stage(repeated(strings, parts), "repeated-spans")
    return cut_out(docs, spans, keep_bytes).unionByName(whole(every.where("doc_id is null"), keep_bytes))
