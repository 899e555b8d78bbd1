"""Near duplicates, embeddings and repeated strings against brute force."""

import hashlib
import math
import random
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import hyperminhash as H, rotation_codes as R, suffix_buckets as S
from cohortloom.llm.common import sieved, smallest_reachable

WORDS = [f"w{i}" for i in range(3000)]


def components(names, links):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


@pytest.mark.parametrize("seed", range(2))
def test_smallest_reachable(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(range(1000), 120)
    links = [(rng.choice(names), rng.choice(names)) for _ in range(90)] + list(zip(names[:30], names[1:31]))
    nodes = spark.createDataFrame([(n,) for n in names], "id bigint")
    got = smallest_reachable(nodes, spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.id: r.component for r in got} == components(names, links)
    none = smallest_reachable(nodes, spark.createDataFrame([], "a bigint, b bigint")).collect()
    assert all(r.id == r.component for r in none) and len(none) == 120


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def corpus(rng):
    docs = []
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 5, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            docs.append(" ".join(copy))
    # Many copies of one text, each with a change of its own, and a line that others share.
    base = [rng.choice(WORDS) for _ in range(150)]
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(150)] = f"own{k}"
        copy[rng.randrange(150)] = f"other{k}"
        docs.append(" ".join(copy))
    line = " ".join(rng.choice(WORDS) for _ in range(12))
    docs += [line + "\n" + " ".join(rng.choice(WORDS) for _ in range(rng.choice([4, 15, 40]))) for _ in range(50)]
    docs += ["", None, " \t\n", "one", "One", "two words", "A b C d", "a B c D"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5)])
def test_near_duplicates_equal_brute_force(spark, seed, size):
    docs = corpus(random.Random(seed))
    sets = {d: shingles(t, size) for d, t in docs}
    links = []
    for a, _ in docs:
        for b, _ in docs:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    links.append((a, b))
    want = components([d for d, _ in docs], links)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("node", F.lit(3))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(df, size).collect()}
    assert got == {d: (len(sets[d]), want[d], want[d] == d) for d, _ in docs}
    left = H.remove(df, size)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d in want if want[d] == d}


def test_groups_in_blocks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 8)
    docs = [(k, t) for k, t in corpus(random.Random(3)) if k % 2]
    sets = {d: shingles(t, 4) for d, t in docs}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in H.near_duplicates(df, 4).collect()}
    assert got == components(list(sets), links)


def test_near_duplicates_of_odd_rows(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(60_000))
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "A B C D E F"), (None, "a b c d e f"), (8, long), (9, long + " end"), (4, None), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("gone", F.lit("g"))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in H.near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, 1, False), (2, 1, False), (1, 1, True), (None, None, True), (8, 8, True), (9, 8, False), (4, 4, True), (5, 5, True)], key=str)
    assert sorted((r.doc_id for r in H.remove(df).collect()), key=str) == sorted([1, None, 8, 4, 5], key=str)
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_different_texts_of_one_id_link_by_their_own_text(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for k in range(10):
        for j in range(4):
            text = " ".join(rng.choice(WORDS) for _ in range(100))
            rows += [(k, text)] * (1 + j % 2) + [(100 + 10 * k + j, text + " end")]
            want[100 + 10 * k + j] = k
    rows += [(500, rows[0][1] + " other words")]
    want[500] = 0
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = H.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k) for k in range(10)} | set(want.items())
    assert {r.doc_id for r in H.remove(df).collect()} == set(range(10))


def shuffle_bytes(spark):
    total = 0
    for folder in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for path in Path(folder.getPath()).rglob("shuffle_*"):
            try:
                total += path.stat().st_size
            except FileNotFoundError:  # deleted meanwhile
                pass
    return total


def test_texts_without_near_copies_are_not_shuffled(spark):
    rng = random.Random(14)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(1500)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + k, texts[k] + " end") for k in range(6)] + [(None, texts[0])]
    df = H.stage(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    floor, seen, over = shuffle_bytes(spark), [], threading.Event()

    def watch():
        while not over.wait(0.02):
            seen.append(shuffle_bytes(spark))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = H.stage(H.remove(df))
    finally:
        over.set()
        watcher.join()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {tuple(r) for r in got.collect()} == {*enumerate(texts), (None, texts[0])}
    assert got.count() == len(texts) + 1
    # Sketches are some hundred bytes a text; the texts are far larger.
    assert max(seen) - floor < sum(map(len, texts)) / 4


def test_a_sieve_marks_wanted_rows_and_few_others(spark, monkeypatch):
    rows = spark.createDataFrame([(k if k else None, k % 7, f"t{k}") for k in range(2000)], "a bigint, b bigint, text string")
    wanted = rows.where("a % 20 = 0").select("a", "b")
    for words, most in ((1 << 19, 150), (1, 2000)):
        monkeypatch.setattr("cohortloom.llm.common.SIEVE_WORDS", words)
        got = sieved(rows, wanted.union(wanted), "a", "b")
        assert got.columns == [*rows.columns, "_sieved"] and got.count() == 2000
        marked = {r.a for r in got.where("_sieved").collect()}
        assert set(range(20, 2000, 20)) <= marked and len(marked) <= most
    assert sieved(rows, wanted.limit(0), "a", "b").where("_sieved").isEmpty()


def test_estimates_follow_the_index():
    rng = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, int(2000 * share), np.uint64)
            rest = rng.integers(0, 1 << 63, 2000 - len(both), np.uint64)
            half = len(rest) // 2
            sets = [np.unique(np.concatenate([both, r]) * np.uint64(2) + np.uint64(1)) for r in (rest[:half], rest[half:])]
            regs = H.registers(sets)
            found, _ = H.estimates(regs[:1], regs[1:], np.array([len(sets[0])]), np.array([len(sets[1])]))
            errors.append(found[0] - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def collisions_pair_by_pair(n, m):
    k = np.arange(54)
    one, two = ((1 - 2.0 ** -(k + 1)) ** own - (1 - 2.0**-k) ** own for own in (np.maximum(s, 1)[:, None] / H.REGISTERS for s in (n, m)))
    return (one * two).sum(axis=1) / (1 << H.MANTISSA_BITS)


def test_collisions_of_many_near_copies_are_worked_out_once_for_each_pair_of_sizes():
    rng = np.random.default_rng(8)
    n, m = (rng.integers(146, 151, 1 << 16).astype(np.float64) for _ in range(2))
    taken = {}
    for run in (collisions_pair_by_pair, H.collision_rate):
        before = time.process_time()
        found = run(n, m)
        taken[run] = time.process_time() - before
        assert np.array_equal(found, collisions_pair_by_pair(n, m))
    assert taken[H.collision_rate] < taken[collisions_pair_by_pair] / 3
    odd = np.array([0.0, 1, 64, 5e6])
    assert np.array_equal(H.collision_rate(odd, odd[::-1]), collisions_pair_by_pair(odd, odd[::-1]))
    assert not len(H.collision_rate(odd[:0], odd[:0]))


def test_first_and_likeliest_of_each_later_row():
    rng = random.Random(15)
    for size in (2, 9, 40):
        pairs = [(a, b, rng.choice([0.7, 0.8, 0.9])) for b in range(size) for a in range(b) if rng.random() < 0.4]
        rng.shuffle(pairs)
        want = {min(p for p in pairs if p[1] == b) for _, b, _ in pairs} | {min((-g, a, b) for a, c, g in pairs if c == b) for _, b, _ in pairs}
        want = {p if p[0] >= 0 and p[2] < 1 else (p[1], p[2], -p[0]) for p in want}
        a, b, guess = (np.array([p[k] for p in pairs], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
        at = H.first_and_likeliest(a, b, guess, size).tolist()
        assert len(at) == len(set(at)) and {pairs[k] for k in at} == want


def vectors(rng, n, size=16):
    base = rng.normal(size=(n // 4, size))
    out = [base[rng.integers(len(base))] + rng.normal(size=size) * rng.choice([0.02, 0.08, 0.4]) for _ in range(n)]
    cluster = rng.normal(size=size)
    out += [cluster + rng.normal(size=size) * 0.03 for _ in range(120)]
    out += [out[3], out[3], out[3] * 2.0]
    return [np.float32(v) for v in out]


def linked(rows):
    good = {k: np.array(v, np.float64) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [
        (a, b) for a in good for b in good
        if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95
    ]
    counts = {k: 0 for k, _ in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    near = components([k for k, _ in rows], links)
    return {k: (counts[k], near[k], near[k] == k) for k, _ in rows}


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_link_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    rng = np.random.default_rng(11)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors(rng, 240))]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 2.0]), (906, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("node", F.lit(1)).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in R.near_duplicates(df).collect()}
    want = linked(rows)
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, [(k, got[k], want[k]) for k in wrong[:5]]


def test_vector_rows_without_or_with_equal_ids(spark):
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [1.0, 0.01]), (8, [0.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in R.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False), (8, 0, 8, True)], key=str)
    assert R.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(12)
    size = 64
    a, b = R.unit(rng.normal(size=(4000, size))), None
    b = R.unit(0.8 * a + 0.6 * R.unit(rng.normal(size=(4000, size))))
    turn = R.rotations(size, size)
    code, factor = R.code_and_factor(a @ turn.T, size)
    dots = (code * (b @ turn.T)).sum(axis=1)
    true = (a * b).sum(axis=1)
    assert abs((dots / (math.sqrt(size) * factor) - true).mean()) < 0.01
    assert (R.upper_bounds(dots, factor, size) >= true).mean() > 0.999


def brute(docs, n=50):
    seen, out = {}, []
    for doc in sorted({d for d, _ in docs if d is not None}):
        texts = [t for d, t in docs if d == doc]
        for data in texts:
            flags = bytearray(len(data))
            for i in range(len(data) - n + 1):
                if data[i : i + n] in seen:
                    flags[i : i + n] = b"\x01" * n
            kept = bytes(x for x, f in zip(data, flags) if not f)
            runs = sum(1 for i in range(len(data)) if flags[i] and (i == 0 or not flags[i - 1]))
            out.append((doc, len(data), sum(flags), runs, hashlib.sha256(kept).hexdigest()))
        for data in texts:
            for i in range(len(data) - n + 1):
                seen.setdefault(data[i : i + n], doc)
    out += [(None, len(t), 0, 0, hashlib.sha256(t).hexdigest()) for d, t in docs if d is None]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_strings_equal_brute_force(spark, hot):
    rng = random.Random(21)
    def word(): return "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passage = [" ".join(word() for _ in range(n)) for n in (9, 12, 40, 200)]
    exact = "".join(rng.choice("xyz") for _ in range(50))
    docs = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.3:
                p = rng.choice(passage)
                a = rng.randint(0, len(p) // 2)
                parts.append(p[a : a + rng.randint(20, len(p))])
            elif kind < 0.4:
                parts.append(exact[rng.randint(0, 1) :])
            elif kind < 0.5:
                parts.append(rng.choice("=-#") * rng.randint(40, 130))
            else:
                parts.append(" ".join(word() for _ in range(rng.randint(1, 30))))
        docs.append((k, rng.choice(["", " ", "\n"]).join(parts)))
    docs += [(500, docs[7][1]), (501, docs[7][1]), (502, docs[8][1]), (502, docs[8][1]), (502, docs[9][1] + "!"), (None, docs[7][1]), (503, None), (504, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("home", F.lit("h")).repartition(5)
    got = S.remove_repeats(df, hot_rows=hot).collect()
    want = brute([(d, (t or "").encode()) for d, t in docs])
    assert sorted(map(tuple, got), key=str) == want


def test_repeats_in_long_and_no_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 4000)
    rng = random.Random(22)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    docs = [(1, long), (2, "own " + long[1000:9000] + " tail"), (3, long[::-1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = S.remove_repeats(df, keep_bytes=True).collect()
    rows = {r.doc_id: r for r in got}
    assert (rows[1].n_removed, rows[3].n_removed, rows[2].n_spans) == (0, 0, 1) and rows[2].n_removed >= 8000
    assert bytes(rows[1].kept) == long.encode()
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_rows_of_one_id_or_none_are_spread(spark, monkeypatch):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(60, 200)))
    shared = word()
    docs = [(1, word() + shared)] + [(7, word() + (shared if k % 3 else "")) for k in range(150)]
    docs += [(None, word() + shared) for _ in range(150)] + [(8, docs[5][1]), (8, docs[5][1]), (8, None)]
    held = []
    refine = S.refine
    monkeypatch.setattr(S, "GROUP_BYTES", 1 << 10)
    monkeypatch.setattr(S, "refine", lambda df, *a: held.append(df) or refine(df, *a))
    got = S.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), keep_bytes=True)
    rows = got.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute([(d, (t or "").encode()) for d, t in docs])
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert sum(r.n_removed >= len(shared) for r in rows) >= 100
    homes = held[0].groupBy("doc_id", "home").count().collect()
    assert all(r.doc_id is not None for r in homes)
    assert sum(r.doc_id == 7 for r in homes) > 20 and max(r["count"] for r in homes) < 30
