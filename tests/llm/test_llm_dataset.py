"""Whitening, best-fit packing and the Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortloom.llm import merkle, swap_packing, whitening
from cohortloom.llm.tokens import tokenizer_path

PLAIN = Tokenizer.from_file(tokenizer_path())
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- whitening ---


def matrices():
    rng = np.random.default_rng(5)
    hadamard = np.array([[1.0]])
    for _ in range(5):
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    turn = np.linalg.qr(rng.normal(size=(50, 50)))[0]
    x = rng.normal(size=(400, 50))
    unit = np.linalg.qr(x - x.mean(0))[0]
    return {
        "round": rng.normal(size=(300, 40)),
        "geometric": rng.normal(size=(500, 40)) @ np.diag(2.0 ** -np.arange(40)),
        "low rank": np.repeat(rng.normal(size=(10, 30)), 7, 0),
        "equal values": np.concatenate([hadamard, -hadamard]),
        "unit rows": np.concatenate([np.eye(40)] * 3),
        "clusters": (unit * np.repeat([9, 9 + 1e-12, 9 + 1e-7, 9.001, 1], 10)) @ turn,
        "one value": np.full((5, 4), 3.0),
        "two rows": np.round(rng.normal(size=(2, 6)) * 9),
    }


@pytest.mark.parametrize("name", list(matrices()))
def test_directions_whiten(name):
    rows = matrices()[name]
    rows = rows - rows.mean(0)
    n, width = rows.shape
    factor = whitening.triangle((rows[k : k + 7] for k in range(0, n, 7)), width)
    square = np.zeros((width, width))
    square[: len(factor)] = factor
    variance, directions, trace = whitening.principal(square, n, 32)
    true = np.linalg.svd(rows, compute_uv=False) ** 2 / n
    rank = int((true > 1e-20 * max(true[0], 1e-300)).sum()) if true[0] > 0 else 0
    assert len(variance) == min(32, rank)
    if rank:
        assert np.allclose(variance, true[: len(variance)], rtol=1e-9)
        assert np.abs(directions.T @ directions - np.eye(len(variance))).max() < 1e-10
        white = rows @ (directions / np.sqrt(variance))
        assert np.abs(white.T @ white / n - np.eye(len(variance))).max() < 1e-7
        assert math.isclose(trace, true.sum(), rel_tol=1e-9)


def test_dqds_is_accurate_for_small_values():
    rng = np.random.default_rng(1)
    diagonal, above = 10.0 ** -np.arange(0, 12, 0.5), 10.0 ** -np.arange(0.25, 11.5, 0.5) * rng.normal(size=23)
    found = whitening.squared_singular_values(diagonal, above)
    full = np.diag(diagonal) + np.diag(above, 1)
    # The determinant is the product of the diagonal, whatever lies above it.
    assert math.isclose(float(np.log(found).sum()), 2 * float(np.log(diagonal).sum()), rel_tol=1e-12)
    assert np.allclose(found[:8], np.linalg.svd(full, compute_uv=False)[:8] ** 2, rtol=1e-10)
    assert whitening.squared_singular_values(np.array([3.0, 0.0, 2.0]), np.array([1.0, 0.0])).min() == 0


def brute_whitening(vectors, most=32):
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * c) + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v in kept]
    n = len(x)
    total = [sum(r[d] for r in x) for d in range(width)]
    deviation = [sum((n * r[d] - total[d]) ** 2 for d in range(width)) for r in x]
    centred = np.array([[float(n * r[d] - total[d]) / n for d in range(width)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return kept, n, deviation, centred @ (v / np.sqrt(np.abs(e))), e / np.trace(centred.T @ centred / n), e


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, [float(np.float32(c)) for c in rng.normal(size=12) * np.arange(1, 13)]) for k in range(400)]
    vectors += [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] * 12)]
    vectors += [(5, vectors[5][1]), (None, [0.5] * 12), (904, [1.0, 2.0]), (905, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, n string").repartition(7)
    got = whitening.whitened(table, 6).collect()
    kept, n, deviation, white, explained, e = brute_whitening([(i, v) for i, v in vectors], 6)
    assert len(got) == 6 * len(kept) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    by_component = {c: sorted((r["vec_id"] is None, r["vec_id"] or 0, r["whitened"], r["deviation"]) for r in got if r["component"] == c) for c in range(1, 7)}
    for c in range(1, 7):
        assert math.isclose(next(r["explained"] for r in got if r["component"] == c), explained[c - 1], rel_tol=1e-9)
        want = [(i is None, i or 0, w, d) for (i, _), w, d in zip(kept, white[:, c - 1].tolist(), deviation)]
        straight = sorted(want)
        turned = sorted((a, b, -w, d) for a, b, w, d in want)
        for rows in (straight, turned):
            if np.allclose([r[2] for r in rows], [r[2] for r in by_component[c]], atol=1e-9):
                assert [r[3] for r in rows] == [r[3] for r in by_component[c]]
                break
        else:
            raise AssertionError(c)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).collect() == []
    assert len(whitening.whitened(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], schema)).collect()) == 2


def test_deviations_beyond_64_bits_are_null():
    centre = whitening.Centre(1 << 40, [5 << 40])
    assert centre.deviations(np.array([[3], [1 << 20]], np.int64)) == [9 << 80 if 9 << 80 < 1 << 63 else None, None]
    centre = whitening.Centre(1000, [7])
    assert centre.deviations(np.array([[4], [-(1 << 40)]], np.int64)) == [(4000 - 7) ** 2, None]


# --- best-fit packing ---


def check_packing(got, rows, width):
    tokens = [(i, PLAIN.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    want = []
    for i, ids in tokens:
        for piece, low in enumerate(range(0, len(ids), width)):
            part = np.array(ids[low : low + width], "<u4")
            want.append((i is None, i or 0, piece, low, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= width
    return len(sequences), -(-sum(w[4] for w in want) // width)


def test_pieces_lie_in_sequences_without_gaps(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["a", "the", "quick"]) for _ in range(rng.choice([0, 1, 3, 20, 63, 64, 150, 700])))) for k in range(300)]
    rows += [(None, "x y"), (None, None), (7, None), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int").repartition(5)
    for group_pieces in (1 << 14, 40):
        n, least = check_packing(swap_packing.pack(docs, width=64, group_pieces=group_pieces).collect(), rows, 64)
        # Some padding must stay: few pieces are short enough to fill what the last pieces of 61 leave.
        assert n <= 1.01 * least + (0 if group_pieces > 40 else 4)
    kept = swap_packing.pack(docs, width=64, keep_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in kept)
    assert swap_packing.pack(docs.limit(0)).collect() == []


def squares(bins, lengths):
    return sum(sum(lengths[k] for k in b) ** 2 for b in bins)


def test_local_search_empties_bins():
    # Best-fit with falling lengths takes three bins of ten; exchanges find two.
    lengths = [5, 4, 4, 3, 2, 2]
    start = swap_packing.best_fit(lengths, 10)
    found = swap_packing.improved(lengths, start, 10)
    assert len(found) == 2 and sorted(k for b in found for k in b) == list(range(6))
    rng = random.Random(4)
    better = 0
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(2, 400))]
        bins = [[k] for k in range(len(lengths))] if rng.random() < 0.3 else swap_packing.best_fit(lengths, 100)
        found = swap_packing.improved(lengths, bins, 100)
        assert sorted(k for b in found for k in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[k] for k in b) <= 100 for b in found)
        assert swap_packing.least_bins(lengths, 100) <= len(found) <= len(bins)
        assert squares(found, lengths) >= squares(bins, lengths)
        better += len(found) < len(bins)
    assert better > 10


@pytest.mark.parametrize("bins, left", [
    ([[6], [5, 4, 1]], 2),
    ([[3, 3, 3], [6, 3], [2]], 2),  # the short one is exchanged or moved away
    ([[4, 3], [4, 3], [3, 3]], 2),  # two for one, then moves
])
def test_steps_raise_the_squares(bins, left):
    lengths = [n for b in bins for n in b]
    ends = np.cumsum([0, *map(len, bins)])
    search = swap_packing.Search(lengths, [list(range(a, b)) for a, b in zip(ends, ends[1:])], 10)
    before = squares(search.bins, lengths)
    giver = int(np.argmax(search.room))
    while search.bins[giver] and search.step(giver):
        now = squares(search.bins, lengths)
        assert now > before and (search.room >= 0).all()
        assert search.room.tolist() == [10 - sum(lengths[k] for k in b) for b in search.bins]
        before = now
    assert len([b for b in search.bins if b]) >= left


def test_exchanges_of_each_kind():
    def after(bins, width=10):
        lengths = [n for b in bins for n in b]
        ends = np.cumsum([0, *map(len, bins)])
        search = swap_packing.Search(lengths, [list(range(a, b)) for a, b in zip(ends, ends[1:])], width)
        assert search.step(int(np.argmax(search.room)))
        return [sorted(lengths[k] for k in b) for b in search.bins]

    assert after([[5, 3], [4, 2]]) in ([[2, 3, 5], [4]], [[3, 5, 2], [4]])
    assert after([[7, 2], [5, 3]]) == [[3, 7], [2, 5]]
    assert after([[5, 4], [3, 3]]) == [[3, 3, 4], [5]]
    assert after([[4, 2, 3], [7]]) == [[3, 7], [2, 4]]


# --- Merkle manifest ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, add=0):
    i, text, lang, source, n = row
    return h(*map(field, (i, source, lang, n if n is None else n + add, text)))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def brute_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    order = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in order:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = climb([leaf(r) for r in by_lang[lang]])
    upper = climb([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for place, r in enumerate(by_lang[lang]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, proof = leaf(r, 1 if bad else 0), ""
            for levels, at in ((trees[lang], place), (upper, k)):
                for nodes in levels[:-1]:
                    low = at - at % 2
                    run = nodes[low : low + 2]
                    proof += "".join(s for j, s in enumerate(run) if low + j != at)
                    node = h(*[node if low + j == at else s for j, s in enumerate(run)])
                    at //= 2
            root = upper[-1][0]
            out.append((r[0], leaf(r), trees[lang][-1][0], root, h(proof), node, node == root))
    return out


def documents(n, langs, seed=0):
    rng = random.Random(seed)
    rows = [
        (k, "".join(rng.choice("aé中 \n:") for _ in range(rng.randint(0, 9))), rng.choice(langs), rng.choice(["web", None]), rng.choice([None, 0, 9, 123]))
        for k in range(n)
    ]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_brute_force(spark, levels, monkeypatch):
    # Smaller blocks need several rounds up and down.
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = documents(77 if levels < 10 else 300, ["en", "en", "en", "é", "", None, "z"])
    rows += [(None, None, None, None, None), (None, "t", "en", "s", 1), (5, "twice", "en", None, 3), (5, "twice", "en", None, 3), (99, None, "solo", None, 4)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOCS + ", leaf int").repartition(5)
    got = merkle.manifest(docs, keep_copies=True).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    want = sorted(brute_manifest(rows), key=key)
    assert sorted([tuple(r)[:7] for r in got], key=key) == want
    assert sum(not w[6] for w in want) > 3
    for r in got:
        if r["copies"] is not None:
            # A version copies the leaf and its ancestors, nothing else, and ends in its root.
            assert r["copies"][-1] == r["folded_root"]


@pytest.mark.parametrize("rows", [[], [(0, "a", "en", "s", 1)], [(0, "a", None, "s", None)], documents(2, ["en"]), documents(3, ["a", "b"], 1)])
def test_manifest_of_few(spark, rows):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted(brute_manifest(rows), key=str)
