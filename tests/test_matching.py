"""Matching against a plain sequential greedy matcher on small random arms."""

import bisect
import random
import time

import pytest

from cohortloom.operators import matching as M


def greedy(cases, controls, ratio, caliper=None, fill="rounds"):
    """One case at a time, highest score first; nearest free control, lower score and id on ties."""
    order = sorted(cases, key=lambda c: (-c[1], c[0]))
    free = set(controls)
    pairs = set()

    def take(case):
        best = min(free, key=lambda c: (abs(c[1] - case[1]), c[1], c[0]), default=None)
        if best is None or (caliper is not None and abs(best[1] - case[1]) > caliper):
            return
        free.discard(best)
        pairs.add((case[0], best[0]))

    if fill == "rounds":
        for _ in range(ratio):
            for case in order:
                take(case)
    else:
        for case in order:
            for _ in range(ratio):
                take(case)
    return pairs


def nearest_free(cases, controls, ratio):
    """``greedy`` in rounds for distinct scores and many people: links jump over controls that are taken."""
    scores = sorted((s, i) for i, s in controls)
    n = len(scores)
    up, down = list(range(n + 2)), list(range(n + 2))

    def free(links, k):
        root = k
        while links[root] != root:
            root = links[root]
        while links[k] != root:
            links[k], k = root, links[k]
        return root

    order = [(s, i, bisect.bisect_right(scores, (s, float("inf")))) for i, s in sorted(cases, key=lambda c: -c[1])]
    pairs = set()
    for _ in range(ratio):
        for score, case, place in order:
            low, high = free(down, place), free(up, place + 1)
            if low == 0 and high == n + 1:
                return pairs
            gap_low = score - scores[low - 1][0] if low else float("inf")
            gap_high = scores[high - 1][0] - score if high <= n else float("inf")
            k = low if gap_low <= gap_high else high
            up[k], down[k] = k + 1, k - 1
            pairs.add((case, scores[k - 1][1]))
    return pairs


def random_arms(rng, n_cases, n_controls, spread):
    ids = rng.sample(range(1, 10_000), n_cases + n_controls)
    people = [(i, rng.randint(0, spread) / 8) for i in ids]
    return people[:n_cases], people[n_cases:]


def run(spark, cases, controls, **options):
    rows = [(i, True, s) for i, s in cases] + [(i, False, s) for i, s in controls]
    df = spark.createDataFrame(rows, "patid bigint, arm boolean, score double")
    got = M.match_nearest(df, "arm", "score", **options).collect()
    pairs = {(r.case_id, r.control_id) for r in got}
    assert len(pairs) == len(got)
    return pairs


@pytest.mark.parametrize("seed", range(6))
def test_one_block_equals_greedy(spark, seed):
    rng = random.Random(seed)
    cases, controls = random_arms(rng, rng.randint(1, 25), rng.randint(1, 80), rng.choice([4, 30, 400]))
    ratio = rng.randint(1, 5)
    assert run(spark, cases, controls, ratio=ratio) == greedy(cases, controls, ratio)


@pytest.mark.parametrize("seed", range(6))
def test_many_blocks_equal_greedy(spark, seed):
    rng = random.Random(100 + seed)
    cases, controls = random_arms(rng, rng.randint(5, 20), rng.randint(10, 60), rng.choice([40, 400]))
    ratio = rng.randint(1, 4)
    fill, caliper = "per_case" if seed > 2 else "rounds", 2.0 if seed % 2 else None
    got = run(
        spark, cases, controls, ratio=ratio, block_rows=rng.choice([4, 8]),
        window_rows=0 if seed < 2 else 1000, fill=fill, caliper=caliper,
    )
    assert got == greedy(cases, controls, ratio, caliper, fill)


@pytest.mark.parametrize("blocks", [2, 4, 8, 16])
@pytest.mark.parametrize("n_controls", [400, 2000])
def test_turns_stay_few_whether_controls_suffice_or_not(spark, blocks, n_controls):
    rng = random.Random(blocks + n_controls)
    scores = rng.sample(range(1_000_000), 60 + n_controls)
    cases = [(i, s / 1e6) for i, s in enumerate(scores[:60])]
    controls = [(1000 + i, s / 1e6) for i, s in enumerate(scores[60:])]
    turns = []
    got = run(spark, cases, controls, ratio=10, block_rows=len(scores) // blocks, turns=turns)
    assert got == greedy(cases, controls, 10)
    assert len(turns) <= 20 and sum(turns) == min(600, n_controls)


def test_one_segment_of_many_blocks_takes_time_with_its_rows(spark):
    """Too few controls: nearly all rows are one segment, which took minutes when it was walked with the square of its rows."""
    rng = random.Random(3)
    scores = rng.sample(range(10**9), 27_000)
    cases = [(i, round((s / 1e9) ** 0.7, 12)) for i, s in enumerate(scores[:2_500])]
    controls = [(10_000 + i, s / 1e9) for i, s in enumerate(scores[2_500:])]
    assert len({s for _, s in cases + controls}) == len(scores)
    small = greedy(cases[:40], controls[:300], 10)
    assert nearest_free(cases[:40], controls[:300], 10) == small
    turns, began = [], time.monotonic()
    got = run(spark, cases, controls, ratio=10, block_rows=2_500, turns=turns)
    assert got == nearest_free(cases, controls, 10)
    assert len(turns) > 1 and time.monotonic() - began < 120


def test_a_score_that_is_no_number_is_left_out(spark):
    nan = float("nan")
    assert run(spark, [(1, nan), (2, 0.5)], [(3, nan), (4, 0.4)], ratio=2) == {(2, 4)}


@pytest.mark.parametrize("fill", ["rounds", "per_case"])
def test_caliper_and_fill(spark, fill):
    rng = random.Random(7)
    cases, controls = random_arms(rng, 15, 40, 60)
    got = run(spark, cases, controls, ratio=3, caliper=0.5, fill=fill)
    assert got == greedy(cases, controls, 3, 0.5, fill)


def test_hot_score_group_is_expanded_in_runs(spark, monkeypatch):
    monkeypatch.setattr(M, "EXPAND_ROWS", 7)
    cases = [(i, 1.0) for i in range(30)]
    controls = [(1000 + i, 1.0) for i in range(100)]
    got = run(spark, cases, controls, ratio=2, window_rows=0)
    assert got == greedy(cases, controls, 2)


def test_no_controls_or_no_cases(spark):
    assert run(spark, [(1, 0.5)], [], ratio=2) == set()
    assert run(spark, [], [(1, 0.5)], ratio=2) == set()


def test_more_cases_than_controls(spark):
    cases = [(i, float(i % 3)) for i in range(12)]
    controls = [(100 + i, float(i % 2)) for i in range(5)]
    assert run(spark, cases, controls, ratio=3) == greedy(cases, controls, 3)
