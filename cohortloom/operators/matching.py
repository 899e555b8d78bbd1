"""Nearest-neighbour matching 1:k without replacement.

Cases choose in order of priority, highest score first; each takes the nearest
control still free. People with equal scores are interchangeable up to the tie
rule, so the work runs over counted score groups; people appear only at the end,
when the group counts are expanded and joined back by group and number.

Where the work can be cut. Walk down the scores and let every case add the units
it asks for to a queue and every control group serve from it; do the same upwards.
A case can only reach past a place if one of the two queues is not empty there:
the controls it passes are all taken, and those who took them came from the same
side, so more was asked for than there was. Where both queues are empty the
scores fall apart into segments that know nothing of each other. Segments are
settled in parallel, each by one sweep per round.

If demand is so high that a segment outgrows a task, the first half of all choices
is settled before the second half is looked at: later choices never change earlier
ones. The fewer choices, the shorter the segments; a segment has at most three
rows for each unit asked for.

Ties: controls by score gap, then lower score, then lower id; cases by higher
score, then lower id.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.operators.numbering import WINDOW_ROWS, number_rows, running_total
from cohortloom.session import discard, stage, stage_measured

# The segment helper travels with its task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCORE_DIGITS = 12
BLOCK_ROWS = 500_000
#: A task takes a segment of so many blocks whole.
LONGEST = 4
EXPAND_ROWS = 10_000

_TAKEN = "rank bigint, match_round int, case_score double, control_score double, units bigint"


def match_nearest(
    df: DataFrame,
    treatment: str,
    score: str,
    ratio: int = 1,
    unit: str = "patid",
    caliper: float | None = None,
    fill: str = "rounds",
    block_rows: int = BLOCK_ROWS,
    window_rows: int = WINDOW_ROWS,
    turns: list[int] | None = None,
) -> DataFrame:
    """Pairs ``case_id, control_id, match_round, case_score, control_score``.

    ``fill='rounds'`` gives every case its r-th control before any gets its next;
    ``'per_case'`` gives one case all its controls before the next case chooses.
    ``caliper`` is the largest score gap allowed. Members whose score is null or
    not a number cannot be matched. The row bounds size tasks; they never change
    the result. ``turns`` collects the number of choices settled by each turn.
    ``df`` is read three times: store it first if it is costly to compute.
    """
    if fill not in ("rounds", "per_case"):
        raise ValueError(f"fill must be 'rounds' or 'per_case', not {fill!r}")
    people = df.select(
        F.col(unit).alias("id"),
        F.col(treatment).alias("treated"),
        F.round(F.col(score).cast("double"), SCORE_DIGITS).alias("score"),
    ).where(F.col("score").isNotNull() & ~F.isnan("score"))
    groups, size = stage_measured(
        people.groupBy("score", "treated").agg(F.count(F.lit(1)).alias("n")),
        "groups",
        case_groups=F.count_if("treated"),
        control_groups=F.count_if(~F.col("treated")),
        cases=F.sum(F.when(F.col("treated"), F.col("n")).otherwise(0)),
        controls=F.sum(F.when(F.col("treated"), 0).otherwise(F.col("n"))),
    )
    each = ratio if fill == "per_case" else 1
    asking = running_total(
        groups.where("treated").select("score", (F.col("n") * each).alias("units"), (-F.col("score")).alias("_down")),
        [], ["_down"], F.col("units"), "start", window_rows, size["case_groups"],
    ).drop("_down")
    matcher = _Matcher(
        groups.where("not treated").select("score", F.col("n").alias("room")),
        stage(asking, "asking"),
        (size["cases"] or 0) * each,
        size["case_groups"] + size["control_groups"],
        caliper,
        block_rows,
        turns if turns is not None else [],
    )
    wanted = matcher.round_units * (1 if fill == "per_case" else ratio)
    # Without a caliper every choice finds a control until none is left.
    matcher.settle(0, wanted if caliper is not None else min(wanted, size["controls"] or 0))
    # Each allocation uses up a control group or a proposer, or ends its turn.
    allocations = size["control_groups"] + (size["case_groups"] + len(matcher.turns)) * (ratio + 1)
    pairs = _expand(matcher.taken(), ratio, fill, window_rows, allocations)

    numbered_cases = number_rows(
        people.where("treated").select(F.col("score").alias("case_score"), F.col("id").alias("case_id")),
        ["case_score"], ["case_id"], "case_no", window_rows, size["cases"],
    )
    numbered_controls = number_rows(
        people.where("not treated").select(
            F.col("score").alias("control_score"), F.col("id").alias("control_id")
        ),
        ["control_score"], ["control_id"], "control_no", window_rows, size["controls"],
    )
    return (
        pairs.join(numbered_cases, ["case_score", "case_no"])
        .join(numbered_controls, ["control_score", "control_no"])
        .select("case_id", "control_id", "match_round", "case_score", "control_score")
    )


class _Matcher:
    """Settles the choices, numbered by round and then by falling score.

    ``slots``: ``score, room``; ``asking``: ``score, units, start``, where ``start``
    counts the units of one round asked for at higher scores.
    """

    def __init__(
        self, slots: DataFrame, asking: DataFrame, round_units: int, groups: int,
        caliper: float | None, block_rows: int, turns: list[int],
    ):
        self.slots, self.asking, self.round_units, self.groups = slots, asking, round_units, groups
        self.caliper, self.block_rows, self.turns = caliper, block_rows, turns
        self.parts: list[DataFrame] = []
        self.served = 0

    def settle(self, first: int, last: int) -> None:
        """Settle the choices ``first`` to ``last`` (exclusive), all earlier ones being settled."""
        if first >= last:
            return
        self._serve()
        binned, longest, walked = _binned(self._rows(first, last), self.block_rows, self.groups)
        if longest > LONGEST * self.block_rows and last - first > self.block_rows:
            middle = (first + last) // 2
            whole_rounds = middle - middle % self.round_units
            if first < whole_rounds:
                middle = whole_rounds
            elif middle - middle % self.round_units + self.round_units < last:
                middle += self.round_units - middle % self.round_units
            discard(walked)
            self.settle(first, middle)
            self.settle(middle, last)
            return
        caliper, units = self.caliper, self.round_units

        def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
            return _sweep(pdf, first, last, units, caliper)

        taken = stage(binned.groupBy("bin").applyInPandas(sweep, _TAKEN), "taken")
        self.parts.append(taken)
        self.turns.append(last - first)
        discard(walked)

    def _serve(self) -> None:
        """Take what the last turn used from the free control groups."""
        if len(self.parts) == self.served:
            return
        used = self.parts[-1].groupBy(F.col("control_score").alias("score")).agg(F.sum("units").alias("_used"))
        left = F.col("room") - F.coalesce("_used", F.lit(0))
        free = self.slots.join(used, "score", "left").select("score", left.alias("room")).where("room > 0")
        old, self.slots = self.slots, stage(free, "free")
        self.served = len(self.parts)
        discard(old)

    def _rows(self, first: int, last: int) -> DataFrame:
        """Free control groups and the case groups with what they ask for, as one column of signed units."""
        n = max(self.round_units, 1)
        low, high = first // n, (last - 1) // n
        start, end = F.col("start"), F.col("start") + F.col("units")

        def within(a: int, b: int) -> Column:
            return F.greatest(F.least(end, F.lit(b)) - F.greatest(start, F.lit(a)), F.lit(0))

        if low == high:
            asked = within(first - low * n, last - low * n)
        else:
            asked = within(first - low * n, n) + within(0, last - high * n) + F.col("units") * (high - low - 1)
        cases = self.asking.select("score", F.lit(0).alias("is_slot"), asked.alias("asks"), "units", "start").where("asks > 0")
        free = self.slots.select(
            "score", F.lit(1).alias("is_slot"), (-F.col("room")).alias("asks"), F.col("room").alias("units"),
            F.lit(None).cast("bigint").alias("start"),
        )
        return cases.unionByName(free)

    def taken(self) -> DataFrame:
        if not self.parts:
            return self.asking.sparkSession.createDataFrame([], _TAKEN)
        every = self.parts[0]
        for part in self.parts[1:]:
            every = every.unionByName(part)
        return every


def _binned(rows: DataFrame, block_rows: int, most: int) -> tuple[DataFrame, int, DataFrame]:
    """Rows of independent segments numbered by bin, the size of the largest bin, and the stored rows.

    ``most`` bounds the number of rows: up to a block they are one bin. Beyond,
    rows are range-partitioned into slices, and what passes through the driver is
    a few numbers per slice. Segments that begin in the same block share a bin;
    bins that nobody asks in are left out.
    """
    if most <= block_rows:
        return rows.withColumn("bin", F.lit(0)), most, rows
    order = ["_down", "is_slot"]
    sliced = stage(
        rows.withColumn("_down", -F.col("score")).repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()),
        "segments",
    )
    within = Window.partitionBy("_slice").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    # Taken backwards: Spark works a frame up to the last row out anew for every row.
    ahead = Window.partitionBy("_slice").orderBy(F.desc("_down"), F.desc("is_slot")).rowsBetween(Window.unboundedPreceding, 0)
    # A queue is the running sum less its least value so far, or less what came in.
    walked = (
        sliced.withColumn("_sum", F.sum("asks").over(so_far))
        .withColumn("_low", F.min("_sum").over(so_far))
        .withColumn("_rest", F.sum("asks").over(ahead))
        .withColumn("_rest_low", F.min("_rest").over(ahead))
        .withColumn("_no", F.row_number().over(within))
    )
    slices = walked.groupBy("_slice").agg(
        F.sum("asks").alias("total"), F.min("_sum").alias("low"), F.min("_rest").alias("rest_low"), F.count(F.lit(1)).alias("n")
    ).orderBy("_slice").collect()
    down, offset, known = 0, 0, {}
    for s in slices:
        known[s._slice] = [down, 0, offset, down == 0]
        down = max(down + s.total, s.total - s.low)
        offset += s.n
    up = 0
    for s in reversed(slices):
        known[s._slice][1] = up
        up = max(up + s.total, s.total - s.rest_low)
        known[s._slice][3] = known[s._slice][3] and up == 0
    spark = rows.sparkSession
    came = spark.createDataFrame(
        [(k, *v) for k, v in known.items()], "_slice int, _down_in bigint, _up_in bigint, _offset bigint, _top boolean"
    )
    marked = (
        walked.join(F.broadcast(came), "_slice")
        .withColumn("_queue", F.greatest(F.col("_down_in") + F.col("_sum"), F.col("_sum") - F.col("_low")))
        .withColumn("_queue_up", F.greatest(F.col("_up_in") + F.col("_rest"), F.col("_rest") - F.col("_rest_low")))
        .withColumn("_before", F.lag("_queue").over(within))
    )
    begins = F.when(F.col("_no") == 1, F.col("_top")).otherwise((F.col("_before") == 0) & (F.col("_queue_up") == 0))
    place = F.col("_offset") + F.col("_no") - 1
    # Stored, or the windows would be worked out for each of the three uses below.
    begun = stage(
        marked.withColumn("_segment", F.max(F.when(begins, place)).over(so_far))
        .select("score", "is_slot", "asks", "units", "start", "_slice", "_segment"),
        "walked",
    )
    discard(sliced)
    last, carried = 0, []
    for s, most_recent in begun.groupBy("_slice").agg(F.max("_segment")).orderBy("_slice").collect():
        carried.append((s, last))
        last = last if most_recent is None else most_recent
    carry = F.broadcast(spark.createDataFrame(carried, "_slice int, _carried bigint"))
    segment = F.coalesce("_segment", "_carried")
    binned = begun.join(carry, "_slice").withColumn("bin", F.floor(segment / block_rows))
    asked = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("is_slot").alias("_idle")).where("_idle = 0")
    longest = asked.agg(F.max("n")).first()[0] or 0
    kept = binned.join(asked.select("bin"), "bin", "left_semi")
    return kept.select("bin", "score", "is_slot", "asks", "units", "start"), longest, begun


def _sweep(pdf: pd.DataFrame, first: int, last: int, round_units: int, caliper: float | None) -> pd.DataFrame:
    """The choices ``first`` to ``last`` of one bin, round by round from the highest score down.

    Controls below the current case that are taken lie directly below it, so one
    place marks the next free one there; free controls above are a stack whose top
    is the nearest.
    """
    slots = pdf[pdf["is_slot"] == 1].sort_values("score", ascending=False)
    cases = pdf[pdf["is_slot"] == 0].sort_values("score", ascending=False)
    scores, room = slots["score"].tolist(), slots["units"].astype("int64").tolist()
    asking = list(zip(cases["score"].tolist(), cases["units"].astype("int64").tolist(), cases["start"].astype("int64").tolist()))
    n, far = len(scores), float("inf")
    taken = []
    for turn in range(first // round_units, (last - 1) // round_units + 1):
        base = turn * round_units
        passed = below = 0
        above: list[int] = []
        for score, units, start in asking:
            wanted = min(base + start + units, last) - max(base + start, first)
            if wanted <= 0:
                continue
            while passed < n and scores[passed] > score:
                if room[passed]:
                    above.append(passed)
                passed += 1
            below = max(below, passed)
            while wanted:
                while below < n and not room[below]:
                    below += 1
                while above and not room[above[-1]]:
                    above.pop()
                gap_below = score - scores[below] if below < n else far
                gap_above = scores[above[-1]] - score if above else far
                gap = min(gap_below, gap_above)
                if gap == far or (caliper is not None and gap > caliper):
                    break
                k = below if gap_below <= gap_above else above[-1]
                moved = min(wanted, room[k])
                room[k] -= moved
                wanted -= moved
                taken.append((base + start, turn + 1, score, scores[k], moved))
    return pd.DataFrame(taken, columns=["rank", "match_round", "case_score", "control_score", "units"]).astype(
        {"rank": "int64", "match_round": "int32", "case_score": "float64", "control_score": "float64", "units": "int64"}
    )


def _expand(
    allocated: DataFrame, ratio: int, fill: str, window_rows: int, rows: int
) -> DataFrame:
    """One row per pair, with the members' numbers within their score groups."""
    known = (
        allocated.groupBy("rank", "match_round", "case_score", "control_score")
        .agg(F.sum("units").alias("units"))
        .withColumn("gap", F.abs(F.col("control_score") - F.col("case_score")))
    )
    by_case = running_total(
        known, ["rank"], ["gap", "control_score"], F.col("units"), "case_start", window_rows, rows
    )
    both = running_total(
        by_case, ["control_score"], ["rank"], F.col("units"), "control_start", window_rows, rows
    )
    # A large allocation is cut into runs, and the runs are spread before each
    # becomes rows, so no task has to expand a whole group.
    runs = both.select(
        "match_round", "case_score", "control_score", "case_start", "control_start", "units",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("units") - 1, F.lit(EXPAND_ROWS).cast("bigint"))).alias("run"),
    ).repartition("case_score", "control_score", "match_round", "run")
    seats = runs.select(
        "match_round", "case_score", "control_score", "case_start", "control_start",
        F.explode(
            F.sequence(F.col("run"), F.least(F.col("run") + EXPAND_ROWS, F.col("units")) - 1)
        ).alias("seat"),
    )
    turn = F.col("case_start") + F.col("seat")
    control_no = (F.col("control_start") + F.col("seat")).alias("control_no")
    if fill == "rounds":
        return seats.select("match_round", "case_score", "control_score", turn.alias("case_no"), control_no)
    return seats.select(
        (turn % ratio + 1).cast("int").alias("match_round"),
        "case_score",
        "control_score",
        F.floor(turn / ratio).cast("bigint").alias("case_no"),
        control_no,
    )


def matched_members(
    matches: DataFrame, df: DataFrame, unit: str = "patid", score: str | None = None
) -> DataFrame:
    """Matched sets in long form: one row per member with ``subclass`` and ``weights``.

    A set is named by its case. The case weighs 1 and its controls share 1
    between them. All other columns of ``df`` are carried along.
    """
    # A set has at most ``ratio`` rows. Its first row also brings in the case.
    in_set = Window.partitionBy("case_id")
    first = F.row_number().over(in_set.orderBy("match_round", "control_id")) == 1
    share = 1.0 / F.count(F.lit(1)).over(in_set)

    def member(who: str, weight):
        return F.struct(F.col(who).alias(unit), weight.alias("weights"))

    control, case = member("control_id", F.col("_share")), member("case_id", F.lit(1.0))
    members = (
        matches.select("case_id", "control_id", share.alias("_share"), first.alias("_first"))
        .select(
            F.col("case_id").alias("subclass"),
            F.explode(F.when(F.col("_first"), F.array(control, case)).otherwise(F.array(control))).alias("m"),
        )
        .select("m.*", "subclass")
    )
    carried = df if score is None else df.withColumnRenamed(score, "distance")
    return members.join(carried, unit)


def subclass_index(members: DataFrame, index: str = "index_date") -> DataFrame:
    """Index date of each matched set: its latest, that is the case's."""
    return members.groupBy("subclass").agg(F.max(index).alias("new_index_date"))


def assign_index(members: DataFrame, index: str = "index_date") -> DataFrame:
    """Give every member the index date of its set's case.

    One shuffle: a window over the set, which holds a case and its controls.
    """
    latest = F.max(index).over(Window.partitionBy("subclass"))
    return members.withColumn("new_index_date", latest)
