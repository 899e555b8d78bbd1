"""Places of regular expressions in texts, with built-in functions only.

Values that run along a list (places, ends so far) are carried in runs of about the
square root of its length, so that no list is copied for each of its elements: the cost
grows with the text plus the number of matches to the power of 1.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:int,`end`:int,found:string,left:string,right:string>>"
#: Code points around a match that are kept: before it, since the match before, and after it.
LEFT, RIGHT = 30, 1
LEAST_RUN = 64


def none_found() -> Column:
    return F.array().cast(FOUND)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often lambdas in ``body`` refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, zero: Column, weigh: Callable, join: Callable, emit: Callable) -> Column:
    """``emit(before, item)`` for each item in turn, ``before`` being what ``join`` makes of the earlier items' ``weigh``."""

    def whole(items: Column) -> Column:
        n = F.size(items)
        run = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(LEAST_RUN))
        count = F.ceil(n / run).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(items, k * run + 1, run))
        return bound(runs, over)

    def over(runs: Column) -> Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, zero, lambda a, i: join(a, weigh(i))))
        return bound(totals, lambda t: F.flatten(F.zip_with(runs, befores(t), one)))

    def befores(totals: Column) -> Column:
        return F.transform(totals, lambda _, k: F.aggregate(F.slice(totals, F.lit(1), k), zero, lambda a, b: join(a, b)))

    def one(run: Column, first: Column) -> Column:
        def add(state: Column, item: Column) -> Column:
            return F.struct(join(state["at"], weigh(item)).alias("at"), F.concat(state["out"], F.array(emit(state["at"], item))).alias("out"))

        start = F.struct(first.alias("at"), F.slice(F.array(emit(first, F.get(run, F.lit(0)))), 1, 0).alias("out"))
        return F.aggregate(run, start, add, lambda state: state["out"])

    return bound(items, whole)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``(start, end, found, left, right)``, in code points, end exclusive.

    What lies between the matches and the matches themselves, in turn, make up the
    text, so the lengths of both give the places. ``group`` chooses what ``found``
    holds; ``left`` is the end of what lies between the match before and this one,
    ``right`` the beginning of what follows. ``pattern`` must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(between, found, kept).cast("array<struct<between:string,found:string,kept:string>>")

    def placed(rows: Column) -> Column:
        # The last piece has no match behind it.
        parts = F.transform(
            F.slice(rows, F.lit(1), F.size(rows) - 1),
            lambda p, i: F.struct(
                F.char_length(p["between"]).alias("before"), F.char_length(p["found"]).alias("size"), p["kept"].alias("found"),
                F.right(p["between"], F.lit(LEFT)).alias("left"), F.left(F.get(rows, i + 1)["between"], F.lit(RIGHT)).alias("right"),
            ),
        )
        return running(
            parts, F.lit(0), lambda p: p["before"] + p["size"], lambda a, b: a + b,
            lambda at, p: F.struct(
                (at + p["before"]).alias("start"), (at + p["before"] + p["size"]).alias("end"),
                p["found"].alias("found"), p["left"].alias("left"), p["right"].alias("right"),
            ),
        ).cast(FOUND)

    return F.when(text.rlike(pattern), bound(zipped, placed)).otherwise(none_found())


def spans(found: Column, order: int, kind: str) -> Column:
    """Matches as ``(start, rank, kind, end)``, which sort by start and then by the kind's rank."""
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    )


def written(listed: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(
        F.transform(F.array_sort(listed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def apart_from(found: Column, listed: Column) -> Column:
    """The matches that overlap none of the spans, in order."""

    def marked(item: Column, own: bool, m: Column) -> Column:
        return F.struct(item["start"].alias("start"), F.lit(int(own)).alias("own"), item["end"].alias("end"), m.alias("m"))

    none = F.lit(None).cast(FOUND[len("array<") : -1])
    # A span that starts no later overlaps if it ends behind the match's start, a later one if it starts before its end.
    low, high = F.lit(-1), F.lit((1 << 31) - 1)
    kept = lambda i, bad: F.struct(i["start"].alias("start"), i["own"].alias("own"), i["end"].alias("end"), i["m"].alias("m"), bad.alias("bad"))

    def free(both: Column) -> Column:
        forth = running(
            both, low, lambda i: F.when(i["own"] == 0, i["end"]).otherwise(low), F.greatest, lambda at, i: kept(i, at > i["start"])
        )
        back = running(
            F.reverse(forth), high, lambda i: F.when(i["own"] == 0, i["start"]).otherwise(high), F.least,
            lambda at, i: kept(i, i["bad"] | (at < i["end"])),
        )
        return F.transform(F.filter(F.reverse(back), lambda i: (i["own"] == 1) & ~i["bad"]), lambda i: i["m"])

    def chosen(found: Column) -> Column:
        both = F.array_sort(F.concat(
            F.transform(listed, lambda s: marked(s, False, none)), F.transform(found, lambda m: marked(m, True, m))
        ))
        return F.when((F.size(found) > 0) & (F.size(listed) > 0), free(both)).otherwise(found)

    return bound(found, chosen)


def masked(text: Column, listed: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the place."""
    names = running(
        F.array_sort(listed), F.lit(0), lambda s: s["end"], F.greatest,
        lambda at, s: F.struct(at.alias("from"), s["start"].alias("start"), s["kind"].alias("kind")),
    )
    end = F.aggregate(listed, F.lit(0), lambda a, s: F.greatest(a, s["end"]))

    def pieces(named: Column) -> Column:
        n = F.size(named)
        run = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(LEAST_RUN))
        runs = F.transform(F.sequence(F.lit(0), F.ceil(n / run).cast("int") - 1), lambda k: F.slice(named, k * run + 1, run))
        return F.array_join(F.transform(runs, cut), "")

    def cut(run: Column) -> Column:
        """One substring of the text for a run, and the gaps out of that."""
        low, high = F.get(run, F.lit(0))["from"], F.element_at(run, F.lit(-1))["start"]

        def gaps(part: Column) -> Column:
            return F.array_join(
                F.transform(run, lambda s: F.concat(
                    F.substring(part, s["from"] - low + 1, s["start"] - s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]")
                )),
                "",
            )

        return bound(F.substring(text, low + 1, high - low), gaps)

    first = F.filter(names, lambda s: s["start"] >= s["from"])
    done = F.concat(bound(first, pieces), F.substring(text, end + 1, F.char_length(text)))
    return F.when(F.size(listed) > 0, done).otherwise(text)
