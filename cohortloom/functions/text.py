"""Column expressions over codes and names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

BYTE_ORDER_MARK = "﻿"


def clean_code(code: Column) -> Column:
    """Trimmed code without byte-order mark; a blank becomes NULL."""
    bare = F.trim(F.regexp_replace(code.cast("string"), f"[{BYTE_ORDER_MARK}\\r]", ""))
    return F.when(bare != "", bare)


def undotted(code: Column) -> Column:
    return F.upper(F.replace(code, F.lit("."), F.lit("")))


def words(text: Column) -> Column:
    """Lower-case alphanumeric words, in order."""
    spaced = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(spaced != "", F.split(spaced, " ", -1))


def normal_name(text: Column) -> Column:
    return F.array_join(words(text), " ")


def mentions(text: Column, terms: Iterable[str], regex: bool = True) -> Column:
    """Case-insensitive search for any of the alternatives; NULL text never matches.

    Blank terms are left out, since they would match every text; without any other
    there is nothing to search for, which is an error.
    """
    wanted = [t for t in terms if t and t.strip()]
    if not wanted:
        raise ValueError("no term to search for")
    parts = wanted if regex else [re.escape(t) for t in wanted]
    return F.coalesce(text.rlike("(?i)" + "|".join(parts)), F.lit(False))
