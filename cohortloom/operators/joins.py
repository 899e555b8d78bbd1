"""Joins against a side that is usually, but not provably, small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DataType, StringType

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Bytes a row takes besides its text, and what a nested value counts for.
_ROW, _NESTED = 16, 64


def _size(name: str, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 8
    if kind.typeName() in ("array", "map", "struct"):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0)) + _NESTED
    return F.lit(8)


def fits(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes; reading stops past the rows."""
    few = df.limit(max_rows + 1)
    if max_bytes is None:
        return few.count() <= max_rows
    size = F.lit(_ROW)
    for field in df.schema.fields:
        size = size + _size(field.name, field.dataType)
    rows, total = few.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return rows <= max_rows and (total or 0) <= max_bytes


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``big`` to a lookup side whose size is checked first, in rows and in bytes.

    A lookup within both bounds is broadcast, so ``big`` is not shuffled. A larger
    one meets ``big`` in a merge join; the adaptive skew join splits the rows of a
    hot code, and only that code's lookup rows are copied. Null keys match nothing
    either way.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot split a {how} join")
    keys = [on] if isinstance(on, str) else list(on)
    needed = small.select(*keys) if how in ("left_semi", "left_anti") else small
    if fits(needed, max_rows, max_bytes):
        return big.join(F.broadcast(needed), keys, how)
    return big.join(needed.hint("merge"), keys, how)
