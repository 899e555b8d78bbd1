"""Running totals and row numbers that never put one group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.operators.joins import fits
from cohortloom.session import stage

WINDOW_ROWS = 500_000


def running_total(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: Column,
    name: str,
    window_rows: int = WINDOW_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the group, exclusive.

    ``order`` must be unique within a group. A table of at most ``window_rows``
    rows takes a plain window; the caller may pass a known bound as ``rows`` to
    spare the count. A larger one is range-partitioned by group and
    order, so that a hot group spans many slices; each slice sums locally and
    adds the totals of the group's earlier slices. A null group is a group.
    """
    valued = df.withColumn("_value", value)
    before = (Window.unboundedPreceding, -1)
    small = rows <= window_rows if rows is not None else fits(valued.select("_value"), window_rows)
    if small:
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order).rowsBetween(*before)
        return valued.withColumn(name, F.coalesce(F.sum("_value").over(w), F.lit(0))).drop("_value")

    keys = group + order
    # The slice number must not change between the two uses below, so it is stored.
    sliced = stage(
        valued.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    totals = sliced.groupBy(*group, "_slice").agg(F.sum("_value").alias("_total"))
    # One row per slice and group: at most the number of shuffle partitions each.
    w_slices = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_slice").rowsBetween(*before)
    offsets = totals.select(
        *group, "_slice", F.coalesce(F.sum("_total").over(w_slices), F.lit(0)).alias("_offset")
    )
    w_local = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(*before)
    local = sliced.withColumn("_local", F.coalesce(F.sum("_value").over(w_local), F.lit(0)))
    named = offsets.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_slice").alias("_of"), "_offset")
    same = F.col("_slice") == F.col("_of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return (
        local.join(named, same)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_value", "_slice", "_local", "_offset", "_of", *[f"_of_{g}" for g in group])
    )


def number_rows(
    df: DataFrame,
    group: list[str],
    order: list[str],
    name: str,
    window_rows: int = WINDOW_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``name``: 0-based position within the group."""
    return running_total(df, group, order, F.lit(1).cast("bigint"), name, window_rows, rows)
