"""Counts, numeric summaries and covariate balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.operators.numbering import WINDOW_ROWS, running_total
from cohortloom.session import stage


def count_by(df: DataFrame, columns: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def describe_by(df: DataFrame, group: str, value: str, digits: int = 2) -> DataFrame:
    """Sample standard deviation, mean, ``min - max`` text and non-null count per group."""
    x = F.col(value)
    form = f"%.{digits}f - %.{digits}f"
    return df.groupBy(group).agg(
        F.stddev_samp(x).alias("sd"),
        F.avg(x).alias("mean"),
        F.when(F.min(x).isNotNull(), F.format_string(form, F.min(x), F.max(x))).alias("range"),
        F.count(x).alias("n"),
    )


def summary_tables(df: DataFrame, name: str = "outcome", group: str = "case_control") -> DataFrame:
    """Cross-tabulated counts of arm by sex and by each outcome flag, stacked long.

    All categories are counted in one pass over the members.
    """
    columns = ["sex", f"{name}_beforeindex", f"{name}_in12monthsafterindex", f"{name}_anyafterindex"]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).cast("int").alias("level")) for c in columns]
    )
    return (
        df.select(group, F.explode(pairs).alias("p"))
        .groupBy(group, F.col("p.variable").alias("variable"), F.col("p.level").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def flag_counts(df: DataFrame, name: str = "outcome") -> DataFrame:
    """Members with each outcome flag, and with any outcome at all, over both arms."""
    flags = [f"{name}_beforeindex", f"{name}_in12monthsafterindex", f"{name}_anyafterindex"]
    counted = [F.count_if(F.col(c) == 1).alias(c) for c in flags]
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in flags]
    return df.agg(*counted).select(F.inline(F.array(*pairs)))


def flag_levels(df: DataFrame, name: str = "outcome") -> DataFrame:
    """Members over both arms by each level of each outcome flag; NULL is a level. One pass."""
    flags = [f"{name}_beforeindex", f"{name}_in12monthsafterindex", f"{name}_anyafterindex"]
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("int").alias("level")) for c in flags])
    return count_by(df.select(F.inline(pairs)), ["variable", "level"])


def sample_sizes(everyone: DataFrame, members: DataFrame, treatment: str, weights: str) -> DataFrame:
    """Per arm: all, matched and unmatched people, and the matched ones' effective number."""
    matched = arm_sizes(members, treatment, weights).withColumnRenamed("n", "matched")
    counted = count_by(everyone, [treatment], "everyone").join(F.broadcast(matched), treatment, "left")
    n = F.coalesce("matched", F.lit(0).cast("bigint"))
    return counted.select(
        treatment, "everyone", n.alias("matched"), (F.col("everyone") - n).alias("unmatched"), "effective_n"
    )


def arm_sizes(df: DataFrame, treatment: str, weights: str | None = None) -> DataFrame:
    """Members per arm and the effective sample size under the weights."""
    w = F.col(weights) if weights else F.lit(1.0)
    return df.groupBy(treatment).agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"),
    )


def _cells(df: DataFrame, treatment: str, covariates: list[str], w: Column) -> DataFrame:
    """Weight per covariate, value and arm: all that the balance measures need."""
    long = F.array(
        *[
            F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("value"))
            for c in covariates
        ]
    )
    return (
        df.select(F.col(treatment).alias("treated"), w.cast("double").alias("w"), F.explode(long).alias("x"))
        .where(F.col("x.value").isNotNull())
        .groupBy(F.col("x.covariate").alias("covariate"), F.col("x.value").alias("value"))
        .agg(
            *[
                F.coalesce(F.sum(F.when(arm, weight)), F.lit(0.0)).alias(name)
                for name, arm, weight in (
                    ("w_t", F.col("treated"), F.col("w")),
                    ("w_c", ~F.col("treated"), F.col("w")),
                    ("ww_t", F.col("treated"), F.col("w") * F.col("w")),
                    ("ww_c", ~F.col("treated"), F.col("w") * F.col("w")),
                )
            ]
        )
    )


def _totals(cells: DataFrame) -> DataFrame:
    """Weight, mean and weight concentration per covariate and arm."""
    columns = []
    for arm in ("t", "c"):
        w = F.col(f"w_{arm}")
        columns += [
            F.sum(w).alias(f"sum_{arm}"),
            (F.sum(w * F.col("value")) / F.sum(w)).alias(f"mean_{arm}"),
            (F.sum(f"ww_{arm}") / (F.sum(w) * F.sum(w))).alias(f"conc_{arm}"),
        ]
    is_binary = F.bool_and(F.col("value").isin(0.0, 1.0)).alias("is_binary")
    return cells.groupBy("covariate").agg(*columns, is_binary)


def _square(arm: str) -> Column:
    """Share of the arm's variance that one value contributes."""
    centred = F.col("value") - F.col(f"mean_{arm}")
    return F.col(f"w_{arm}") / F.col(f"sum_{arm}") * centred * centred


def _variance(arm: str) -> Column:
    """Weighted sample variance; p(1-p) for a 0/1 covariate."""
    mean, conc = F.col(f"mean_{arm}"), F.col(f"conc_{arm}")
    return F.when(F.col("is_binary"), mean * (1 - mean)).when(conc < 1, F.col(f"sq_{arm}") / (1 - conc))


def balance(
    df: DataFrame,
    treatment: str,
    covariates: list[str],
    weights: str | None = None,
    reference: DataFrame | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Covariate balance between arms: one row per covariate.

    Mean differences are standardised by the treated arm's standard deviation in
    ``reference``, the sample before matching (default ``df``). The largest and
    mean gap between the arms' distribution functions are taken over the distinct
    pooled values. Members are aggregated once to weights per value; all else
    runs over values.
    """
    w = F.col(weights) if weights else F.lit(1.0)
    cells = stage(_cells(df, treatment, covariates, w), "balance")
    totals = _totals(cells)
    # One row per covariate: the broadcast side is as long as the argument list.
    spread = cells.join(F.broadcast(totals), "covariate").withColumn(
        "step", F.col("w_t") / F.col("sum_t") - F.col("w_c") / F.col("sum_c")
    )
    walked = running_total(spread, ["covariate"], ["value"], F.col("step"), "before", window_rows)
    gap = F.abs(F.col("before") + F.col("step"))
    measured = walked.groupBy(*totals.columns).agg(
        F.sum(_square("t")).alias("sq_t"),
        F.sum(_square("c")).alias("sq_c"),
        F.avg(gap).alias("gap_mean"),
        F.max(gap).alias("gap_max"),
    ).select("*", _variance("t").alias("var_t"), _variance("c").alias("var_c"))

    if reference is None:
        scaled = measured.withColumn("sd_t", F.sqrt("var_t"))
    else:
        base = stage(_cells(reference, treatment, covariates, F.lit(1.0)), "balance")
        base_totals = _totals(base)
        base_spread = base.join(F.broadcast(base_totals), "covariate")
        scale = base_spread.groupBy(*base_totals.columns).agg(F.sum(_square("t")).alias("sq_t"))
        scaled = measured.join(
            F.broadcast(scale.select("covariate", F.sqrt(_variance("t")).alias("sd_t"))), "covariate"
        )

    difference = F.col("mean_t") - F.col("mean_c")
    return scaled.select(
        "covariate",
        F.col("mean_t").alias("mean_treated"),
        F.col("mean_c").alias("mean_control"),
        F.when(F.col("sd_t") > 0, difference / F.col("sd_t")).alias("std_mean_diff"),
        F.when(~F.col("is_binary") & (F.col("var_c") > 0), F.col("var_t") / F.col("var_c")).alias(
            "var_ratio"
        ),
        F.when(F.col("is_binary"), F.abs(difference)).otherwise(F.col("gap_mean")).alias("ecdf_mean"),
        F.when(F.col("is_binary"), F.abs(difference)).otherwise(F.col("gap_max")).alias("ecdf_max"),
    )
