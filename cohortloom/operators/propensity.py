"""Propensity score: logistic regression of the arm on covariates."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, functions as F

from cohortloom.session import stage_measured

MAX_ITERATIONS = 25
TOLERANCE = 1e-8


class NotConverged(RuntimeError):
    """The fit ran out of iterations, as it does when a covariate separates the arms."""


def propensity_score(
    df: DataFrame, treatment: str, covariates: list[str], name: str = "distance"
) -> DataFrame:
    """Add ``name``: the fitted probability of being in the treated arm.

    Unregularised maximum likelihood by iteratively reweighted least squares.
    People with equal covariates become one observation, the share treated
    weighted by their number: the same estimate without a pass over all people
    per iteration. The score itself is a plain column expression. A person with a
    missing covariate gets a NULL score.
    """
    columns = [F.col(c).cast("double").alias(c) for c in covariates]
    complete = df.select(F.col(treatment).cast("double").alias("label"), *columns).dropna()
    cells, seen = stage_measured(
        complete.groupBy(*covariates).agg(
            F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("n")
        ),
        "cells",
        treated=F.sum(F.col("label") * F.col("n")),
        people=F.sum("n"),
    )
    if not seen["people"] or not 0 < round(seen["treated"]) < seen["people"]:
        raise ValueError("a propensity score needs members in both arms")

    vectors = VectorAssembler(inputCols=covariates, outputCol="features").transform(cells)
    model = GeneralizedLinearRegression(
        family="binomial",
        link="logit",
        labelCol="label",
        weightCol="n",
        # One more than the limit, so that a fit that ends on the last iteration still counts.
        maxIter=MAX_ITERATIONS + 1,
        tol=TOLERANCE,
        regParam=0.0,
    ).fit(vectors)
    if model.summary.numIterations > MAX_ITERATIONS:
        raise NotConverged(f"no convergence to {TOLERANCE} in {MAX_ITERATIONS} iterations")

    linear = F.lit(float(model.intercept))
    for column, weight in zip(covariates, model.coefficients):
        linear = linear + F.col(column).cast("double") * F.lit(float(weight))
    return df.withColumn(name, 1 / (1 + F.exp(-linear)))
