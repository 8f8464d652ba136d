"""Irregular readings onto a regular grid of periods.

Per source, a seasonal regression with trend (intercept, trend, annual and half-annual waves) is
fitted by normal equations whose sums Spark gathers like any other aggregate. Missing periods
take the model's value plus the residual bridged between the observed periods on either side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import usable
from ..session import keep

YEAR_DAYS = 365.25
TERMS = 6


def _terms(years: Column) -> list[Column]:
    w = 2 * math.pi
    return [F.lit(1.0), years, F.cos(years * w), F.sin(years * w), F.cos(years * (2 * w)), F.sin(years * (2 * w))]


def observed_periods(df: DataFrame, source: str = "id", time: str = "obs_time", value: str = "ndvi", days: int = 16, start: str = "2018-01-01") -> DataFrame:
    """One row per source and period with a usable reading: count, mean value, mean time.

    Equal values of a period count once, so readings that were delivered again carry no extra
    weight. Both steps combine before their shuffle, so a source with most of the rows costs no
    task more than its periods. Rows without source or time have no period and are left out.
    """
    step = days * 86400
    at = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.lit(start).cast("timestamp"))
    rows = df.select(F.col(source).alias("id"), at.alias("at"), usable(value).alias("v")).filter("id is not null and at is not null and v is not null")
    once = rows.groupBy("id", F.floor(F.col("at") / step).alias("period_no"), "v").agg(F.min("at").alias("at"))
    return once.groupBy("id", "period_no").agg(
        F.count(F.lit(1)).alias("n_readings"), F.avg("v").alias("value"), (F.avg("at") / (86400 * YEAR_DAYS)).alias("years")
    )


def seasonal_fit(observed: DataFrame, ridge: float = 0.05) -> DataFrame:
    """Coefficients ``beta`` per source from distributed normal equations.

    ``ridge`` shrinks trend and waves, never the intercept, so a source with one observed period
    gets its mean and nothing is singular. Time is centred per fit by the intercept only.
    """
    x = _terms(F.col("years"))
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}{j}") for i in range(TERMS) for j in range(i, TERMS)] + [F.sum(x[i] * F.col("value")).alias(f"b{i}") for i in range(TERMS)]
    gathered = observed.groupBy("id").agg(*sums)

    def solve(batches):
        for pdf in batches:
            n = len(pdf)
            a, b = np.zeros((n, TERMS, TERMS)), np.zeros((n, TERMS, 1))
            for i in range(TERMS):
                b[:, i, 0] = pdf[f"b{i}"]
                for j in range(i, TERMS):
                    a[:, i, j] = a[:, j, i] = pdf[f"a{i}{j}"]
            a[:, range(1, TERMS), range(1, TERMS)] += ridge
            beta = np.linalg.solve(a, b)[:, :, 0] if n else np.zeros((0, TERMS))
            yield pd.DataFrame({"id": pdf["id"], "beta": list(beta)})

    kind = dict(observed.dtypes)["id"]
    return gathered.mapInPandas(solve, f"id {kind}, beta array<double>")


def regular_grid(
    df: DataFrame, source: str = "id", time: str = "obs_time", value: str = "ndvi", days: int = 16, start: str = "2018-01-01", low: float = -1.0, high: float = 1.0, ridge: float = 0.05
) -> DataFrame:
    """id, period_no, period_start, n_readings, value, model, source: every period of every source
    from its first to its last observed one, ``source`` being ``observed`` or ``filled``.

    A period is observed if it holds a usable reading; its value is their mean. Others hold the
    model at the middle of the period plus the residual interpolated between the neighbouring
    observed periods, within ``low``..``high``. A source without usable readings has no periods;
    an empty table gives an empty grid. Rows without source or time, and columns besides the three
    named, are passed over. A source has as many grid rows as periods, so its window is bounded by
    the calendar and not by its readings.
    """
    observed = keep(observed_periods(df, source, time, value, days, start), "periods")
    fit = seasonal_fit(observed, ridge)
    spans = observed.groupBy("id").agg(F.min("period_no").alias("first"), F.max("period_no").alias("last")).join(fit, "id")
    grid = spans.select("id", "beta", F.explode(F.sequence("first", "last")).alias("period_no"))
    x = _terms((F.col("period_no") + 0.5) * (days / YEAR_DAYS))
    y = _terms(F.col("years"))
    model = sum((F.col("beta")[i] * x[i] for i in range(1, TERMS)), F.col("beta")[0])
    at_reading = sum((F.col("beta")[i] * y[i] for i in range(1, TERMS)), F.col("beta")[0])
    whole = grid.join(observed, ["id", "period_no"], "left").select(
        "id", "period_no", F.coalesce("n_readings", F.lit(0)).alias("n_readings"), "value", model.alias("model"), (F.col("value") - at_reading).alias("res")
    )
    back = Window.partitionBy("id").orderBy("period_no").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("id").orderBy(F.desc("period_no")).rowsBetween(Window.unboundedPreceding, 0)
    knot = F.when(F.col("value").isNotNull(), F.struct("period_no", "res"))
    whole = whole.withColumn("_a", F.last(knot, True).over(back)).withColumn("_b", F.last(knot, True).over(ahead))
    part = (F.col("period_no") - F.col("_a.period_no")) / (F.col("_b.period_no") - F.col("_a.period_no"))
    bridged = F.col("_a.res") + F.when(F.col("_b.period_no") > F.col("_a.period_no"), part).otherwise(0.0) * (F.col("_b.res") - F.col("_a.res"))
    predicted = F.col("model") + bridged
    held = F.when(predicted < low, F.lit(low)).when(predicted > high, F.lit(high)).otherwise(predicted)  # null without a prediction
    return whole.select(
        "id",
        "period_no",
        (F.lit(start).cast("timestamp") + F.make_dt_interval(F.col("period_no").cast("int") * days)).alias("period_start"),
        "n_readings",
        F.coalesce("value", held).alias("value"),
        "model",
        F.when(F.col("value").isNotNull(), "observed").otherwise("filled").alias("source"),
    )
