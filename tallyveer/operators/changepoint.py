"""Forecasts from a piecewise-linear trend with change points and weekly waves.

A series is a level, a slope, a change of slope at each of ``change_points`` knots spread over the first 80 % of its time, and three
waves per week. Changes and waves are shrunk by ridge penalties, so a knot bends only where the values ask for it, and short series
stay solvable. All coefficients come from the normal equations, whose sums are one aggregation per series; the equations are
solved inside the plan, and the band is the range of the residuals' quantiles. Nothing is collected and no Python runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import half_even
from tallyveer.operators.series import trailing

#: Part of the time that holds knots: at the end a change could not be told from noise.
KNOT_SPAN = 0.8
WAVES = 3
LOW_QUANTILE, HIGH_QUANTILE = 0.1, 0.9


def knots(cfg: AnalysisConfig) -> list[float]:
    """Places of the knots in the series' time from 0 to 1."""
    return [KNOT_SPAN * j / cfg.change_points for j in range(1, cfg.change_points + 1)]


def terms(time: Column, weekday: Column, cfg: AnalysisConfig) -> list[Column]:
    """The regressors at a time (0 to 1 over the known dates, beyond 1 ahead) and weekday (0 = Monday)."""
    hinges = [F.greatest(F.lit(0.0), time - F.lit(c)) for c in knots(cfg)]
    angles = [weekday.cast("double") * (2.0 * math.pi * k / 7.0) for k in range(1, WAVES + 1)]
    return [F.lit(1.0), time, *hinges, *[wave(a) for a in angles for wave in (F.cos, F.sin)]]


def penalties(cfg: AnalysisConfig) -> list[float]:
    """Ridge weight of each term; level and slope are free but for what keeps a pivot from being zero."""
    return [1e-9, 1e-9, *[cfg.change_penalty] * cfg.change_points, *[cfg.wave_penalty] * (2 * WAVES)]


def timed_points(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """The latest ``trend_rows`` dates with their time, and what one model per series needs to know of its scale."""
    keys = [*cfg.series_keys, "metric"]
    tail = trailing(series, cfg, cfg.trend_rows)
    recent = F.sum(F.when(F.col("rn") <= cfg.lookback, F.col("amount"))).cast("double") / float(cfg.lookback)
    spans = tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max(F.abs("value")).alias("largest"),
        F.when(F.count(F.lit(1)) >= cfg.lookback, recent).otherwise(F.max_by("value", "date")).alias("recent_avg"),
    )
    scale = F.when(F.col("largest") > 0, F.col("largest")).otherwise(1.0)
    spans = spans.withColumn("scale", scale).drop("largest")
    spans = spans.withColumn("days", F.greatest(F.lit(1), F.datediff("last_date", "first_date")).cast("double"))
    return tail.select(*keys, "date", "value").join(spans, keys)


def time_of(date: Column) -> Column:
    return F.datediff(date, F.col("first_date")).cast("double") / F.col("days")


def solved(matrix: Column, size: int) -> Column:
    """Solution of a positive definite system, given as rows with the right side behind, by Gauss-Jordan steps."""

    def step(rows: Column, k: Column) -> Column:
        pivot = F.transform(F.get(rows, k), lambda v: v / F.get(F.get(rows, k), k))
        return F.transform(
            rows, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda a, b: a - F.get(row, k) * b))
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)
    return F.transform(done, lambda row: F.element_at(row, -1))


def fitted_models(points: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per series and metric: scale, dates and coefficients (of values divided by the scale)."""
    keys = [*cfg.series_keys, "metric"]
    named = {f"t{i}": c for i, c in enumerate(terms(F.col("time"), F.weekday("date"), cfg))}
    timed = points.withColumn("time", time_of(F.col("date"))).withColumn("y", F.col("value") / F.col("scale"))
    size = len(named)
    products = {f"s{i}_{j}": F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i in range(size) for j in range(i, size)}
    right = {f"r{i}": F.sum(F.col(f"t{i}") * F.col("y")) for i in range(size)}
    about = ["n", "first_date", "last_date", "scale", "days", "recent_avg"]
    sums = timed.withColumns(named).groupBy(*keys, *about).agg(*[c.alias(n) for n, c in (products | right).items()])
    ridge = penalties(cfg)

    def entry(i: int, j: int) -> Column:
        value = F.col(f"s{min(i, j)}_{max(i, j)}")
        return value + F.lit(ridge[i]) if i == j else value

    matrix = F.array(*[F.array(*[entry(i, j) for j in range(size)], F.col(f"r{i}")) for i in range(size)])
    return sums.select(*keys, *about, solved(matrix, size).alias("beta"))


def value_at(time: Column, weekday: Column, cfg: AnalysisConfig) -> Column:
    """The model's value, from the coefficients in ``beta``."""
    total = F.lit(0.0)
    for i, term in enumerate(terms(time, weekday, cfg)):
        total = total + F.get(F.col("beta"), F.lit(i)) * term
    return total * F.col("scale")


def piecewise_models(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Models with the 10 % and 90 % quantiles of their residuals."""
    keys = [*cfg.series_keys, "metric"]
    points = timed_points(series, cfg)
    models = fitted_models(points, cfg)
    residual = F.col("value") - value_at(time_of(F.col("date")), F.weekday("date"), cfg)
    rest = points.select(*keys, "date", "value").join(models, keys).select(*keys, residual.alias("residual"))
    spread = rest.groupBy(*keys).agg(
        F.percentile("residual", F.lit(LOW_QUANTILE)).alias("low"), F.percentile("residual", F.lit(HIGH_QUANTILE)).alias("high")
    )
    return models.join(spread, keys)


def piecewise_rows(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Forecast rows; a series of one date stays flat."""
    models = piecewise_models(series, cfg)
    ahead = models.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon))))
    ahead = ahead.withColumn("date", F.date_add("last_date", F.col("step")))
    flat = F.col("n") < 2
    centre = F.when(flat, F.col("recent_avg")).otherwise(value_at(time_of(F.col("date")), F.weekday("date"), cfg))
    ahead = ahead.withColumn("centre", centre)

    def bound(margin: str | None, name: str) -> Column:
        value = F.col("centre") if margin is None else F.col("centre") + F.when(flat, 0.0).otherwise(F.col(margin))
        floor = name == "lower" or cfg.clip == "all"
        return half_even(F.greatest(F.lit(0.0), value) if floor else value, 2).alias(name)

    return ahead.select(
        *cfg.series_keys, "metric", "step", "date", bound(None, "yhat"), bound("low", "lower"), bound("high", "upper"),
        F.when(flat, "flat_fallback").otherwise("piecewise_weekly").alias("model"), "recent_avg",
    )


def trend_breaks(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Per knot: its date, the change of slope there and the slope from there on, in units a day, and the rank of the change."""
    keys = [*cfg.series_keys, "metric"]
    models = fitted_models(timed_points(series, cfg), cfg).where("n > 1")
    places = F.array(*[F.lit(c) for c in knots(cfg)])
    each = models.select("*", F.posexplode(places).alias("at", "place"))
    day = F.col("scale") / F.col("days")
    bends = F.slice("beta", F.lit(3), F.col("at") + 1)
    slope = F.get("beta", F.lit(1)) + F.aggregate(bends, F.lit(0.0), lambda a, b: a + b)
    each = each.select(
        *keys,
        (F.col("at") + 1).alias("knot"),
        F.date_add("first_date", F.round(F.col("place") * F.col("days")).cast("int")).alias("date"),
        (F.get("beta", F.col("at") + 2) * day).alias("change"),
        (slope * day).alias("slope_after"),
    )
    order = Window.partitionBy(*keys).orderBy(F.abs("change").desc(), "knot")  # as many rows as knots
    return each.withColumn("rank", F.row_number().over(order))
