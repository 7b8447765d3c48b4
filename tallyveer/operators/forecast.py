"""Trend forecasts with a heuristic band, for all series and metrics in one job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import half_even, pct_change
from tallyveer.operators.changepoint import piecewise_rows
from tallyveer.operators.detect import metric_label
from tallyveer.operators.series import series_window, trailing

LOW_QUANTILE, HIGH_QUANTILE = 0.1, 0.9


def trend_points(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """The latest ``trend_rows`` dates with regressor ``x`` = 0..n-1 and weight 0.5..1."""
    w = series_window(cfg.series_keys)
    tail = trailing(series, cfg, cfg.trend_rows)
    n = F.count(F.lit(1)).over(w)
    x = (F.col("n") - F.col("rn")).cast("double")
    return (
        tail.withColumn("n", n)
        .withColumn("x", x)
        .withColumn(
            "weight",
            F.when(F.col("n") > 1, 0.5 + 0.5 * F.col("x") / (F.col("n") - 1).cast("double"))
            .otherwise(1.0),
        )
    )


def weighted_trend(points: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Add the weighted least-squares line and its residual to every point.

    The weights multiply residuals, so the normal equations use their squares.
    All sums share the partitioning of the series, no further shuffle.
    """
    w = series_window(cfg.series_keys)
    sq, x, y = F.col("sq"), F.col("x"), F.col("value")

    def total(term: Column) -> Column:
        return F.sum(term).over(w)

    sums = points.withColumn("sq", F.col("weight") * F.col("weight")).withColumns(
        {
            "s": total(sq),
            "sx": total(sq * x),
            "sy": total(sq * y),
            "sxx": total(sq * x * x),
            "sxy": total(sq * x * y),
        }
    )
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(
        F.col("n") > 1, (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    ).otherwise(0.0)
    return (
        sums.withColumn("slope", slope)
        .withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("s"))
        .withColumn("trend", F.col("intercept") + F.col("slope") * F.col("x"))
        .withColumn("residual", y - F.col("trend"))
        .drop("sq", "s", "sx", "sy", "sxx", "sxy")
    )


def _model_columns(cfg: AnalysisConfig) -> list[Column]:
    """Aggregates that turn fitted points into one model row."""
    recent = F.col("rn") <= cfg.lookback
    recent_mean = F.sum(F.when(recent, F.col("amount"))).cast("double") / float(cfg.lookback)
    return [
        F.max("n").alias("n"),
        F.max("date").alias("last_date"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.coalesce(F.stddev_pop("residual"), F.lit(0.0)).alias("resid_std"),
        F.when(F.max("n") >= cfg.lookback, recent_mean)
        .otherwise(F.max_by("value", "date"))
        .alias("recent_avg"),
    ]


def trend_model(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per series and metric: line, residual spread, recent mean."""
    fitted = weighted_trend(trend_points(series, cfg), cfg)
    return fitted.groupBy(*cfg.series_keys, "metric").agg(*_model_columns(cfg))


def weekday_profile(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Mean trend residual per weekday (1 = Monday), centred, with residual quantiles."""
    keys = [*cfg.series_keys, "metric"]
    w = series_window(cfg.series_keys)
    fitted = weighted_trend(trend_points(series, cfg), cfg).withColumn(
        "weekday", F.weekday("date") + 1
    )
    by_day = Window.partitionBy(*keys, "weekday")
    centred = (
        fitted.withColumn("day_mean", F.avg("residual").over(by_day))
        .withColumn("all_mean", F.avg("residual").over(w))
        .withColumn("seasonal", F.col("day_mean") - F.col("all_mean"))
        .withColumn("remainder", F.col("residual") - F.col("seasonal"))
    )
    return centred.drop("day_mean", "all_mean")


def _horizon(model: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    return (
        model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(cfg.horizon))))
        .withColumn("date", F.expr("date_add(last_date, step)"))
        .withColumn(
            "centre",
            F.col("intercept")
            + F.col("slope") * (F.col("n") - 1 + F.col("step")).cast("double"),
        )
    )


def _floor(value: Column, cfg: AnalysisConfig, bound: str) -> Column:
    if bound == "lower" or cfg.clip == "all":
        return F.greatest(F.lit(0.0), value)
    return value


def forecast_rows(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """``(*keys, metric, step, date, yhat, lower, upper, model)`` for every horizon step."""
    if cfg.model == "trend_weekday":
        return _seasonal_rows(series, cfg)
    if cfg.model == "piecewise_weekly":
        return piecewise_rows(series, cfg)
    flat = F.col("n") < 2
    margin = F.when(flat, 0.0).otherwise(
        F.col("resid_std") * cfg.band_sigma + F.abs("centre") * cfg.band_relative
    )
    return (
        _horizon(trend_model(series, cfg), cfg)
        .withColumn("margin", margin)
        .select(
            *cfg.series_keys,
            "metric",
            "step",
            "date",
            half_even(_floor(F.col("centre"), cfg, "centre"), 2).alias("yhat"),
            half_even(_floor(F.col("centre") - F.col("margin"), cfg, "lower"), 2).alias("lower"),
            half_even(_floor(F.col("centre") + F.col("margin"), cfg, "upper"), 2).alias("upper"),
            F.when(flat, "flat_fallback").otherwise("linear_trend").alias("model"),
            "recent_avg",
        )
    )


def _seasonal_rows(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Trend plus weekday profile; the band is the 10-90 % range of the remainder.

    Line, profile and band come from one aggregation; the profile is a map of at
    most seven weekdays.
    """
    keys = [*cfg.series_keys, "metric"]
    model = weekday_profile(series, cfg).groupBy(*keys).agg(
        *_model_columns(cfg),
        F.map_from_entries(F.collect_set(F.struct("weekday", "seasonal"))).alias("profile"),
        F.percentile("remainder", F.lit(LOW_QUANTILE)).alias("low"),
        F.percentile("remainder", F.lit(HIGH_QUANTILE)).alias("high"),
    )
    seasonal = F.coalesce(
        F.try_element_at("profile", F.weekday("date") + F.lit(1)), F.lit(0.0)
    )
    ahead = _horizon(model, cfg).withColumn("centre", F.col("centre") + seasonal)
    return ahead.select(
        *keys,
        "step",
        "date",
        half_even(_floor(F.col("centre"), cfg, "centre"), 2).alias("yhat"),
        half_even(_floor(F.col("centre") + F.col("low"), cfg, "lower"), 2).alias("lower"),
        half_even(_floor(F.col("centre") + F.col("high"), cfg, "upper"), 2).alias("upper"),
        F.when(F.col("n") < 2, "flat_fallback").otherwise("trend_weekday").alias("model"),
        "recent_avg",
    )


CUSTOM_FIELDS = "step int, yhat double, lower double, upper double"


def custom_forecast(
    series: DataFrame,
    cfg: AnalysisConfig,
    fit: Callable[[pd.DataFrame, int], pd.DataFrame],
    label: str = "custom",
) -> DataFrame:
    """Forecast rows of a user's own model, one call per series and metric.

    ``fit(points, horizon)`` gets the latest ``trend_rows`` dates (columns
    ``date`` and ``value``, in order) and returns ``step, yhat, lower, upper``.
    """
    keys = [*cfg.series_keys, "metric"]
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", last_date date, " + CUSTOM_FIELDS

    def one_series(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        ordered = points.sort_values("date")
        ahead = fit(ordered[["date", "value"]].reset_index(drop=True), cfg.horizon)
        fixed = {**dict(zip(keys, key)), "last_date": ordered["date"].iloc[-1]}
        return ahead.assign(**fixed)[[*fixed, "step", "yhat", "lower", "upper"]]

    tail = trailing(series, cfg, cfg.trend_rows).select(*keys, "date", "value")
    rows = tail.groupBy(*keys).applyInPandas(one_series, schema)
    recent = trend_model(series, cfg).select(*keys, "recent_avg")
    return rows.join(recent, keys).select(
        *keys,
        "step",
        F.date_add("last_date", F.col("step")).alias("date"),
        *[half_even(F.col(c), 2).alias(c) for c in ("yhat", "lower", "upper")],
        F.lit(label).alias("model"),
        "recent_avg",
    )


def forecast_summary(rows: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per series and metric: change against the recent mean, verdict, arrays."""
    pct = F.col("pct")
    size = F.format_string("%.1f%%", half_even(F.abs("pct"), 1))
    label = metric_label(F.col("metric"))
    days = F.lit(f"{cfg.horizon} days")
    ordered = F.sort_array(F.collect_list(F.struct("step", "yhat", "lower", "upper")))
    return (
        rows.groupBy(*cfg.series_keys, "metric")
        .agg(
            pct_change(
                F.sum(F.col("yhat").cast("decimal(28,2)")).cast("double") / float(cfg.horizon),
                F.max("recent_avg"),
            ).alias("pct"),
            ordered.alias("steps"),
            F.max("model").alias("model"),
        )
        .select(
            *cfg.series_keys,
            "metric",
            F.when(
                F.abs("pct") <= cfg.stable_pct,
                F.concat(label, F.lit(" should hold steady over the coming "), days),
            )
            .when(
                pct < 0,
                F.concat(label, F.lit(" is projected to fall "), size, F.lit(" over the coming "), days),
            )
            .otherwise(
                F.concat(label, F.lit(" is projected to rise "), size, F.lit(" over the coming "), days)
            )
            .alias("prediction"),
            F.when(F.abs("pct") <= cfg.stable_pct, "stable")
            .when(pct < 0, "decline")
            .otherwise("increase")
            .alias("verdict"),
            half_even(pct, 2).alias("forecast_pct_change"),
            F.col("steps.yhat").alias("forecast_values"),
            F.col("steps.lower").alias("confidence_lower"),
            F.col("steps.upper").alias("confidence_upper"),
            "model",
        )
    )
