"""Daily series: one row per date (and series key), wide or long over metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.operators.rollup import average_order_value, exact_sum, roll_up
from tallyveer.schema import MEASURES, ROLLUP_DIMENSIONS

AMOUNT = "decimal(28,4)"

# A fact table, or a function that returns the fact with the columns asked for.
FactSource = DataFrame | Callable[[Sequence[str]], DataFrame]


def narrow(source: FactSource, columns: Sequence[str]) -> DataFrame:
    """The fact with at least ``columns``; a source that is a function may skip the rest."""
    return source(list(dict.fromkeys(columns))) if callable(source) else source


def daily_totals(source: FactSource, cfg: AnalysisConfig) -> DataFrame:
    """``(*keys, date, revenue, orders, avg_order_value)``, measures as exact decimals.

    The facts are summed per date before anything else; every later window runs
    over dates, whose number is bounded by the calendar.
    """
    keys = list(cfg.series_keys)
    if cfg.aov == "sum_of_groups":
        dims = list(dict.fromkeys(list(ROLLUP_DIMENSIONS) + keys))
        rolled = roll_up(narrow(source, [*dims, *MEASURES]), dims)
        wide = rolled.groupBy(*keys, "date").agg(
            F.sum("revenue").alias("revenue"),
            F.sum("orders").alias("orders"),
            exact_sum("avg_order_value").alias("avg_order_value"),
        )
    else:
        wide = (
            narrow(source, [*keys, "date", "revenue", "orders"])
            .groupBy(*keys, "date")
            .agg(exact_sum("revenue").alias("revenue"), exact_sum("orders").alias("orders"))
            .withColumn(
                "avg_order_value", average_order_value(F.col("revenue"), F.col("orders"))
            )
        )
    return wide.select(
        *keys,
        "date",
        *[F.col(m).cast(AMOUNT).alias(m) for m in ("revenue", "orders", "avg_order_value")],
    )


def daily_series(source: FactSource, cfg: AnalysisConfig) -> DataFrame:
    """All metrics in one pass: ``(*keys, metric, date, amount, value)``."""
    return to_long(daily_totals(source, cfg), cfg)


def to_long(daily: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    keys = list(cfg.series_keys)
    long = daily.unpivot([*keys, "date"], list(cfg.metrics), "metric", "amount")
    return long.select(
        *keys, "metric", "date", "amount", F.col("amount").cast("double").alias("value")
    )


def series_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "metric")


def number_rows(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``rn`` (1 = latest date) and ``n_dates`` per series and metric."""
    w = series_window(keys)
    return series.withColumns(
        {
            "rn": F.row_number().over(w.orderBy(F.col("date").desc())),
            "n_dates": F.count(F.lit(1)).over(w),
        }
    )


def in_recent(rn: Column, lookback: int) -> Column:
    return rn <= lookback


def in_prior(rn: Column, lookback: int) -> Column:
    return (rn > lookback) & (rn <= 2 * lookback)


def window_totals(numbered: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Latest ``lookback`` rows against the rows before them, per series and metric.

    With fewer than two full windows the prior value equals the recent one.
    """
    rn = F.col("rn")
    sums = numbered.groupBy(*cfg.series_keys, "metric").agg(
        F.max("n_dates").alias("n_dates"),
        F.sum(F.when(in_recent(rn, cfg.lookback), F.col("amount"))).alias("recent"),
        F.sum(F.when(in_prior(rn, cfg.lookback), F.col("amount"))).alias("prior"),
    )
    return compare_windows(sums, cfg)


def compare_windows(sums: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    enough = F.col("n_dates") >= 2 * cfg.lookback
    return sums.withColumn(
        "prior", F.when(enough, F.col("prior")).otherwise(F.col("recent")).cast("double")
    ).withColumn("recent", F.col("recent").cast("double"))


def eligible(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Keep series with at least ``min_dates`` dates."""
    w = series_window(cfg.series_keys)
    return (
        series.withColumn("n_dates", F.count(F.lit(1)).over(w))
        .filter(F.col("n_dates") >= cfg.min_dates)
        .drop("n_dates")
    )


def short_series(daily: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Series left out of detection because they have too few dates."""
    return (
        daily.groupBy(*cfg.series_keys)
        .agg(F.countDistinct("date").alias("n_dates"))
        .filter(F.col("n_dates") < cfg.min_dates)
    )


def trailing(series: DataFrame, cfg: AnalysisConfig, rows: int) -> DataFrame:
    """The latest ``rows`` dates of every series."""
    return number_rows(series, cfg.series_keys).filter(F.col("rn") <= rows).drop("n_dates")
