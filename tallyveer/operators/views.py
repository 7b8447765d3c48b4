"""Tables behind the dashboard: alerts, comparisons, histograms, waterfalls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import attach, clamp, half_even
from tallyveer.operators.order import PART, before_ranges, in_ranges
from tallyveer.operators.series import number_rows, series_window, trailing

ALERT_FACTOR = 0.85
TRAILING_SLICES = (14, 21, 30, 60, 90)


def low_alerts(series: DataFrame, cfg: AnalysisConfig, factor: float = ALERT_FACTOR) -> DataFrame:
    """Dates whose value lies below ``factor`` times the mean of the series."""
    w = series_window(cfg.series_keys)
    mean = F.sum("amount").over(w).cast("double") / F.count(F.lit(1)).over(w)
    return (
        series.withColumn("mean", mean)
        .withColumn("threshold", F.col("mean") * factor)
        .filter(F.col("value") < F.col("threshold"))
    )


def series_stats(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    return series.groupBy(*cfg.series_keys, "metric").agg(
        F.count(F.lit(1)).alias("points"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def histogram(
    series: DataFrame, cfg: AnalysisConfig, bins: int = 25, rows: int = 90
) -> DataFrame:
    """Equal-width counts of the latest ``rows`` dates; empty bins are left out."""
    keys = [*cfg.series_keys, "metric"]
    w = series_window(cfg.series_keys)
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    position = F.when(
        F.col("hi") > F.col("lo"),
        F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * float(bins)),
    ).otherwise(F.lit(0))
    return (
        trailing(series, cfg, rows)
        .withColumns({"lo": lo, "hi": hi})
        .withColumn("bin", F.least(F.lit(bins - 1).cast("bigint"), position.cast("bigint")))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
        .select(
            *keys,
            "bin",
            "n",
            half_even(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / float(bins), 4)
            .alias("bin_start"),
        )
    )


def week_over_week(series: DataFrame, cfg: AnalysisConfig, block: int = 7) -> DataFrame:
    """Change of each full block of rows against the block before.

    A block counts once a date follows it; that date labels the row. The first
    block has no base and shows 0.
    """
    keys = [*cfg.series_keys, "metric"]
    w = Window.partitionBy(*keys)
    idx = F.col("n_dates") - F.col("rn")
    blocks = (
        number_rows(series, cfg.series_keys)
        .withColumn("idx", idx)
        .withColumn("next_date", F.lead("date").over(w.orderBy("date")))
        .withColumn("block", F.floor(F.col("idx") / block))
        .groupBy(*keys, "block")
        .agg(
            F.sum("amount").cast("double").alias("total"),
            F.count(F.lit(1)).alias("days"),
            F.max_by("next_date", "idx").alias("label_date"),
        )
    )
    before = F.lag("total").over(w.orderBy("block"))
    return (
        blocks.withColumn("before", before)
        .filter((F.col("days") == block) & F.col("label_date").isNotNull())
        .select(
            *keys,
            "block",
            F.col("label_date").alias("date"),
            F.when(
                F.coalesce(F.col("before"), F.lit(0.0)) != 0,
                half_even((F.col("total") - F.col("before")) / F.col("before") * 100.0, 1),
            )
            .otherwise(0.0)
            .alias("wow_pct"),
        )
    )


def period_averages(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Mean per row of four spans counted back from the latest date, fixed divisors."""
    spans = (("90d", 61, 90, 30), ("60d", 31, 60, 30), ("30d", 15, 30, 16), ("14d", 1, 14, 14))
    rn = F.col("rn")
    sums = number_rows(series, cfg.series_keys).groupBy(*cfg.series_keys, "metric").agg(
        *[
            half_even(
                F.coalesce(
                    F.sum(F.when(rn.between(first, last), F.col("amount"))).cast("double"),
                    F.lit(0.0),
                )
                / float(divisor),
                2,
            ).alias(name)
            for name, first, last, divisor in spans
        ]
    )
    names = [name for name, *_ in spans]
    return sums.unpivot([*cfg.series_keys, "metric"], names, "period", "average")


def normalised(series: DataFrame, cfg: AnalysisConfig, rows: int = 90) -> DataFrame:
    """Min-max scaled latest rows; a constant series becomes 0."""
    w = series_window(cfg.series_keys)
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return (
        trailing(series, cfg, rows)
        .withColumns({"lo": lo, "hi": hi})
        .select(
            *cfg.series_keys,
            "metric",
            "date",
            (
                (F.col("value") - F.col("lo"))
                / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
            ).alias("scaled"),
        )
    )


def trailing_slices(
    series: DataFrame, cfg: AnalysisConfig, sizes: Sequence[int] = TRAILING_SLICES
) -> DataFrame:
    """Size and total of the latest 14, 21, 30, 60 and 90 rows in one pass."""
    rn = F.col("rn")
    aggregates = []
    for k in sizes:
        inside = F.when(rn <= k, F.col("amount"))
        aggregates.append(
            F.struct(
                F.lit(k).alias("rows"),
                F.count(inside).alias("points"),
                F.sum(inside).cast("double").alias("total"),
                F.min(F.when(rn <= k, F.col("date"))).alias("first_date"),
            )
        )
    return (
        number_rows(series, cfg.series_keys)
        .groupBy(*cfg.series_keys, "metric")
        .agg(F.array(*aggregates).alias("slices"))
        .select(*cfg.series_keys, "metric", F.inline("slices"))
    )


def health_radar(cards: DataFrame, explained: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Five scores between 0 and 100 per series."""
    keys = list(cfg.series_keys)
    changes = cards.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col("kpi") == k, F.col("chg"))), F.lit(0.0)).alias(k)
            for k in ("revenue", "orders", "aov")
        ]
    )
    joined = attach(changes, explained.select(*keys, "confidence", "anomaly_detected"), keys)
    scores = joined.select(
        *keys,
        *[clamp(F.col(k) + 50.0, 0, 100).alias(k) for k in ("revenue", "orders", "aov")],
        half_even(F.col("confidence") * 100.0, 0).alias("confidence"),
        F.when(F.col("anomaly_detected"), 30.0).otherwise(80.0).alias("stability"),
    )
    return scores.unpivot(
        keys, ["revenue", "orders", "aov", "confidence", "stability"], "axis", "score"
    )


def waterfall(drivers: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Baseline 100, one falling step per driver in rank order, net impact last.

    ``base`` is 100 minus the running total. ``chart_base`` is the offset the
    dashboard chart draws: 100 minus the first height, then the difference of
    neighbouring heights.
    """
    keys = list(cfg.series_keys)
    size = F.abs("contribution_pct")
    exact = size.cast("decimal(18,1)")
    drivers = in_ranges(drivers, keys, [F.col("rank")])
    before = before_ranges(drivers, keys, {"_sum": F.sum(exact)})
    # the last height of each range is what the first step of the next one starts from
    ends = drivers.groupBy(PART, *keys).agg(F.max_by(size, "rank").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end", 1, 100.0).over(Window.partitionBy(*keys).orderBy(PART)))
    order = Window.partitionBy(PART, *keys).orderBy("rank")
    running = F.sum(exact).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = drivers.join(before, [PART, *keys]).join(ends, [PART, *keys]).select(
        *keys,
        F.col("rank").alias("step"),
        F.concat_ws(":", "dimension", "group_value").alias("label"),
        size.alias("height"),
        half_even(100.0 - (F.col("_sum") + running).cast("double"), 1).alias("base"),
        half_even(F.coalesce(F.lag(size).over(order), F.col("_end")) - size, 1).alias("chart_base"),
    )
    totals = drivers.groupBy(*keys).agg(
        F.sum(exact).cast("double").alias("height"), F.max("rank").alias("last")
    )
    first = totals.select(
        *keys,
        F.lit(0).alias("step"),
        F.lit("Baseline").alias("label"),
        F.lit(100.0).alias("height"),
        F.lit(0.0).alias("base"),
        F.lit(0.0).alias("chart_base"),
    )
    last = totals.select(
        *keys,
        (F.col("last") + 1).alias("step"),
        F.lit("Net impact").alias("label"),
        "height",
        F.lit(0.0).alias("base"),
        F.lit(0.0).alias("chart_base"),
    )
    return first.unionByName(steps).unionByName(last)
