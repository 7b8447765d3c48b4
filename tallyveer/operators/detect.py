"""Per-metric scorecards and the overall detection summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import half_even, pct_change, signed_pct
from tallyveer.operators.isolation import score_dates
from tallyveer.operators.series import (
    compare_windows,
    eligible,
    in_prior,
    in_recent,
    number_rows,
)
from tallyveer.schema import METRIC_LABELS

SEVERITIES = ("NORMAL", "WARNING", "CRITICAL")


def severity(score: Column, change: Column, cfg: AnalysisConfig) -> Column:
    return (
        F.when((score < cfg.score_critical) | (change < cfg.change_critical), "CRITICAL")
        .when((score < cfg.score_warning) | (change < cfg.change_warning), "WARNING")
        .otherwise("NORMAL")
    )


def severity_rank(name: Column) -> Column:
    return F.when(name == "CRITICAL", 3).when(name == "WARNING", 2).otherwise(1)


def metric_label(metric: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in METRIC_LABELS.items():
        label = F.when(metric == name, text).otherwise(label)
    return label


def scorecard(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per series and metric: anomalies, severity and window change."""
    keys = [*cfg.series_keys, "metric"]
    rn, flagged = F.col("rn"), F.col("flagged")
    scored = number_rows(score_dates(eligible(series, cfg), cfg), cfg.series_keys)
    recent_flag = flagged & in_recent(rn, cfg.lookback)
    sums = scored.groupBy(*keys).agg(
        F.max("n_dates").alias("n_dates"),
        F.max("degenerate").alias("degenerate"),
        F.count_if(flagged).alias("anomaly_count"),
        F.coalesce(F.min(F.when(flagged, F.col("decision"))), F.lit(0.0)).alias("worst"),
        # at most ``lookback`` dates qualify
        F.sort_array(
            F.collect_list(F.when(recent_flag, F.date_format("date", "yyyy-MM-dd")))
        ).alias("dates"),
        F.sum(F.when(in_recent(rn, cfg.lookback), F.col("amount"))).alias("recent"),
        F.sum(F.when(in_prior(rn, cfg.lookback), F.col("amount"))).alias("prior"),
    )
    change = pct_change(F.col("recent"), F.col("prior"))
    return (
        compare_windows(sums, cfg)
        .withColumn("change_raw", change)
        .select(
            *keys,
            metric_label(F.col("metric")).alias("label"),
            (F.col("anomaly_count") > 0).alias("anomaly_detected"),
            F.when(F.col("degenerate"), "NORMAL")
            .otherwise(severity(F.col("worst"), F.col("change_raw"), cfg))
            .alias("severity"),
            signed_pct(F.col("change_raw")).alias("change"),
            half_even(F.col("change_raw"), 2).alias("change_pct"),
            "anomaly_count",
            F.col("dates").alias("anomaly_dates"),
            half_even(F.col("recent"), 2).alias("recent_value"),
            half_even(F.col("prior"), 2).alias("prior_value"),
            half_even(F.col("worst"), 4).alias("if_score_worst"),
        )
    )


def first_anomaly_dates(card: DataFrame, k: int) -> DataFrame:
    """Scorecards with at most the first ``k`` of their anomaly dates, for short reports."""
    return card.withColumn("anomaly_dates", F.slice("anomaly_dates", 1, k))


def recent_anomalies(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Flagged dates that also lie in the recent window."""
    scored = number_rows(score_dates(eligible(series, cfg), cfg), cfg.series_keys)
    return scored.filter(F.col("flagged") & in_recent(F.col("rn"), cfg.lookback)).select(
        *cfg.series_keys, "metric", "date"
    )


def detection_summary(card: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per series: worst severity over metrics, headline fields from revenue."""
    is_rev = F.col("metric") == "revenue"

    def headline(column: str) -> Column:
        return F.max(F.when(is_rev, F.col(column)))

    return card.groupBy(*cfg.series_keys).agg(
        F.lit("revenue").alias("metric"),
        F.bool_or("anomaly_detected").alias("anomaly_detected"),
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        headline("change").alias("change"),
        headline("change_pct").alias("change_pct"),
        headline("anomaly_count").alias("anomaly_count"),
        headline("anomaly_dates").alias("anomaly_dates"),
        headline("recent_value").alias("recent_revenue"),
        headline("prior_value").alias("prior_revenue"),
        F.count_if("anomaly_detected").alias("anomalous_metrics"),
        F.array_sort(
            F.collect_list(F.when(F.col("anomaly_detected"), F.col("label")))
        ).alias("anomalous_labels"),
    )
