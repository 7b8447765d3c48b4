"""The whole analysis, from canonical fact to decision brief."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import attach, finite_or_null, half_even
from tallyveer.operators.attribute import drivers_from_sums, window_sums
from tallyveer.operators.detect import detection_summary, scorecard
from tallyveer.operators.explain import explanation
from tallyveer.operators.forecast import forecast_rows, forecast_summary
from tallyveer.operators.kpi import kpi_cards, kpi_daily
from tallyveer.operators.recommend import playbook_table, recommendations
from tallyveer.operators.series import FactSource, daily_totals, short_series, to_long
from tallyveer.session import remove_folder, stored
from tallyveer.sources.raw import write_documents

VERSION = "1.0.0"
TABLES = (
    "daily",
    "scorecard",
    "summary",
    "drivers",
    "forecast_rows",
    "forecast",
    "recommendations",
    "explanation",
    "kpis",
    "skipped_series",
)


@dataclass(frozen=True)
class Brief:
    """Result tables of one analysis, stored or computed from small stored tables."""

    config: AnalysisConfig
    daily: DataFrame
    scorecard: DataFrame
    summary: DataFrame
    drivers: DataFrame
    forecast_rows: DataFrame
    forecast: DataFrame
    recommendations: DataFrame
    explanation: DataFrame
    kpis: DataFrame
    skipped_series: DataFrame
    folders: tuple[str, ...] = ()

    def discard(self) -> None:
        """Remove the stored tables; the brief cannot be read afterwards."""
        for folder in self.folders:
            remove_folder(self.daily.sparkSession, folder)

    def document(self) -> DataFrame:
        return brief_document(self)


def _together(spark: SparkSession, *jobs: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run independent jobs at the same time, so small ones do not queue behind each other."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in running]


def analyze(
    source: FactSource,
    cfg: AnalysisConfig | None = None,
    playbook: DataFrame | None = None,
    check: bool = True,
) -> Brief:
    """Run every stage on a canonical fact, or on a function that provides one.

    The facts are read twice: once summed per date, once for the two latest
    windows. Both results and the tables made of them are small and stored;
    nothing after the two passes goes back to the facts.
    """
    cfg = cfg or AnalysisConfig()
    totals = daily_totals(source, cfg)
    spark = totals.sparkSession
    folders: list[str] = []

    def fixed(df: DataFrame, purpose: str) -> DataFrame:
        return stored(df, purpose, folders)

    daily = fixed(totals, "daily")
    last, longest = _extent(daily, cfg)
    if check:
        require_dates(longest, cfg)
    # the windows end at a known date, which prunes the second pass
    dated = cfg if cfg.as_of or last is None else cfg.with_(as_of=last)
    series = to_long(daily, cfg)
    ranked, card, ahead = _together(
        spark,
        lambda: fixed(
            drivers_from_sums(fixed(window_sums(source, dated), "windows"), cfg), "drivers"
        ),
        lambda: fixed(scorecard(series, cfg), "scorecard"),
        lambda: fixed(forecast_rows(series, cfg), "forecast"),
    )
    rules = playbook if playbook is not None else playbook_table(spark)
    summary = detection_summary(card, cfg)
    outlook = forecast_summary(ahead, cfg)
    advice, words = _together(
        spark,
        lambda: fixed(recommendations(ranked, card, summary, rules, cfg), "advice"),
        lambda: fixed(explanation(summary, ranked, outlook, cfg), "explanation"),
    )
    return Brief(
        config=cfg,
        daily=daily,
        scorecard=card,
        summary=summary,
        drivers=ranked,
        forecast_rows=ahead,
        forecast=outlook,
        recommendations=advice,
        explanation=words,
        kpis=kpi_cards(daily, cfg),
        skipped_series=short_series(daily, cfg),
        folders=tuple(folders),
    )


def scorecard_only(source: FactSource, cfg: AnalysisConfig) -> DataFrame:
    """The scorecards of all series without the other stages."""
    return scorecard(to_long(daily_totals(source, cfg), cfg), cfg)


def forecast_only(source: FactSource, cfg: AnalysisConfig) -> DataFrame:
    """The forecast summaries of all series without the other stages."""
    series = to_long(daily_totals(source, cfg), cfg)
    return forecast_summary(forecast_rows(series, cfg), cfg)


def write_brief(brief: Brief, target: str) -> None:
    """Every table of a brief as Parquet, and the documents as JSON."""
    for name in TABLES:
        getattr(brief, name).write.mode("overwrite").parquet(f"{target}/{name}")
    write_documents(brief.document(), f"{target}/documents")


def _extent(daily: DataFrame, cfg: AnalysisConfig) -> tuple[dt.date | None, int]:
    """Last date of all series and number of dates of the longest; one row comes back."""
    per_series = daily.groupBy(*cfg.series_keys).agg(
        F.count_distinct("date").alias("n"), F.max("date").alias("last")
    )
    row = per_series.agg(F.max("last"), F.max("n")).first()
    return row[0], row[1] or 0


def require_dates(longest: int, cfg: AnalysisConfig) -> None:
    """Refuse data without any series long enough to analyse."""
    if longest == 0:
        raise ValueError("the data holds no rows with a readable date")
    if longest < cfg.min_dates:
        raise ValueError(
            f"the data covers {longest} dates; at least {cfg.min_dates} are needed"
        )


def brief_document(brief: Brief) -> DataFrame:
    """One nested row per series with everything a report needs."""
    cfg = brief.config
    keys = list(cfg.series_keys)

    def iso(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd")

    def clean(c: str | Column) -> Column:
        value = F.col(c) if isinstance(c, str) else c
        return finite_or_null(value.cast("double"))

    def ordered(*fields: Column) -> Column:
        return F.sort_array(F.collect_list(F.struct(*fields)))

    def as_map(key: str, fields: list[Column]) -> Column:
        return F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*fields))))

    history = (
        kpi_daily(brief.daily, cfg)
        .groupBy(*keys)
        .agg(
            ordered(
                iso("date").alias("date"),
                half_even(F.col("revenue").cast("double"), 2).alias("revenue"),
                half_even(F.col("orders").cast("double"), 2).alias("orders"),
                F.col("aov").cast("double").alias("aov"),
            ).alias("h")
        )
        .select(
            *keys,
            F.col("h.date").alias("dates"),
            F.col("h.revenue").alias("revenue"),
            F.col("h.orders").alias("orders"),
            F.col("h.aov").alias("aov"),
        )
    )
    kpis = brief.kpis.groupBy(*keys).agg(
        as_map("kpi", [F.col("label"), F.col("val"), clean("raw").alias("raw"),
                       clean("prior").alias("prior"), clean("chg").alias("chg")]).alias("kpis")
    )
    headline = brief.summary.select(
        *keys, "metric", "anomaly_detected", "severity", "change",
        clean("change_pct").alias("change_pct"), "anomaly_count", "anomaly_dates",
    )
    per_metric = brief.scorecard.groupBy(*keys).agg(
        as_map("metric", [F.col(c) for c in (
            "label", "anomaly_detected", "severity", "change", "change_pct", "anomaly_count",
            "anomaly_dates", "recent_value", "prior_value", "if_score_worst")]).alias("per_metric")
    )
    cause = F.struct("rank", "driver", "dimension", "group_value", "delta", "contribution_pct")
    top = cfg.document_drivers
    if top is None:
        causes = brief.drivers.groupBy(*keys).agg(
            F.sort_array(F.collect_list(cause)).alias("root_cause")
        )
    else:
        causes = brief.drivers.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.when(F.col("rank") <= top, cause))).alias("root_cause"),
            F.count(F.lit(1)).alias("root_cause_total"),
            F.coalesce(F.max("rank") > top, F.lit(False)).alias("root_cause_cut"),
        )
    ahead = brief.forecast_rows.filter(F.col("metric") == "revenue").groupBy(*keys).agg(
        F.sort_array(F.collect_list(iso("date"))).alias("forecast_dates")
    )
    main = brief.forecast.filter(F.col("metric") == "revenue").select(
        *keys, "prediction", "forecast_pct_change", "forecast_values",
        F.col("confidence_lower").alias("forecast_confidence_lower"),
        F.col("confidence_upper").alias("forecast_confidence_upper"),
        "model",
    )
    all_forecasts = brief.forecast.groupBy(*keys).agg(
        as_map("metric", [F.col(c) for c in (
            "prediction", "forecast_pct_change", "forecast_values", "confidence_lower",
            "confidence_upper", "model")]).alias("per_metric_forecast")
    )
    advice = brief.recommendations.groupBy(*keys).agg(
        ordered(*[F.col(c) for c in ("position", "action", "priority", "expected_impact",
                                     "timeline", "owner", "confidence")]).alias("recommendation")
    )
    words = brief.explanation.select(
        *keys, "confidence", F.col("narrative").alias("explanation"), "llm_powered"
    )
    document = history
    for part in (kpis, headline, per_metric, causes, ahead, main, all_forecasts, advice, words):
        document = attach(document, part, keys)
    return document.withColumns(
        {
            "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
            "pipeline_version": F.lit(VERSION),
        }
    )


def to_json_rows(documents: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Each document as one JSON string."""
    keys = list(cfg.series_keys)
    body = [c for c in documents.columns if c not in keys]
    return documents.select(*keys, F.to_json(F.struct(*body)).alias("document"))
