import pytest
from conftest import day, facts, series_facts

from tallyveer.config import AnalysisConfig
from tallyveer.operators.detect import detection_summary, first_anomaly_dates, scorecard, severity
from tallyveer.operators.kpi import kpi_cards
from tallyveer.operators.series import (
    daily_series,
    daily_totals,
    number_rows,
    short_series,
    window_totals,
)

CFG = AnalysisConfig()


def revenue_card(spark, values, cfg=CFG):
    card = scorecard(daily_series(series_facts(spark, values), cfg), cfg)
    return card.filter("metric = 'revenue'").first()


def test_prior_equals_recent_without_two_windows(spark):
    for n in (10, 14, 27):
        card = revenue_card(spark, [float(i + 1) for i in range(n)])
        assert card["recent_value"] == card["prior_value"] and card["change_pct"] == 0
    card = revenue_card(spark, [float(i + 1) for i in range(28)])
    assert (card["recent_value"], card["prior_value"]) == (sum(range(15, 29)), sum(range(1, 15)))


def test_windows_count_rows_not_days(spark):
    # a gap of 100 days between the windows changes nothing
    rows = [
        {"date": day(i if i < 14 else i + 100), "revenue": 2.0 if i < 14 else 1.0, "orders": 1.0}
        for i in range(28)
    ]
    series = daily_series(facts(spark, rows), CFG)
    totals = window_totals(number_rows(series, ()), CFG).filter("metric = 'revenue'").first()
    assert (totals["recent"], totals["prior"]) == (14.0, 28.0)


def test_ten_dates_are_enough_nine_are_not(spark):
    cfg = CFG.with_(series_keys=("region",))
    rows = [
        {"date": day(i), "region": name, "revenue": float(i * i + 1), "orders": 1.0}
        for name, n in (("long", 10), ("short", 9))
        for i in range(n)
    ]
    fact = facts(spark, rows)
    series = daily_series(fact, cfg)
    assert {r["region"] for r in scorecard(series, cfg).collect()} == {"long"}
    skipped = short_series(daily_totals(fact, cfg), cfg).collect()
    assert [(r["region"], r["n_dates"]) for r in skipped] == [("short", 9)]


def test_change_signals_severity(spark):
    flat = [100.0 + (i % 2) for i in range(14)]
    assert revenue_card(spark, flat + [v * 0.5 for v in flat])["severity"] == "CRITICAL"
    card = revenue_card(spark, flat + [v * 0.85 for v in flat])
    assert card["change_pct"] == -15.0 and card["severity"] in ("WARNING", "CRITICAL")


@pytest.mark.parametrize(
    "score, change, want",
    [
        (0.0, 0.0, "NORMAL"),
        (-0.05, -10.0, "NORMAL"),
        (-0.0501, 0.0, "WARNING"),
        (0.0, -10.1, "WARNING"),
        (-0.15, -20.0, "WARNING"),
        (-0.1501, 5.0, "CRITICAL"),
        (0.0, -20.1, "CRITICAL"),
    ],
)
def test_severity_thresholds(spark, score, change, want):
    from pyspark.sql import functions as F

    row = spark.range(1).select(severity(F.lit(score), F.lit(change), CFG).alias("s")).first()
    assert row["s"] == want


def test_summary_takes_worst_metric(spark):
    values = [100.0] * 14 + [50.0] * 14
    card = scorecard(daily_series(series_facts(spark, values), CFG), CFG)
    row = detection_summary(card, CFG).first()
    assert row["severity"] == "CRITICAL" and row["change_pct"] == -50.0
    assert row["change"] == "-50.0%"


def test_aov_modes(spark):
    rows = [
        {"date": day(0), "region": "a", "revenue": 10.0, "orders": 1.0},
        {"date": day(0), "region": "b", "revenue": 10.0, "orders": 4.0},
    ]
    fact = facts(spark, rows)
    ratio = daily_totals(fact, CFG).first()["avg_order_value"]
    groups = daily_totals(fact, CFG.with_(aov="sum_of_groups")).first()["avg_order_value"]
    assert (float(ratio), float(groups)) == (4.0, 12.5)


def test_kpi_aov_is_mean_of_daily_ratios(spark):
    rows = [
        {"date": day(i), "revenue": 10.0 * (i + 1), "orders": float(i % 2)} for i in range(28)
    ]
    cards = {
        r["kpi"]: r for r in kpi_cards(daily_totals(facts(spark, rows), CFG), CFG).collect()
    }
    assert cards["aov"]["raw"] == pytest.approx(sum(10.0 * (i + 1) for i in range(14, 28)) / 14)
    assert cards["revenue"]["val"] == f"${sum(10 * (i + 1) for i in range(14, 28)):,}"
    # a change beyond +50 % is clamped
    assert cards["health"]["raw"] == 100.0


def test_all_anomaly_dates_are_listed(spark):
    cfg = AnalysisConfig(metrics=("revenue",), lookback=30, contamination=0.5)
    values = [100.0 + (i * 37) % 11 for i in range(60)]
    card = scorecard(daily_series(series_facts(spark, values), cfg), cfg)
    dates = card.first()["anomaly_dates"]
    assert len(dates) > 10 and dates == sorted(dates)
    assert first_anomaly_dates(card, 4).first()["anomaly_dates"] == dates[:4]
