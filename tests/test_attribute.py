import datetime as dt

import pytest
from conftest import day, facts

from tallyveer.config import AnalysisConfig
from tallyveer.operators.attribute import contributions, drivers, flag_signals, window_sums

CFG = AnalysisConfig()


def two_windows(spark, before: dict, after: dict, **extra):
    """Region revenues of the previous and the current window, one row each."""
    rows = [{"date": day(0), "region": k, "revenue": float(v), **extra} for k, v in before.items()]
    rows += [{"date": day(27), "region": k, "revenue": float(v), **extra} for k, v in after.items()]
    return facts(spark, rows)


def by_region(df):
    return {
        r["group_value"]: (r["delta"], r["contribution_pct"])
        for r in df.filter("dimension = 'region'").collect()
    }


def test_share_sign_follows_total(spark):
    # the total falls by 100; "a" falls with it and so has a positive share
    found = by_region(drivers(two_windows(spark, {"a": 300, "b": 100}, {"a": 150, "b": 150}), CFG))
    assert found == {"a": (-150.0, 150.0), "b": (50.0, -50.0)}


def test_group_of_one_window_only(spark):
    found = by_region(drivers(two_windows(spark, {"gone": 60}, {"new": 160}), CFG))
    assert found == {"gone": (-60.0, -60.0), "new": (160.0, 160.0)}


def test_cut_uses_unrounded_share(spark):
    # 4.96 rounds to 5.0 but stays out; exactly 5 stays in
    before = {"a": 0, "b": 0, "c": 0}
    found = by_region(drivers(two_windows(spark, before, {"a": 4.96, "b": 5, "c": 90.04}), CFG))
    assert set(found) == {"b", "c"}


def test_ties_keep_dimension_then_group_order(spark):
    fact = two_windows(spark, {"x": 100, "y": 100}, {"x": 50, "y": 50})
    rows = drivers(fact, CFG).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    full = [(r["dimension"], r["group_value"]) for r in rows if r["contribution_pct"] == 100.0]
    assert [d for d, _ in full] == [
        "campaign", "category", "channel", "inventory_status", "discount_band"
    ]
    assert [r["group_value"] for r in rows if r["dimension"] == "region"] == ["x", "y"]


def test_windows_are_calendar_days(spark):
    rows = [
        {"date": day(i), "region": "r", "revenue": 1.0} for i in (0, 13, 14, 27)
    ] + [{"date": day(-1), "region": "r", "revenue": 1000.0}]
    sums = window_sums(facts(spark, rows), CFG).filter("dimension is null").first()
    assert (float(sums["cur"]), float(sums["prv"])) == (2.0, 2.0)


@pytest.mark.parametrize(
    "before, after, delta, share, words",
    [
        ({}, {"a": 10}, 0.0, 0.0, "history"),
        ({"a": 10}, {"a": 10}, 0.0, 0.0, "did not change"),
    ],
)
def test_placeholder_rows(spark, before, after, delta, share, words):
    (row,) = drivers(two_windows(spark, before, after), CFG).collect()
    assert (row["dimension"], row["group_value"]) == ("n/a", "n/a")
    assert (row["delta"], row["contribution_pct"]) == (delta, share) and words in row["driver"]


def test_placeholder_when_nothing_reaches_the_cut(spark):
    fact = two_windows(spark, {"a": 100}, {"a": 40})
    (row,) = drivers(fact, CFG.with_(min_share_pct=101.0)).collect()
    assert (row["delta"], row["contribution_pct"]) == (-60.0, 100.0)


def test_empty_fact_has_no_rows(spark):
    # the full analysis refuses an empty fact; the operator alone stays empty
    assert drivers(facts(spark, []), CFG).isEmpty()


def test_incident_loss(spark):
    rows = [
        {"date": day(27), "product": "a", "revenue": 100.0, "incident_flag": 1.0},
        {"date": day(27), "product": "b", "revenue": 300.0, "incident_flag": 0.0},
        {"date": day(27), "product": "c", "revenue": 500.0, "incident_flag": 0.0},
        {"date": day(0), "product": "a", "revenue": 50.0},
    ]
    (row,) = flag_signals(window_sums(facts(spark, rows), CFG), CFG).collect()
    # calm mean 400, one incident row of 100: loss 300 of 900 + 300
    assert row["dimension"] == "incident_flag"
    assert (row["delta"], row["share"]) == (-300.0, -25.0)


def test_small_incident_loss_is_dropped(spark):
    rows = [
        {"date": day(27), "product": "a", "revenue": 1.0, "incident_flag": 1.0},
        {"date": day(27), "product": "b", "revenue": 100.0},
        {"date": day(0), "product": "a", "revenue": 50.0},
    ]
    assert flag_signals(window_sums(facts(spark, rows), CFG), CFG).isEmpty()


def test_holiday_delta(spark):
    rows = [
        {"date": day(27), "product": "a", "revenue": 80.0, "holiday_flag": 1.0},
        {"date": day(0), "product": "a", "revenue": 20.0, "holiday_flag": 1.0},
        {"date": day(0), "product": "b", "revenue": 20.0},
    ]
    rows_found = flag_signals(window_sums(facts(spark, rows), CFG), CFG).collect()
    assert [(r["dimension"], r["delta"], r["share"]) for r in rows_found] == [
        ("holiday_flag", 60.0, 150.0)
    ]


def test_shares_of_a_dimension_sum_to_100(spark, data):
    from pyspark.sql import functions as F

    from tallyveer.sources.star import star_fact

    shares = contributions(window_sums(star_fact(spark, data), CFG), CFG)
    for row in shares.groupBy("dimension").agg(F.sum("share").alias("s")).collect():
        assert row["s"] == pytest.approx(100.0)


def test_one_series_equals_global_run(spark, data):
    from pyspark.sql import functions as F

    from tallyveer.sources.star import star_fact

    fact = star_fact(spark, data).filter(F.col("region") == "ASIA")
    cfg = CFG.with_(series_keys=("region",), as_of=dt.date(2001, 7, 30))
    keyed = [tuple(r)[1:] for r in drivers(fact, cfg).orderBy("rank").collect()]
    alone = [
        tuple(r) for r in drivers(fact, cfg.with_(series_keys=())).orderBy("rank").collect()
    ]
    assert keyed == alone and keyed
