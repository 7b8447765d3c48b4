"""Physical plans: what must and must not be in them."""

import datetime as dt
import re

import pytest

from tallyveer.config import AnalysisConfig
from tallyveer.operators import attribute as at
from tallyveer.operators import detect as de
from tallyveer.operators import forecast as fc
from tallyveer.operators import insight as ins
from tallyveer.operators import series as se
from tallyveer.sources.star import star_fact

CFG = AnalysisConfig()
KEYED = CFG.with_(series_keys=("region",))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def builders(spark, data):
    slim = ("date", "revenue", "orders", "region")
    series = lambda cfg: se.daily_series(star_fact(spark, data, slim), cfg)
    for cfg in (CFG, KEYED):
        yield de.scorecard(series(cfg), cfg)
        yield fc.forecast_rows(series(cfg), cfg)
        yield at.drivers(star_fact(spark, data), cfg)
        yield ins.correlated_groups(star_fact(spark, data), "campaign", cfg)


def test_no_cross_joins(spark, data):
    for df in builders(spark, data):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_python_on_the_core_path(spark, data):
    for df in builders(spark, data):
        assert "Python" not in plan(df) and "ArrowEval" not in plan(df)


def test_only_needed_columns_are_read(spark, data):
    daily = se.daily_totals(star_fact(spark, data, ("date", "revenue", "orders")), CFG)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(daily))
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert read == {"l_orderkey", "l_extendedprice", "l_discount", "o_orderkey", "o_orderdate"}


def test_daily_shuffles_only_sums(spark, data):
    # facts are combined before the shuffle
    daily = se.daily_totals(star_fact(spark, data, ("date", "revenue", "orders")), CFG)
    assert "partial_sum" in plan(daily)


def test_stored_fact_prunes_by_date(spark, data, tmp_path):
    path = str(tmp_path / "fact")
    star_fact(spark, data).write.parquet(path)
    stored = spark.read.parquet(path)
    cfg = CFG.with_(as_of=dt.date(2001, 7, 1))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(date", plan(at.window_sums(stored, cfg)))


def test_results_do_not_depend_on_broadcast(spark, data):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = {}
    try:
        for threshold in ("-1", "10485760"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            rows = at.drivers(star_fact(spark, data), KEYED).collect()
            found[threshold] = sorted(map(str, rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found["-1"] == found["10485760"] and len(found["-1"]) > 20


def test_many_drivers_are_ranked_in_ranges(spark):
    from pyspark.sql import functions as F

    # 100 000 products that move against each other, with little net change: 97 600 shares are above the cut
    n = 100_000
    fact = spark.range(2 * n).select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.when(F.col("id") < n, 20).otherwise(6)).alias("date"),
        F.format_string("p%06d", F.col("id") % n).alias("product"),
        F.when((F.col("id") < n) == (F.col("id") % 2 == 0), 100.0 + F.col("id") % n).otherwise(0.0).alias("revenue"),
        *[F.lit("x").alias(c) for c in ("region", "category", "channel", "campaign", "inventory_status", "discount_band")],
        F.lit(0.0).alias("holiday_flag"), F.lit(0.0).alias("incident_flag"),
    )
    cfg = CFG.with_(dimensions=("product",), as_of=dt.date(2024, 1, 21))
    ranked = at.drivers(fact, cfg)
    # only the counts per range meet in one task
    for below in plan(ranked).split("Exchange SinglePartition")[1:]:
        assert re.match(r"[^\n]*\n\W*HashAggregate\(keys=\[_range", below)
    rows = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 97_601))
    shares = [abs(r["contribution_pct"]) for r in rows]
    assert shares == sorted(shares, reverse=True)


def test_correlation_of_large_values_with_a_small_spread(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 50, (2, 200))
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), c, 1e12 + v) for i in range(200) for c, v in (("a", float(a[i])), ("b", float(a[i] + b[i])))]
    rows += [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "c", 70.0) for i in range(0, 200, 3)]
    fact = spark.createDataFrame(rows, "date date, campaign string, revenue double")
    got = {r["group_value"]: r["correlation"] for r in ins.correlated_groups(fact, "campaign", CFG).collect()}
    c = np.where(np.arange(200) % 3 == 0, 70.0, 0.0)
    ra, rb = np.round(a, 4), np.round(a + b, 4)
    for name, own, rest in (("a", ra, rb + c), ("b", rb, ra + c), ("c", c, ra + rb)):
        assert abs(got[name] - np.corrcoef(own, rest)[0, 1]) < 1e-3


def test_hot_group_is_combined_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    # a third of all rows share one group
    fact = spark.range(300_000).select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 28).cast("int")).alias("date"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1000).cast("string"))
        .alias("campaign"),
        *[F.lit("x").alias(c) for c in ("region", "product", "category", "channel",
                                        "inventory_status", "discount_band")],
        F.lit(1.0).alias("revenue"), F.lit(1.0).alias("orders"), F.lit(1.0).alias("impressions"),
        F.lit(0.0).alias("holiday_flag"), F.lit(0.0).alias("incident_flag"),
    )
    sums = at.window_sums(fact, CFG)
    hot = sums.filter("dimension = 'campaign' AND group_value = 'hot'").first()
    assert float(hot["cur"] + hot["prv"]) == 100_000.0
    assert "partial_sum" in plan(sums)


def scans_of_lines(df) -> int:
    """Scans of the order lines in the plan that really ran, reused stages not counted."""
    df.collect()
    final = plan(df).split("+- == Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", final))


def test_facts_are_read_once(spark, data):
    slim = ("date", "revenue", "orders", "region")
    seasonal = CFG.with_(model="trend_weekday")
    for cfg in (CFG, KEYED):
        series = se.daily_series(star_fact(spark, data, slim), cfg)
        assert scans_of_lines(de.scorecard(series, cfg)) == 1
        assert scans_of_lines(de.recent_anomalies(series, cfg)) == 1
        assert scans_of_lines(ins.anomaly_calendar(series, cfg)) == 1
    series = se.daily_series(star_fact(spark, data, slim), seasonal)
    assert scans_of_lines(fc.forecast_rows(series, seasonal)) == 1
    assert scans_of_lines(ins.calendar_gaps(star_fact(spark, data, slim), KEYED)) == 1


def test_given_end_date_spares_the_anchor_pass(spark, data):
    dated = CFG.with_(as_of=dt.date(2001, 8, 1))
    assert scans_of_lines(at.window_sums(star_fact(spark, data), dated)) == 1
