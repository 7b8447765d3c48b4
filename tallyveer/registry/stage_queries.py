"""Queries over the analysis stages: roll-up, series, detection, drivers, forecast, advice."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import half_even
from tallyveer.operators import attribute as at
from tallyveer.operators import detect as de
from tallyveer.operators import changepoint as cp
from tallyveer.operators import explain as ex
from tallyveer.operators import forecast as fc
from tallyveer.operators import isolation as iso_
from tallyveer.operators import insight as ins
from tallyveer.operators import kpi as kp
from tallyveer.operators import recommend as rec
from tallyveer.operators import robust
from tallyveer.operators import rollup as ru
from tallyveer.operators import series as se
from tallyveer.operators import views as vw
from tallyveer.plans.brief import analyze, to_json_rows
from tallyveer.registry import sql as q
from tallyveer.registry.core import query
from tallyveer.sources.star import event_fact, star_fact, star_source, table

CFG = AnalysisConfig()
PARITY = CFG.with_(aov="sum_of_groups")
BY_TYPE = CFG.with_(series_keys=("category",))
BY_REGION = CFG.with_(series_keys=("region",))
SLIM = ("date", "revenue", "orders")
FACTS = f"WITH {q.FACT}"
SERIES = q.series_ctes()
SCORED = f"{SERIES},\n{q.scored()}"
CARD = f"{SCORED},\n{q.card()}"
SUMMARY = f"{CARD},\n{q.summary()}"
DRIVERS = f"{FACTS},\n{q.attribution()}"
TREND = f"{SERIES},\n{q.trend()}"
FULL = f"{SUMMARY},\n{q.attribution()},\n{q.trend()}"
EVENT_CARD = (
    f"{q.series_ctes(('category',), q.EVENT_FACT)},\n{q.scored(('category',))},\n"
    f"{q.card(('category',))}"
)
CARD_COLUMNS = (
    "metric, label, anomaly_detected, severity, change_pct, anomaly_count, anomaly_dates, "
    "recent_value, prior_value, if_score_worst"
)


def slim_series(spark, folder, cfg=CFG):
    columns = (*SLIM, *cfg.series_keys)
    return se.daily_series(star_fact(spark, folder, columns), cfg)


def event_series(spark, folder):
    return se.daily_series(event_fact(spark, folder), BY_TYPE)


def plain_card(card):
    return card.drop("change").withColumn("anomaly_dates", F.array_join("anomaly_dates", ","))


# --- canonical fact and roll-up -------------------------------------------------------


@query(
    "fact_star",
    f"{FACTS} SELECT category, discount_band, count(*) AS n, sum(revenue)::DOUBLE AS revenue, "
    "sum(orders) AS orders, sum(impressions) AS impressions, sum(holiday_flag) AS holidays, "
    "sum(incident_flag) AS incidents FROM fact GROUP BY category, discount_band",
)
def _(spark, folder):
    return star_fact(spark, folder).groupBy("category", "discount_band").agg(
        F.count("*").alias("n"),
        F.sum("revenue").alias("revenue"),
        F.sum("orders").alias("orders"),
        F.sum("impressions").alias("impressions"),
        F.sum("holiday_flag").alias("holidays"),
        F.sum("incident_flag").alias("incidents"),
    )


@query(
    "fact_events",
    f"WITH {q.EVENT_FACT} SELECT category, {q.iso('date')} AS date, "
    "sum(revenue)::DOUBLE AS revenue, sum(orders) AS orders FROM fact GROUP BY category, date",
)
def _(spark, folder):
    return event_fact(spark, folder).groupBy("category", "date").agg(
        ru.exact_sum("revenue").alias("revenue"), F.sum("orders").alias("orders")
    )


@query(
    "a1_rollup",
    f"{FACTS}, {q.ROLLED} SELECT {q.iso('date')} AS date, region, product, category, channel, "
    "campaign, inventory_status, discount_band, holiday_flag, incident_flag, "
    "revenue::DOUBLE AS revenue, orders::DOUBLE AS orders, impressions::DOUBLE AS impressions, "
    "avg_order_value::DOUBLE AS avg_order_value, conversion_rate::DOUBLE AS conversion_rate "
    "FROM rolled",
)
def _(spark, folder):
    return ru.roll_up(star_fact(spark, folder))


@query(
    "a2_rollup_reduced",
    f"{FACTS} SELECT {q.iso('date')} AS date, region, product, category, campaign, "
    "sum(revenue)::DOUBLE AS revenue, sum(orders) AS orders FROM fact "
    "GROUP BY date, region, product, category, campaign",
)
def _(spark, folder):
    columns = ("date", "region", "product", "category", "campaign", "revenue", "orders")
    return ru.roll_up_reduced(star_fact(spark, folder, columns))


@query(
    "p11_p12_ratios",
    f"{FACTS}, {q.ROLLED} SELECT channel, sum(CAST(avg_order_value AS DECIMAL(18,4)))::DOUBLE "
    "AS aov_total, sum(CAST(conversion_rate AS DECIMAL(18,4)))::DOUBLE AS conversion_total, "
    "count(*) AS n FROM rolled GROUP BY channel",
)
def _(spark, folder):
    return ru.roll_up(star_fact(spark, folder)).groupBy("channel").agg(
        ru.exact_sum("avg_order_value").alias("aov_total"),
        ru.exact_sum("conversion_rate").alias("conversion_total"),
        F.count("*").alias("n"),
    )


@query(
    "p26_reduced_profile",
    f"{FACTS} SELECT campaign, category, count(*) AS groups, sum(revenue)::DOUBLE AS revenue "
    "FROM (SELECT date, region, product, category, campaign, sum(revenue) AS revenue FROM fact "
    "GROUP BY ALL) GROUP BY campaign, category",
)
def _(spark, folder):
    columns = ("date", "region", "product", "category", "campaign", "revenue", "orders")
    return ru.roll_up_reduced(star_fact(spark, folder, columns)).groupBy(
        "campaign", "category"
    ).agg(F.count("*").alias("groups"), F.sum("revenue").alias("revenue"))


# --- daily series ---------------------------------------------------------------------


@query(
    "a3_daily_series",
    f"{SERIES} SELECT metric, {q.iso('date')} AS date, value FROM long",
)
def _(spark, folder):
    return slim_series(spark, folder).drop("amount")


@query(
    "a3_daily_series_sum_of_groups",
    f"{q.series_ctes(parity=True)} SELECT metric, {q.iso('date')} AS date, value FROM long",
)
def _(spark, folder):
    return se.daily_series(star_fact(spark, folder), PARITY).drop("amount")


@query(
    "a3_daily_series_by_region",
    f"{q.series_ctes(('region',))} SELECT region, metric, {q.iso('date')} AS date, value FROM long",
)
def _(spark, folder):
    return slim_series(spark, folder, BY_REGION).drop("amount")


@query(
    "a4_daily_kpi_table",
    f"{FACTS}, {q.daily()} SELECT {q.iso('date')} AS date, revenue::DOUBLE AS revenue, "
    f"orders::DOUBLE AS orders, {q.rnd('revenue::DOUBLE / greatest(orders::DOUBLE, 1e0)', 2)} "
    "AS aov FROM daily",
)
def _(spark, folder):
    return kp.kpi_daily(se.daily_totals(star_fact(spark, folder, SLIM), CFG), CFG)


@query(
    "a5_w1_window_totals",
    f"{SERIES} SELECT metric, sum(amount) FILTER (rn <= 14)::DOUBLE AS recent, "
    "sum(amount) FILTER (rn BETWEEN 15 AND 28)::DOUBLE AS prior, max(n) AS n_dates "
    "FROM long GROUP BY metric",
)
def _(spark, folder):
    return se.window_totals(se.number_rows(slim_series(spark, folder), ()), CFG)


@query(
    "a10_distinct_dates",
    f"{FACTS} SELECT region, count(DISTINCT date) AS n_dates FROM fact GROUP BY region",
)
def _(spark, folder):
    return star_fact(spark, folder, ("date", "region")).groupBy("region").agg(
        F.count_distinct("date").alias("n_dates")
    )


@query(
    "p16_short_series",
    f"{FACTS} SELECT product, category, campaign, count(DISTINCT date) AS n_dates FROM fact "
    "GROUP BY product, category, campaign HAVING count(DISTINCT date) < 10",
)
def _(spark, folder):
    cfg = CFG.with_(series_keys=("product", "category", "campaign"))
    columns = ("date", "product", "category", "campaign", "revenue", "orders")
    return se.short_series(se.daily_totals(star_fact(spark, folder, columns), cfg), cfg)


@query(
    "w11_trailing_rows",
    f"{SERIES} SELECT metric, {q.iso('date')} AS date, value, rn FROM long WHERE rn <= 60",
)
def _(spark, folder):
    return se.trailing(slim_series(spark, folder), CFG, 60).drop("amount")


@query(
    "o1_daily_sorted",
    f"{FACTS}, {q.daily()} SELECT {q.iso('date')} AS date, revenue::DOUBLE AS revenue "
    "FROM daily ORDER BY date",
)
def _(spark, folder):
    daily = se.daily_totals(star_fact(spark, folder, SLIM), CFG)
    return daily.select("date", "revenue").orderBy("date")


# --- detection ------------------------------------------------------------------------


@query(
    "m1_standardised",
    f"{SERIES} SELECT metric, {q.iso('date')} AS date, "
    f"{q.rnd('(value - avg(value) OVER w) / stddev_pop(value) OVER w', 6)} AS zscore "
    "FROM long WINDOW w AS (PARTITION BY metric)",
)
def _(spark, folder):
    scored = iso_.standardise(slim_series(spark, folder), CFG)
    return scored.select("metric", "date", half_even(F.col("zscore"), 6).alias("zscore"))


@query(
    "m2_isolation_scores",
    f"{SCORED} SELECT metric, {q.iso('date')} AS date, {q.rnd('score', 6)} AS score FROM scored",
)
def _(spark, folder):
    scored = iso_.score_dates(slim_series(spark, folder), CFG)
    return scored.select("metric", "date", half_even(F.col("score"), 6).alias("score"))


@query(
    "m3_flagged_dates",
    f"{SCORED} SELECT metric, {q.iso('date')} AS date, {q.rnd('decision', 6)} AS decision "
    "FROM scored WHERE flagged",
)
def _(spark, folder):
    scored = iso_.score_dates(slim_series(spark, folder), CFG).filter("flagged")
    return scored.select("metric", "date", half_even(F.col("decision"), 6).alias("decision"))


@query("m6_scorecard", f"{CARD} SELECT {CARD_COLUMNS} FROM card")
def _(spark, folder):
    return plain_card(de.scorecard(slim_series(spark, folder), CFG))


@query(
    "m6_scorecard_sum_of_groups",
    f"{q.series_ctes(parity=True)},\n{q.scored()},\n{q.card()} SELECT {CARD_COLUMNS} FROM card",
)
def _(spark, folder):
    return plain_card(de.scorecard(se.daily_series(star_fact(spark, folder), PARITY), PARITY))


@query(
    "m6_scorecard_by_region",
    f"{q.series_ctes(('region',))},\n{q.scored(('region',))},\n{q.card(('region',))} "
    f"SELECT region, {CARD_COLUMNS} FROM card",
)
def _(spark, folder):
    return plain_card(de.scorecard(slim_series(spark, folder, BY_REGION), BY_REGION))


@query("m6_scorecard_events", f"{EVENT_CARD} SELECT category, {CARD_COLUMNS} FROM card")
def _(spark, folder):
    return plain_card(de.scorecard(event_series(spark, folder), BY_TYPE))


@query(
    "m4_constant_series",
    # every event counts 1, so revenue per order of this fact never varies
    f"{q.series_ctes(('category',), q.EVENT_FACT.replace('coalesce(value, 0)', '1'))},\n"
    f"{q.scored(('category',))},\n{q.card(('category',))} "
    f"SELECT category, {CARD_COLUMNS} FROM card WHERE metric = 'avg_order_value'",
)
def _(spark, folder):
    fact = event_fact(spark, folder).withColumn("revenue", F.lit(1.0))
    card = de.scorecard(se.daily_series(fact, BY_TYPE), BY_TYPE)
    return plain_card(card.filter(F.col("metric") == "avg_order_value"))


@query(
    "m5_severity",
    f"{EVENT_CARD} SELECT severity, count(*) AS n, min(if_score_worst) AS worst FROM card "
    "GROUP BY severity",
)
def _(spark, folder):
    card = de.scorecard(event_series(spark, folder), BY_TYPE)
    return card.groupBy("severity").agg(
        F.count("*").alias("n"), F.min("if_score_worst").alias("worst")
    )


@query(
    "a11_anomaly_counts",
    f"{SCORED} SELECT metric, count(*) FILTER (flagged) AS anomalies, bool_or(flagged) AS any_flag, "
    f"{q.rnd('min(decision) FILTER (flagged)', 6)} AS worst FROM scored GROUP BY metric",
)
def _(spark, folder):
    return iso_.score_dates(slim_series(spark, folder), CFG).groupBy("metric").agg(
        F.count_if("flagged").alias("anomalies"),
        F.bool_or("flagged").alias("any_flag"),
        half_even(F.min(F.when(F.col("flagged"), F.col("decision"))), 6).alias("worst"),
    )


@query(
    "j3_u3_recent_anomalies",
    f"{SCORED} SELECT metric, {q.iso('date')} AS date FROM scored WHERE flagged "
    f"INTERSECT SELECT metric, {q.iso('date')} FROM long WHERE rn <= 14",
)
def _(spark, folder):
    return de.recent_anomalies(slim_series(spark, folder), CFG)


@query(
    "o4_first_anomaly_dates",
    f"{CARD} SELECT metric, array_to_string(string_split(anomaly_dates, ',')[1:2], ',') AS anomaly_dates FROM card",
)
def _(spark, folder):
    card = de.first_anomaly_dates(de.scorecard(slim_series(spark, folder), CFG), 2)
    return plain_card(card).select("metric", "anomaly_dates")


@query("a12_m7_detection_summary", f"{SUMMARY} SELECT * FROM summary")
def _(spark, folder):
    card = de.scorecard(slim_series(spark, folder), CFG)
    return de.detection_summary(card, CFG).drop("metric", "change", "anomalous_labels")


@query(
    "a12_summary_events",
    f"{EVENT_CARD},\n{q.summary(('category',))} SELECT * FROM summary",
)
def _(spark, folder):
    card = de.scorecard(event_series(spark, folder), BY_TYPE)
    return de.detection_summary(card, BY_TYPE).drop("metric", "change", "anomalous_labels")


# --- attribution ----------------------------------------------------------------------


@query(
    "p17_window_slices",
    f"{FACTS}, {q.sliced()} SELECT is_current, count(*) AS n, count(DISTINCT date) AS dates, "
    "sum(revenue)::DOUBLE AS revenue FROM sliced GROUP BY is_current",
)
def _(spark, folder):
    sliced = at.comparison_slice(star_source(spark, folder), CFG, ("date", "revenue"))
    return sliced.groupBy("is_current").agg(
        F.count("*").alias("n"),
        F.count_distinct("date").alias("dates"),
        F.sum("revenue").alias("revenue"),
    )


@query(
    "p18_flag_sums",
    f"{DRIVERS} SELECT is_current, sum(revenue) FILTER (incident_flag = 1)::DOUBLE AS incident, "
    "sum(revenue) FILTER (incident_flag = 0)::DOUBLE AS calm, "
    "coalesce(sum(revenue) FILTER (holiday_flag = 1), 0)::DOUBLE AS holiday "
    "FROM sliced GROUP BY is_current",
)
def _(spark, folder):
    columns = ("date", "revenue", "incident_flag", "holiday_flag")
    sliced = at.comparison_slice(star_source(spark, folder), CFG, columns)
    return sliced.groupBy("is_current").agg(
        F.sum(F.when(F.col("incident_flag") == 1, F.col("revenue"))).alias("incident"),
        F.sum(F.when(F.col("incident_flag") == 0, F.col("revenue"))).alias("calm"),
        F.coalesce(
            F.sum(F.when(F.col("holiday_flag") == 1, F.col("revenue"))).cast("double"), F.lit(0.0)
        ).alias("holiday"),
    )


@query(
    "j1_outer_join_windows",
    f"{DRIVERS} SELECT group_value AS campaign, cur_revenue, prv_revenue FROM groups "
    "WHERE dimension = 'campaign'",
)
def _(spark, folder):
    return at.both_windows(star_source(spark, folder), "campaign", CFG)


@query(
    "a6_dimension_deltas",
    f"{DRIVERS} SELECT dimension, group_value, cur_revenue, prv_revenue, "
    f"{q.rnd('delta', 4)} AS delta, {q.rnd('share', 6)} AS share FROM shares",
)
def _(spark, folder):
    sums = at.window_sums(star_source(spark, folder), CFG)
    return at.contributions(sums, CFG).select(
        "dimension", "group_value", "cur_revenue", "prv_revenue",
        half_even(F.col("delta"), 4).alias("delta"),
        half_even(F.col("share"), 6).alias("share"),
    )


@query(
    "a7_j2_totals",
    f"{DRIVERS} SELECT total_cur, total_prv, exact_delta AS total_delta "
    "FROM totals, exact_totals",
)
def _(spark, folder):
    sums = at.window_sums(star_source(spark, folder), CFG)
    return at.series_totals(sums, CFG).select("total_cur", "total_prv", "total_delta")


FLAG_SQL = (
    "SELECT {k}dimension, group_value, {delta} AS delta, {share} AS share FROM flags"
).format(k="{k}", delta=q.rnd("delta", 2), share=q.rnd("share", 4))


# windows that hold the holidays around a new year
NEW_YEAR = DRIVERS.replace(
    "WHERE o.o_orderdate IS NOT NULL", "WHERE CAST(o.o_orderdate AS DATE) <= DATE '2001-01-07'"
).replace("(SELECT max(date) FROM fact)", "DATE '2001-01-07'")


@query("a8_a9_flag_signals", f"{NEW_YEAR} {FLAG_SQL.format(k='')}")
def _(spark, folder):
    cfg = CFG.with_(as_of=dt.date(2001, 1, 7))
    sums = at.window_sums(star_source(spark, folder), cfg)
    return at.flag_signals(sums, cfg).select(
        "dimension", "group_value",
        half_even(F.col("delta"), 2).alias("delta"), half_even(F.col("share"), 4).alias("share"),
    )


@query(
    "a8_a9_flag_signals_by_product",
    f"{FACTS},\n{q.attribution(('product',))} {FLAG_SQL.format(k='product, ')}",
)
def _(spark, folder):
    cfg = CFG.with_(series_keys=("product",))
    sums = at.window_sums(star_source(spark, folder), cfg)
    return at.flag_signals(sums, cfg).select(
        "product", "dimension", "group_value",
        half_even(F.col("delta"), 2).alias("delta"), half_even(F.col("share"), 4).alias("share"),
    )


DRIVER_COLUMNS = "rank, dimension, group_value, delta, contribution_pct"


@query("m14_drivers", f"{DRIVERS} SELECT {DRIVER_COLUMNS} FROM drivers")
def _(spark, folder):
    return at.drivers(star_source(spark, folder), CFG).drop("driver")


@query(
    "m14_drivers_by_region",
    f"{FACTS},\n{q.attribution(('region',))} SELECT region, {DRIVER_COLUMNS} FROM drivers",
)
def _(spark, folder):
    return at.drivers(star_source(spark, folder), BY_REGION).drop("driver")


@query(
    "p19_w7_share_cut",
    f"{FACTS},\n{q.attribution(min_share=50.0)} SELECT {DRIVER_COLUMNS} FROM drivers",
)
def _(spark, folder):
    return at.drivers(star_source(spark, folder), CFG.with_(min_share_pct=50.0)).drop("driver")


@query(
    "u4_fallback_rows",
    f"{FACTS},\n{q.attribution(('product',))} SELECT product, 1 AS rank, 'n/a' AS dimension, 'n/a' AS group_value, "
    f"CASE WHEN prv_rows > 0 THEN {q.rnd('exact_delta', 2)} ELSE 0 END AS delta, "
    "CASE WHEN exact_delta <> 0 AND prv_rows > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS contribution_pct, "
    "CASE WHEN prv_rows = 0 THEN 'Not enough history to compare two windows' "
    "WHEN exact_delta = 0 THEN 'Revenue did not change between the windows' "
    "ELSE 'No group stands out; watch the metrics together' END AS driver "
    "FROM exact_totals JOIN totals USING (product)",
)
def _(spark, folder):
    # no share reaches the cut-off, so every product falls back
    cfg = CFG.with_(series_keys=("product",), min_share_pct=1e15)
    return at.drivers(star_source(spark, folder), cfg)


@query(
    "u1_findings_by_kind",
    f"{DRIVERS} SELECT dimension, count(*) AS n FROM drivers GROUP BY dimension",
)
def _(spark, folder):
    return at.drivers(star_source(spark, folder), CFG).groupBy("dimension").agg(
        F.count("*").alias("n")
    )


@query(
    "o3_top_drivers",
    f"{DRIVERS} SELECT {DRIVER_COLUMNS} FROM drivers WHERE rank <= 10",
)
def _(spark, folder):
    return ex.top_drivers(at.drivers(star_source(spark, folder), CFG), CFG, 10).drop("driver")


@query(
    "w5_unique_drivers",
    f"{DRIVERS} SELECT dimension, group_value, min(rank) AS rank FROM drivers "
    "GROUP BY dimension, group_value",
)
def _(spark, folder):
    ranked = at.drivers(star_source(spark, folder), CFG)
    return ranked.groupBy("dimension", "group_value").agg(F.min("rank").alias("rank"))


@query(
    "w6_first_declining",
    f"{DRIVERS} SELECT {DRIVER_COLUMNS} FROM drivers WHERE delta < 0 "
    "QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY rank) = 1",
)
def _(spark, folder):
    ranked = at.drivers(star_source(spark, folder), CFG)
    return rec.first_declining(ranked, CFG).drop("driver")


@query("p20_driver_text", f"{DRIVERS},\n{q.DRIVER_TEXTS} SELECT rank, driver FROM texts")
def _(spark, folder):
    return at.drivers(star_source(spark, folder), CFG).select("rank", "driver")


# --- forecast -------------------------------------------------------------------------


@query(
    "w2_w3_trend_points",
    f"{TREND} SELECT metric, {q.iso('date')} AS date, x, {q.rnd('sqrt(w)', 6)} AS weight, value "
    "FROM weighted",
)
def _(spark, folder):
    points = fc.trend_points(slim_series(spark, folder), CFG)
    return points.select(
        "metric", "date", "x", half_even(F.col("weight"), 6).alias("weight"), "value"
    )


@query(
    "m8_weighted_trend",
    f"{TREND} SELECT metric, n, {q.rnd('slope', 4)} AS slope, {q.rnd('intercept', 2)} AS intercept, "
    f"{q.rnd('resid_std', 2)} AS resid_std FROM model",
)
def _(spark, folder):
    model = fc.trend_model(slim_series(spark, folder), CFG)
    return model.select(
        "metric", F.col("n").cast("bigint").alias("n"),
        half_even(F.col("slope"), 4).alias("slope"),
        half_even(F.col("intercept"), 2).alias("intercept"),
        half_even(F.col("resid_std"), 2).alias("resid_std"),
    )


@query(
    "w4_recent_mean",
    f"{TREND} SELECT metric, {q.rnd('recent_avg', 4)} AS recent_avg FROM normal",
)
def _(spark, folder):
    model = fc.trend_model(slim_series(spark, folder), CFG)
    return model.select("metric", half_even(F.col("recent_avg"), 4).alias("recent_avg"))


FORECAST_SQL = f"metric, step, {q.iso('date')} AS date, yhat, lower, upper"


@query("m9_w12_forecast_rows", f"{TREND} SELECT {FORECAST_SQL} FROM forecast")
def _(spark, folder):
    return fc.forecast_rows(slim_series(spark, folder), CFG).drop("model", "recent_avg")


@query(
    "m9_forecast_horizon_14",
    f"{SERIES},\n{q.trend(horizon=14)} SELECT {FORECAST_SQL} FROM forecast",
)
def _(spark, folder):
    cfg = CFG.with_(horizon=14)
    return fc.forecast_rows(slim_series(spark, folder), cfg).drop("model", "recent_avg")


ONE_DAY = q.EVENT_FACT.replace(
    "WHERE ts IS NOT NULL", "WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)"
)


@query(
    "m10_flat_fallback",
    f"{q.series_ctes(('category',), ONE_DAY)},\n{q.trend(('category',))} "
    f"SELECT category, {FORECAST_SQL}, 'flat_fallback' AS model FROM forecast",
)
def _(spark, folder):
    fact = event_fact(spark, folder)
    last = fact.filter(F.col("date") == fact.agg(F.max("date")).scalar())
    return fc.forecast_rows(se.daily_series(last, BY_TYPE), BY_TYPE).drop("recent_avg")


@query(
    "m11_custom_forecaster",
    f"{TREND}, tails AS (SELECT metric, max(date) AS last_date, quantile_cont(value, 0.5::DOUBLE) AS middle, "
    "min(value) AS low, max(value) AS high FROM weighted GROUP BY metric) "
    f"SELECT metric, step, strftime(last_date + CAST(step AS INTEGER), '%Y-%m-%d') AS date, {q.rnd('middle', 2)} AS yhat, "
    f"{q.rnd('low', 2)} AS lower, {q.rnd('high', 2)} AS upper FROM tails, range(1, 8) AS steps(step)",
)
def _(spark, folder):
    def middle(points, horizon):
        value = points["value"].astype(float)
        spread = {"yhat": value.median(), "lower": value.min(), "upper": value.max()}
        return pd.DataFrame({"step": range(1, horizon + 1)}).assign(**spread)

    return fc.custom_forecast(slim_series(spark, folder), CFG, middle).drop("model", "recent_avg")


@query(
    "m9_forecast_events",
    f"{q.series_ctes(('category',), q.EVENT_FACT)},\n{q.trend(('category',))} "
    f"SELECT category, {FORECAST_SQL} FROM forecast",
)
def _(spark, folder):
    return fc.forecast_rows(event_series(spark, folder), BY_TYPE).drop("model", "recent_avg")


@query(
    "m12_m13_forecast_summary",
    f"{TREND} SELECT metric, verdict, forecast_pct_change FROM outlook",
)
def _(spark, folder):
    rows = fc.forecast_rows(slim_series(spark, folder), CFG)
    return fc.forecast_summary(rows, CFG).select("metric", "verdict", "forecast_pct_change")


@query(
    "m13_forecast_by_region",
    f"{q.series_ctes(('region',))},\n{q.trend(('region',))} SELECT region, {FORECAST_SQL} FROM forecast",
)
def _(spark, folder):
    rows = fc.forecast_rows(slim_series(spark, folder, BY_REGION), BY_REGION)
    return rows.drop("model", "recent_avg")


SEASONAL = f"""{TREND},
days AS (SELECT *, isodow(date) AS weekday FROM fitted),
parts AS (
  SELECT *, residual - seasonal AS remainder FROM (
    SELECT metric, date, value, weekday, trend, residual,
           avg(residual) OVER (PARTITION BY metric, weekday)
             - avg(residual) OVER (PARTITION BY metric) AS seasonal FROM days)),
profile AS (SELECT metric, weekday, max(seasonal) AS seasonal FROM parts GROUP BY metric, weekday),
spread AS (SELECT metric, quantile_cont(remainder, 0.1::DOUBLE) AS low,
                  quantile_cont(remainder, 0.9::DOUBLE) AS high FROM parts GROUP BY metric)"""


@query(
    "m11_trend_weekday_forecast",
    f"""{SEASONAL} SELECT metric, step, {q.iso('date')} AS date,
    {q.rnd('greatest(0, c)', 2)} AS yhat, {q.rnd('greatest(0, c + low)', 2)} AS lower,
    {q.rnd('greatest(0, c + high)', 2)} AS upper FROM (
      SELECT a.metric, a.step, a.date, a.centre + coalesce(p.seasonal, 0) AS c, s.low, s.high
      FROM ahead a LEFT JOIN profile p ON a.metric = p.metric AND isodow(a.date) = p.weekday
      JOIN spread s ON a.metric = s.metric)""",
)
def _(spark, folder):
    cfg = CFG.with_(model="trend_weekday")
    return fc.forecast_rows(slim_series(spark, folder), cfg).drop("model", "recent_avg")


@query(
    "x8_decomposition",
    f"{SEASONAL} SELECT metric, {q.iso('date')} AS date, value, weekday, {q.rnd('trend', 2)} AS trend, "
    f"{q.rnd('seasonal', 2)} AS seasonal, {q.rnd('remainder', 2)} AS remainder FROM parts",
)
def _(spark, folder):
    parts = ins.decompose(slim_series(spark, folder), CFG)
    return parts.select(
        "metric", "date", "value", "weekday",
        *[half_even(F.col(c), 2).alias(c) for c in ("trend", "seasonal", "remainder")],
    )


PIECEWISE = f"{SERIES},\n{q.piecewise()}"


@query(
    "m11_change_points",
    f"""{PIECEWISE} SELECT metric, step, {q.iso('date')} AS date, {q.rnd(q.rnd('greatest(0, centre)', 2) + ' / recent', 5)} AS yhat,
    {q.rnd(q.rnd('greatest(0, centre + low)', 2) + ' / recent', 5)} AS lower,
    {q.rnd(q.rnd('greatest(0, centre + high)', 2) + ' / recent', 5)} AS upper FROM bent""",
)
def _(spark, folder):
    rows = fc.forecast_rows(slim_series(spark, folder), CFG.with_(model="piecewise_weekly"))
    # against the recent level, so that digits mean the same for every metric
    shares = [half_even(F.col(c) / F.col("recent_avg"), 5).alias(c) for c in ("yhat", "lower", "upper")]
    return rows.select("metric", "step", "date", *shares)


@query(
    "m11_trend_breaks",
    f"""{PIECEWISE}, bends AS (
      SELECT metric, knot, CAST(first_date + CAST(round(0.1::DOUBLE * knot * days) AS INTEGER) AS DATE) AS date,
        {q.rnd('beta[2 + knot] * scale / days / recent', 6)} AS change,
        {q.rnd('(beta[2] + list_sum(beta[3:2 + knot])) * scale / days / recent', 6)} AS slope_after,
        row_number() OVER (PARTITION BY metric ORDER BY abs(beta[2 + knot]) DESC) AS rank
      FROM spans JOIN solutions USING (metric) CROSS JOIN (SELECT unnest(range(1, 9)) AS knot))
    SELECT metric, knot, {q.iso('date')} AS date, change, slope_after, rank FROM bends""",
)
def _(spark, folder):
    series = slim_series(spark, folder)
    recent = fc.trend_model(series, CFG).select("metric", "recent_avg")
    level = F.col("recent_avg")
    return cp.trend_breaks(series, CFG).join(recent, "metric").select(
        "metric", "knot", "date", half_even(F.col("change") / level, 6).alias("change"),
        half_even(F.col("slope_after") / level, 6).alias("slope_after"), "rank",
    )


@query("x8_robust_decomposition")
def _(spark, folder):
    parts = robust.robust_decompose(slim_series(spark, folder), CFG)
    places = {"trend": 2, "seasonal": 2, "remainder": 2, "weight": 6}
    return parts.select("metric", "date", "value", *[half_even(F.col(c), n).alias(c) for c, n in places.items()])


# --- advice, confidence, brief --------------------------------------------------------


BOOK = """(VALUES ('campaign', 0.55, 0.85, 0.88, 0.75), ('region', 0.55, 0.85, 0.78, 0.65),
  ('category', 0.55, 0.85, 0.72, 0.72), ('channel', 0.55, 0.85, 0.80, 0.80),
  ('inventory_status', 0.70, 0.90, 0.82, 0.82), ('incident_flag', 0.60, 0.85, 0.90, 0.90))
  AS book(dimension, low_factor, high_factor, confidence_high, confidence_other)"""
ADVICE = f"""{FULL},
declining AS (
  SELECT * FROM drivers WHERE delta < 0
  QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY rank) = 1),
matched AS (
  SELECT d.dimension AS source, d.rank, abs(contribution_pct) AS share, low_factor, high_factor,
         confidence_high, confidence_other,
         CASE WHEN abs(contribution_pct) >= 40 OR s.severity = 'CRITICAL' THEN 'HIGH'
              WHEN abs(contribution_pct) >= 20 OR s.severity = 'WARNING' THEN 'MEDIUM'
              ELSE 'LOW' END AS priority
  FROM declining d JOIN {BOOK} ON d.dimension = book.dimension CROSS JOIN summary s),
advice AS (
  SELECT source, rank AS emit, priority,
         CAST(trunc(share * low_factor::DOUBLE) AS BIGINT) AS impact_low,
         CAST(trunc(share * high_factor::DOUBLE) AS BIGINT) AS impact_high,
         CAST(CASE WHEN priority = 'HIGH' THEN confidence_high ELSE confidence_other END AS DOUBLE)
           AS confidence FROM matched
  UNION ALL
  SELECT 'orders_volume', 1000000, 'MEDIUM', 10, 20, 0.70::DOUBLE FROM card
  WHERE metric = 'orders' AND anomaly_detected
  UNION ALL
  SELECT 'aov_decline', 1000001, 'MEDIUM', 5, 15, 0.68::DOUBLE FROM card
  WHERE metric = 'avg_order_value' AND anomaly_detected AND change_pct < -5),
recs AS (
  SELECT * FROM advice
  UNION ALL
  SELECT 'monitor', 1000002, 'LOW', 10, 10, 0.95::DOUBLE FROM summary
  WHERE severity = 'NORMAL' OR (SELECT count(*) FROM advice) = 0),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1
                               ELSE 2 END, emit) AS position FROM recs)"""

def stages(spark, folder):
    return analyze(star_source(spark, folder), CFG, check=False)


@query(
    "j4_m15_m17_playbook_advice",
    f"{ADVICE} SELECT source, priority, impact_low, impact_high, confidence FROM advice "
    "WHERE emit < 1000000",
)
def _(spark, folder):
    b = stages(spark, folder)
    advice = rec.driver_advice(b.drivers, b.summary, rec.playbook_table(spark), CFG)
    return advice.select("source", "priority", "impact_low", "impact_high", "confidence")


@query(
    "m16_m18_o2_m19_recommendations",
    f"{ADVICE} SELECT position, source, priority, impact_low, impact_high, confidence FROM ordered",
)
def _(spark, folder):
    return stages(spark, folder).recommendations.select(
        "position", "source", "priority", "impact_low", "impact_high", "confidence"
    )


@query(
    "a20_by_priority",
    f"""{ADVICE} SELECT p.priority, count(r.priority) AS n,
    {q.rnd('count(r.priority) / (SELECT count(*) FROM recs)::DOUBLE * 1e2', 0)} AS pct
    FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) AS p(priority)
    LEFT JOIN recs r ON p.priority = r.priority GROUP BY p.priority""",
)
def _(spark, folder):
    return rec.by_priority(stages(spark, folder).recommendations, CFG)


@query(
    "a21_combined_impact",
    f"{ADVICE} SELECT sum(impact_low)::DOUBLE AS combined_impact FROM recs",
)
def _(spark, folder):
    return rec.combined_impact(stages(spark, folder).recommendations, CFG)


EVIDENCE = f"{FULL},\n{q.evidence()}"


@query(
    "a15_driver_evidence",
    f"{EVIDENCE} SELECT strong_drivers, enterprise_signal FROM evidence",
)
def _(spark, folder):
    ranked = at.drivers(star_source(spark, folder), CFG)
    return ex.driver_evidence(ranked, CFG).select("strong_drivers", "enterprise_signal")


@query("a16_confidence", f"{EVIDENCE} SELECT confidence FROM confidence")
def _(spark, folder):
    return stages(spark, folder).explanation.select("confidence")


@query(
    "m20_m21_explanation",
    f"""{EVIDENCE}, {q.TEXTS}
    SELECT severity, change, confidence, strong_drivers, enterprise_signal, top_driver, prediction, narrative,
    false AS llm_powered FROM told""",
)
def _(spark, folder):
    return stages(spark, folder).explanation.select(
        "severity", "change", "confidence", "strong_drivers", "enterprise_signal", "top_driver", "prediction",
        "narrative", "llm_powered",
    )


INTENT_CASE = """CASE WHEN regexp_matches(lower(text), 'why|cause|reason|driver') THEN 'cause'
    WHEN regexp_matches(lower(text), 'forecast|next|future|predict') THEN 'forecast'
    WHEN regexp_matches(lower(text), 'recommend|do|action|fix|improve') THEN 'action'
    WHEN regexp_matches(lower(text), 'risk|danger|worst|concern') THEN 'risk'
    WHEN regexp_matches(lower(text), 'segment|region|category|channel') THEN 'segment' ELSE 'overview' END"""


@query(
    "m22_j6_question_intents",
    f"SELECT conv_id, turn, {INTENT_CASE} AS intent FROM conversations WHERE role = 'user'",
)
def _(spark, folder):
    questions = table(spark, folder, "conversations").filter(F.col("role") == "user")
    return questions.select("conv_id", "turn", ex.question_intent(F.col("text")).alias("intent"))


@query(
    "m22_answers",
    f"""{ADVICE}, {q.evidence()}, {q.TEXTS},
    asked AS (SELECT conv_id, turn, {INTENT_CASE} AS intent FROM conversations WHERE role = 'user'),
    shown AS (SELECT *, printf('%+.1f%%', top_share) AS share FROM told)
    SELECT conv_id, turn, intent, CASE intent
      WHEN 'cause' THEN 'The move of ' || change || ' comes mostly from: ' || top_driver || ' (' || share || ' of the change).'
      WHEN 'forecast' THEN prediction || '; the band is a rule of thumb.'
      WHEN 'action' THEN 'Start with: advice on ' || source
      WHEN 'risk' THEN 'Severity is ' || severity || ' after a move of ' || change || '.'
      WHEN 'segment' THEN 'Most affected: ' || top_driver || ' (' || share || ').'
      ELSE 'Severity ' || severity || ', revenue ' || change || '. ' || top_driver || ' (' || share || '). advice on ' || source
      END AS answer
    FROM asked CROSS JOIN shown CROSS JOIN (SELECT source FROM ordered WHERE position = 1)""",
)
def _(spark, folder):
    b = stages(spark, folder)
    questions = table(spark, folder, "conversations").filter(F.col("role") == "user")
    # the wording of advice is its own; the comparison names its source
    short = b.recommendations.withColumn("action", F.concat(F.lit("advice on "), F.col("source")))
    answers = ex.answer_questions(questions, b.explanation, short)
    return answers.select(
        "conv_id", "turn", "intent",
        F.when(F.col("intent") == "action", F.rtrim(F.col("answer"), F.lit("."))).otherwise(F.col("answer")).alias("answer"),
    )


@query(
    "m23_s14_brief_json",
    f"""{EVIDENCE}, {q.TEXTS}
    SELECT severity, change, confidence, narrative, prediction,
    (SELECT count(*) FROM drivers) AS causes, (SELECT driver FROM texts WHERE rank = 1) AS first_cause,
    (SELECT count(*) FROM daily) AS days, (SELECT {q.rnd('sum(revenue)::DOUBLE', 0)} FROM daily) AS revenue,
    (SELECT {q.iso('max(date)')} FROM forecast WHERE metric = 'revenue') AS last_forecast,
    (SELECT {q.rnd('sum(yhat)', 1)} FROM forecast WHERE metric = 'orders') AS orders_ahead,
    (SELECT anomaly_count FROM card WHERE metric = 'avg_order_value') AS odd_ticket_days, '1.0.0' AS version FROM told""",
)
def _(spark, folder):
    rows = to_json_rows(stages(spark, folder).document().drop("timestamp"), CFG)
    # read back what was written
    parsed = rows.select(
        F.from_json(
            "document",
            "severity string, change string, confidence double, explanation string, prediction string, "
            "root_cause array<struct<rank: int, driver: string>>, dates array<string>, revenue array<double>, "
            "forecast_dates array<string>, per_metric_forecast map<string, struct<forecast_values: array<double>>>, "
            "per_metric map<string, struct<anomaly_count: bigint>>, pipeline_version string",
        ).alias("d")
    ).select("d.*")

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    return parsed.select(
        "severity", "change", "confidence", F.col("explanation").alias("narrative"), "prediction",
        F.size("root_cause").alias("causes"),
        F.col("root_cause")[0]["driver"].alias("first_cause"),
        F.size("dates").alias("days"),
        half_even(total(F.col("revenue")), 0).alias("revenue"),
        F.array_max("forecast_dates").alias("last_forecast"),
        half_even(total(F.col("per_metric_forecast")["orders"]["forecast_values"]), 1).alias("orders_ahead"),
        F.col("per_metric")["avg_order_value"]["anomaly_count"].alias("odd_ticket_days"),
        F.col("pipeline_version").alias("version"),
    )


REGION = ("region",)


@query(
    "m23_brief_by_region",
    f"{q.series_ctes(REGION)},\n{q.scored(REGION)},\n{q.card(REGION)},\n{q.summary(REGION)},\n"
    f"{q.attribution(REGION)},\n{q.trend(REGION)},\n{q.evidence(REGION)} "
    "SELECT region, severity, change_pct, forecast_pct_change, confidence FROM confidence",
)
def _(spark, folder):
    b = analyze(star_source(spark, folder), BY_REGION, check=False)
    return b.explanation.select(
        "region", "severity", "change_pct", "forecast_pct_change", "confidence"
    )


KPI_SQL = f"""{FACTS}, {q.daily()},
numbered AS (
  SELECT *, {q.rnd('revenue::DOUBLE / greatest(orders::DOUBLE, 1e0)', 2)} AS aov,
         row_number() OVER (ORDER BY date DESC) AS rn FROM daily),
sums AS (
  SELECT sum(revenue) FILTER (rn <= 14)::DOUBLE AS r1,
         sum(revenue) FILTER (rn BETWEEN 15 AND 28)::DOUBLE AS r0,
         sum(orders) FILTER (rn <= 14)::DOUBLE AS o1,
         sum(orders) FILTER (rn BETWEEN 15 AND 28)::DOUBLE AS o0,
         sum(CAST(aov AS DECIMAL(28,4))) FILTER (rn <= 14)::DOUBLE / 14e0 AS a1,
         sum(CAST(aov AS DECIMAL(28,4))) FILTER (rn BETWEEN 15 AND 28)::DOUBLE / 14e0 AS a0
  FROM numbered),
cards AS (
  SELECT 'revenue' AS kpi, r1 AS raw, r0 AS prior, {q.rnd(q.pct('r1', 'r0'), 1)} AS chg FROM sums
  UNION ALL SELECT 'orders', o1, o0, {q.rnd(q.pct('o1', 'o0'), 1)} FROM sums
  UNION ALL SELECT 'aov', a1, a0, {q.rnd(q.pct('a1', 'a0'), 1)} FROM sums
  UNION ALL SELECT 'health',
    least(100, greatest(0, {q.rnd(q.rnd(q.pct('r1', 'r0'), 1) + ' + 50e0', 0)})), 50,
    {q.rnd(q.pct('r1', 'r0'), 1)} FROM sums)"""


@query(
    "a13_a14_kpi_cards",
    f"{KPI_SQL} SELECT kpi, {q.rnd('raw', 4)} AS raw, {q.rnd('prior', 4)} AS prior, chg FROM cards",
)
def _(spark, folder):
    cards = kp.kpi_cards(se.daily_totals(star_fact(spark, folder, SLIM), CFG), CFG)
    return cards.select(
        "kpi", half_even(F.col("raw"), 4).alias("raw"), half_even(F.col("prior"), 4).alias("prior"),
        "chg",
    )


@query(
    "a22_health_radar",
    f"""{EVIDENCE}, {KPI_SQL[KPI_SQL.index('numbered AS'):]}
    SELECT kpi AS axis, least(100, greatest(0, 50 + chg))::DOUBLE AS score FROM cards
    WHERE kpi <> 'health'
    UNION ALL SELECT 'confidence', {q.rnd('confidence * 1e2', 0)} FROM confidence
    UNION ALL SELECT 'stability', CASE WHEN anomaly_detected THEN 30 ELSE 80 END::DOUBLE FROM summary""",
)
def _(spark, folder):
    b = stages(spark, folder)
    return vw.health_radar(b.kpis, b.explanation, CFG)


@query(
    "a23_waterfall",
    f"""{DRIVERS},
    steps AS (SELECT rank AS step, dimension || ':' || group_value AS label,
      abs(contribution_pct) AS height FROM drivers)
    SELECT step, label, height,
      {q.rnd('1e2 - sum(CAST(height AS DECIMAL(18,1))) OVER (ORDER BY step)::DOUBLE', 1)} AS base,
      {q.rnd('lag(height, 1, 100.0::DOUBLE) OVER (ORDER BY step) - height', 1)} AS chart_base FROM steps
    UNION ALL SELECT 0, 'Baseline', 100, 0, 0
    UNION ALL SELECT max(step) + 1, 'Net impact',
      sum(CAST(height AS DECIMAL(18,1)))::DOUBLE, 0, 0 FROM steps""",
)
def _(spark, folder):
    return vw.waterfall(at.drivers(star_source(spark, folder), CFG), CFG)

