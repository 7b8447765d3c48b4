"""KPI cards: latest window against the one before, plus a health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import clamp, half_even, pct_change
from tallyveer.operators.series import in_prior, in_recent


def kpi_daily(daily: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Daily revenue, orders and ticket size with at least one order per day assumed."""
    revenue, orders = F.col("revenue").cast("double"), F.col("orders").cast("double")
    return daily.select(
        *cfg.series_keys,
        "date",
        "revenue",
        "orders",
        half_even(revenue / F.greatest(orders, F.lit(1.0)), 2).cast("decimal(28,4)").alias("aov"),
    )


def kpi_cards(daily: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Four rows per series: revenue, orders, aov and health."""
    keys = list(cfg.series_keys)
    order = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    numbered = kpi_daily(daily, cfg).withColumn("rn", F.row_number().over(order))
    rn, n = F.col("rn"), cfg.lookback

    def window_sum(column: str, inside: Column) -> Column:
        return F.sum(F.when(inside, F.col(column)))

    sums = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_dates"),
        *[window_sum(c, in_recent(rn, n)).alias(f"{c}_recent") for c in ("revenue", "orders", "aov")],
        *[window_sum(c, in_prior(rn, n)).alias(f"{c}_prior") for c in ("revenue", "orders", "aov")],
    )
    has_prior = F.col("n_dates") >= 2 * n
    days = F.least(F.col("n_dates"), F.lit(n)).cast("double")

    def recent(column: str) -> Column:
        value = F.col(f"{column}_recent").cast("double")
        return value / days if column == "aov" else value

    def prior(column: str) -> Column:
        value = F.col(f"{column}_prior").cast("double")
        value = value / float(n) if column == "aov" else value
        return F.when(has_prior, value).otherwise(recent(column))

    def change(column: str) -> Column:
        return half_even(pct_change(recent(column), prior(column)), 1)

    health = health_score(change("revenue"))

    def card(key: str, label: str, raw: Column, before: Column, chg: Column) -> Column:
        return F.struct(
            F.lit(key).alias("kpi"),
            F.lit(label).alias("label"),
            raw.alias("raw"),
            before.alias("prior"),
            chg.alias("chg"),
        )

    cards = F.array(
        card("revenue", "Total Revenue", recent("revenue"), prior("revenue"), change("revenue")),
        card("orders", "Total Orders", recent("orders"), prior("orders"), change("orders")),
        card("aov", "Avg Order Value", recent("aov"), prior("aov"), change("aov")),
        card("health", "Health Score", health, F.lit(50.0), change("revenue")),
    )
    text = (
        F.when(F.col("kpi") == "revenue", F.concat(F.lit("$"), F.format_number("raw", 0)))
        .when(F.col("kpi") == "orders", F.format_number(F.floor("raw"), 0))
        .when(F.col("kpi") == "aov", F.concat(F.lit("$"), F.format_string("%.2f", half_even(F.col("raw"), 2))))
        .otherwise(F.concat(F.format_number("raw", 0), F.lit(" / 100")))
    )
    return (
        sums.select(*keys, F.inline(cards))
        .withColumn("val", text)
        .select(*keys, "kpi", "label", "val", "raw", "prior", "chg")
    )


def health_score(revenue_change: Column) -> Column:
    return clamp(half_even(revenue_change + 50.0, 0), 0, 100)
