"""Playbook-driven recommendations from drivers and scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import attach, half_even
from tallyveer.operators.attribute import NOT_APPLICABLE

PRIORITIES = ("HIGH", "MEDIUM", "LOW")
MONITOR = "monitor"

PLAYBOOK_SCHEMA = """
    dimension string, special_group string, action string, special_action string, owner string,
    low_factor double, high_factor double, confidence_high double, confidence_other double
"""

# One row per dimension with a rule. An action says what the figures of the driver leave open and where the fact can answer it;
# ``{group}``, ``{loss}`` and ``{share}`` are the driver's own. The factors and confidences.
PLAYBOOK = [
    (
        "campaign", None,
        "{group} is down by {loss}, {share}% of the change: lay its daily revenue over that of the other campaigns and name the "
        "day they part", None,
        "campaign", 0.55, 0.85, 0.88, 0.75,
    ),
    (
        "region", None,
        "{group} is short of {loss}, {share}% of the change: rank its products by what they lost and see which of them lost "
        "elsewhere too", None,
        "region", 0.55, 0.85, 0.78, 0.65,
    ),
    (
        "category", None,
        "{loss} is missing in {group}, {share}% of the change: tell from its orders and revenue per order whether fewer "
        "people bought or each spent less", None,
        "category", 0.55, 0.85, 0.72, 0.72,
    ),
    (
        "channel", None,
        "{group} took {loss} less, {share}% of the change: compare its impressions with its orders, window against window", None,
        "channel", 0.55, 0.85, 0.80, 0.80,
    ),
    (
        "inventory_status", "out_of_stock",
        "Goods marked {group} sold for {loss} less, {share}% of the change: count the products that came into this state and since "
        "when",
        "Goods that are gone sold for {loss} less, {share}% of the change: list them by what they made in the window before",
        "stock", 0.70, 0.90, 0.82, 0.82,
    ),
    (
        "incident_flag", None,
        "Rows under an incident cost {loss}, {share}% of the change: run the analysis once more without them and keep what remains", None,
        "incidents", 0.60, 0.85, 0.90, 0.90,
    ),
]

#: When to look, by priority.
DUE = {"HIGH": "today", "MEDIUM": "this week", "LOW": "with the next brief"}


def playbook_table(spark: SparkSession) -> DataFrame:
    """The built-in playbook; pass any table of the same schema instead."""
    return spark.createDataFrame(PLAYBOOK, PLAYBOOK_SCHEMA)


def priority(share: Column, severity: Column) -> Column:
    return (
        F.when((share >= 40) | (severity == "CRITICAL"), "HIGH")
        .when((share >= 20) | (severity == "WARNING"), "MEDIUM")
        .otherwise("LOW")
    )


def priority_rank(name: Column) -> Column:
    return F.when(name == "HIGH", 0).when(name == "MEDIUM", 1).otherwise(2)


def due(name: Column) -> Column:
    out = F.lit(DUE["LOW"])
    for level in ("MEDIUM", "HIGH"):
        out = F.when(name == level, DUE[level]).otherwise(out)
    return out


def filled_in(template: Column, **values: Column) -> Column:
    """Placeholders in braces replaced by values, taken as they are."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def first_declining(drivers: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """The highest-ranked declining driver of every dimension."""
    w = Window.partitionBy(*cfg.series_keys, "dimension").orderBy("rank")
    return (
        drivers.filter((F.col("delta") < 0) & (F.col("dimension") != NOT_APPLICABLE))
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )


def driver_advice(
    drivers: DataFrame, summary: DataFrame, playbook: DataFrame, cfg: AnalysisConfig
) -> DataFrame:
    """Playbook rules applied to the first declining driver per dimension."""
    keys = list(cfg.series_keys)
    share = F.abs("contribution_pct")
    special = F.col("special_group").isNotNull() & (
        F.col("group_value") == F.col("special_group")
    )
    matched = attach(
        first_declining(drivers, cfg).join(playbook, "dimension", "inner"),
        summary.select(*keys, F.col("severity").alias("overall_severity")),
        keys,
    ).withColumn("priority", priority(share, F.col("overall_severity")))
    low = (share * F.col("low_factor")).cast("int")
    high = (share * F.col("high_factor")).cast("int")
    return matched.select(
        *keys,
        F.col("rank").alias("emit_order"),
        F.col("dimension").alias("source"),
        "priority",
        filled_in(
            F.when(special, F.col("special_action")).otherwise(F.col("action")),
            loss=F.format_number(F.abs("delta"), 0),
            share=F.format_number(share, 0),
            group=F.col("group_value"),
        ).alias("action"),
        F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit("% of the loss")).alias("expected_impact"),
        low.alias("impact_low"),
        high.alias("impact_high"),
        due(F.col("priority")).alias("timeline"),
        "owner",
        F.when(F.col("priority") == "HIGH", F.col("confidence_high"))
        .otherwise(F.col("confidence_other"))
        .alias("confidence"),
    )


def metric_advice(card: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Advice on order volume and ticket size, straight from the scorecard."""
    keys = list(cfg.series_keys)
    orders = F.col("metric") == "orders"
    ticket = (F.col("metric") == "avg_order_value") & (F.col("change_pct") < -5)
    low = F.when(orders, 10).otherwise(5)
    high = F.when(orders, 20).otherwise(15)
    return card.filter(F.col("anomaly_detected") & (orders | ticket)).select(
        *keys,
        F.when(orders, 1_000_000).otherwise(1_000_001).alias("emit_order"),
        F.when(orders, "orders_volume").otherwise("aov_decline").alias("source"),
        F.lit("MEDIUM").alias("priority"),
        F.when(
            orders,
            F.concat(F.lit("The number of orders is out of line ("), F.col("change"),
                     F.lit("): see whether the flagged days share a weekday, a region or a gap in the records")),
        )
        .otherwise(
            F.concat(F.lit("Revenue per order moved "), F.col("change"),
                     F.lit(": split it by category and tell a change of mix from a change of price")),
        )
        .alias("action"),
        F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit("% of the metric")).alias("expected_impact"),
        low.alias("impact_low"),
        high.alias("impact_high"),
        due(F.lit("MEDIUM")).alias("timeline"),
        F.when(orders, "orders").otherwise("prices").alias("owner"),
        F.when(orders, 0.70).otherwise(0.68).alias("confidence"),
    )


def recommendations(
    drivers: DataFrame,
    card: DataFrame,
    summary: DataFrame,
    playbook: DataFrame,
    cfg: AnalysisConfig,
) -> DataFrame:
    """All advice of a series; a monitoring row where it is calm or nothing applies."""
    keys = list(cfg.series_keys)
    advice = driver_advice(drivers, summary, playbook, cfg).unionByName(
        metric_advice(card, cfg)
    )
    baseline = summary.select(
        *keys,
        F.lit(1_000_002).alias("emit_order"),
        F.lit(MONITOR).alias("source"),
        F.lit("LOW").alias("priority"),
        F.lit("Nothing to look into").alias("action"),
        F.lit("10% is the size of move this rating leaves open").alias("expected_impact"),
        F.lit(10).alias("impact_low"),
        F.lit(10).alias("impact_high"),
        due(F.lit("LOW")).alias("timeline"),
        F.lit("reporting").alias("owner"),
        F.lit(0.95).alias("confidence"),
        (F.col("severity") == "NORMAL").alias("calm"),
    )
    everything = advice.withColumn("calm", F.lit(False)).unionByName(baseline)
    others = F.count_if(F.col("source") != MONITOR).over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy(priority_rank(F.col("priority")), "emit_order")
    # at most one row per playbook dimension plus three
    return (
        everything.withColumn("others", others)
        .filter((F.col("source") != MONITOR) | F.col("calm") | (F.col("others") == 0))
        .withColumn("position", F.row_number().over(w))
        .withColumn("confidence", half_even(F.col("confidence"), 2))
        .drop("emit_order", "calm", "others")
    )


def by_priority(recs: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Count and share of recommendations per priority, zero rows included."""
    keys = list(cfg.series_keys)
    counts = recs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("priority") == p).alias(p) for p in PRIORITIES],
    )
    return counts.unpivot([*keys, "total"], list(PRIORITIES), "priority", "n").select(
        *keys,
        "priority",
        "n",
        F.when(F.col("total") > 0, half_even(F.col("n") / F.col("total") * 100.0, 0))
        .otherwise(0.0)
        .alias("pct"),
    )


def combined_impact(recs: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Sum of the first number in each impact text, 10 where there is none."""
    first = F.regexp_extract("expected_impact", r"(\d+)", 1)
    return recs.groupBy(*cfg.series_keys).agg(
        F.coalesce(
            F.sum(F.coalesce(first.try_cast("double"), F.lit(10.0))), F.lit(0.0)
        ).alias("combined_impact")
    )
