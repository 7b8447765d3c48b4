"""Root-cause attribution: which groups moved revenue between two calendar windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import attach, half_even
from tallyveer.operators.order import numbered
from tallyveer.operators.rollup import exact_sum
from tallyveer.operators.series import FactSource, narrow
from tallyveer.schema import FACT_COLUMNS

NOT_APPLICABLE = "n/a"
EVENT_ACTIVE = "event_active"


def anchor_date(source: FactSource, cfg: AnalysisConfig) -> Column:
    """Last date of the analysis: given, else the fact's own maximum.

    The maximum is a scalar subquery over the date column alone, so it reaches
    the scan as a value and prunes date partitions.
    """
    if cfg.as_of is not None:
        return F.lit(cfg.as_of)
    return narrow(source, ["date"]).agg(F.max("date")).scalar()


def comparison_slice(
    source: FactSource, cfg: AnalysisConfig, columns: Sequence[str] = FACT_COLUMNS
) -> DataFrame:
    """Facts of the two windows only, with ``is_current`` telling them apart."""
    last = anchor_date(source, cfg)
    return (
        narrow(source, columns)
        .filter((F.col("date") > F.date_sub(last, 2 * cfg.lookback)) & (F.col("date") <= last))
        .withColumn("is_current", F.col("date") > F.date_sub(last, cfg.lookback))
    )


def window_sums(source: FactSource, cfg: AnalysisConfig) -> DataFrame:
    """Sums of both windows per group of every dimension, and per series.

    The slice is first summed over the dimensions and flags, which combines on the map side to few rows per task; one
    grouping-sets aggregation over those replaces a group-by and an outer join per dimension. Rows with ``dimension`` null are the
    series totals and carry the flag statistics, which count the rows of the fact.
    """
    keys, dims = list(cfg.series_keys), list(cfg.dimensions)
    flags = ["incident_flag", "holiday_flag"]
    wanted = list(dict.fromkeys([*keys, *dims, *flags]))
    sliced = comparison_slice(source, cfg, ["date", *wanted, "revenue"])
    summed = sliced.groupBy(*wanted, "is_current").agg(
        exact_sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("rows")
    )
    # a series key may also be a dimension: group by copies
    for d in dims:
        summed = summed.withColumn(f"_d_{d}", F.col(d))
    copies = [f"_d_{d}" for d in dims]
    revenue, rows, current = F.col("revenue"), F.col("rows"), F.col("is_current")
    incident = F.col("incident_flag") == 1
    calm = F.col("incident_flag") == 0
    holiday = F.col("holiday_flag") == 1

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, revenue)), F.lit(0).cast("decimal(38,4)"))

    def counted(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0))

    sums = summed.groupingSets(
        [[*keys, c] for c in copies] + [[*keys]], *keys, *copies
    ).agg(
        *[F.grouping(c).alias(f"_g{c}") for c in copies],
        total(current).alias("cur"),
        total(~current).alias("prv"),
        counted(~current).alias("prv_rows"),
        counted(current & incident).alias("incident_rows"),
        total(current & incident).alias("incident_revenue"),
        counted(current & calm).alias("calm_rows"),
        total(current & calm).alias("calm_revenue"),
        total(current & holiday).alias("holiday_cur"),
        total(~current & holiday).alias("holiday_prv"),
    )
    dimension, order, value = F.lit(None), F.lit(None), F.lit(None)
    for i, d in enumerate(dims):
        here = F.col(f"_g_d_{d}") == 0
        dimension = F.when(here, d).otherwise(dimension)
        order = F.when(here, i).otherwise(order)
        value = F.when(here, F.coalesce(F.col(f"_d_{d}"), F.lit("Unknown"))).otherwise(value)
    return sums.select(
        *keys,
        dimension.cast("string").alias("dimension"),
        order.cast("int").alias("dim_order"),
        value.cast("string").alias("group_value"),
        "cur",
        "prv",
        "prv_rows",
        "incident_rows",
        "incident_revenue",
        "calm_rows",
        "calm_revenue",
        "holiday_cur",
        "holiday_prv",
    )


FLAG_STATISTICS = (
    "prv_rows",
    "incident_rows",
    "incident_revenue",
    "calm_rows",
    "calm_revenue",
    "holiday_cur",
    "holiday_prv",
)


def series_totals(sums: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per series: totals, total change and the flag statistics."""
    return sums.filter(F.col("dimension").isNull()).select(
        *cfg.series_keys,
        F.col("cur").cast("double").alias("total_cur"),
        F.col("prv").cast("double").alias("total_prv"),
        (F.col("cur") - F.col("prv")).cast("double").alias("total_delta"),
        *[F.col(c).cast("double").alias(f"total_{c}") for c in FLAG_STATISTICS],
    )


def share_of(delta: Column) -> Column:
    """Share of the total change in percent, 0 when nothing changed."""
    return F.when(
        F.col("total_delta") != 0, delta / F.col("total_delta") * 100.0
    ).otherwise(0.0)


def comparable() -> Column:
    """A series has a previous window and a change to explain."""
    return (F.col("total_prv_rows") > 0) & (F.col("total_delta") != 0)


def contributions(sums: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Change and share of every group before the cut-off.

    The share is positive when the group moved with the total; the direction of
    a group comes from the sign of its own change.
    """
    keys = list(cfg.series_keys)
    totals = series_totals(sums, cfg).select(*keys, "total_delta")
    groups = sums.filter(F.col("dimension").isNotNull()).select(
        *keys,
        "dimension",
        "group_value",
        F.col("cur").cast("double").alias("cur_revenue"),
        F.col("prv").cast("double").alias("prv_revenue"),
        (F.col("cur") - F.col("prv")).cast("double").alias("delta"),
    )
    return attach(groups, totals, keys).withColumn("share", share_of(F.col("delta")))


def _finding(
    valid: Column, dimension: Column | str, order: Column, group: Column | str,
    delta: Column, share: Column, driver: Column,
) -> Column:
    """A candidate driver; null where ``valid`` does not hold."""
    as_column = [F.lit(c) if isinstance(c, str) else c for c in (dimension, group)]
    return F.when(
        valid,
        F.struct(
            as_column[0].alias("dimension"),
            order.cast("int").alias("dim_order"),
            as_column[1].alias("group_value"),
            delta.cast("double").alias("delta"),
            share.cast("double").alias("share"),
            driver.alias("driver"),
        ),
    )


def _amount(delta: Column) -> Column:
    return F.format_number(F.abs(delta), 0)


def _moved(delta: Column) -> Column:
    return F.when(delta < 0, "fell").otherwise("rose")


def group_finding() -> Column:
    """A group of a dimension and its share of the change."""
    delta = (F.col("cur") - F.col("prv")).cast("double")
    name = F.initcap(F.regexp_replace("dimension", "_", " "))
    text = F.concat(
        name, F.lit(" "), F.col("group_value"), F.lit(" "), _moved(delta), F.lit(" by "),
        _amount(delta),
    )
    return _finding(
        comparable(), F.col("dimension"), F.col("dim_order"), F.col("group_value"),
        delta, share_of(delta), text,
    )


def incident_finding(cfg: AnalysisConfig) -> Column:
    """Estimated loss of rows under an incident against rows without one.

    The loss is what the incident rows would have earned at the mean of the
    calm rows; its share is taken of the revenue that would have been.
    """
    n, base_n = F.col("total_incident_rows"), F.col("total_calm_rows")
    loss = F.when(
        (n > 0) & (base_n > 0),
        (F.col("total_calm_revenue") / base_n - F.col("total_incident_revenue") / n) * n,
    )
    share = -loss / (F.col("total_cur") + loss) * 100.0
    text = F.concat(
        F.lit("Incident rows earned "), _amount(loss), F.lit(" less than calm rows would have")
    )
    return _finding(
        comparable() & (F.coalesce(loss, F.lit(0.0)) >= cfg.min_incident_loss),
        "incident_flag", F.lit(len(cfg.dimensions)), EVENT_ACTIVE, -loss, share, text,
    )


def holiday_finding(cfg: AnalysisConfig) -> Column:
    """Change of revenue on holidays as a share of the total change."""
    delta = F.col("total_holiday_cur") - F.col("total_holiday_prv")
    text = F.concat(F.lit("Holiday revenue "), _moved(delta), F.lit(" by "), _amount(delta))
    return _finding(
        comparable() & (F.abs(delta) >= cfg.min_holiday_delta),
        "holiday_flag", F.lit(len(cfg.dimensions) + 1), EVENT_ACTIVE, delta, share_of(delta), text,
    )


def no_driver_finding() -> Column:
    """Placeholder that says why a series has no driver; its share is null."""
    text = (
        F.when(F.col("total_prv_rows") == 0, "Not enough history to compare two windows")
        .when(F.col("total_delta") == 0, "Revenue did not change between the windows")
        .otherwise("No group stands out; watch the metrics together")
    )
    return _finding(
        F.lit(True), NOT_APPLICABLE, F.lit(-1), NOT_APPLICABLE,
        F.when(comparable(), F.col("total_delta")).otherwise(0.0), F.lit(None), text,
    )


def flag_signals(sums: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Incident and holiday findings of every series, before the cut-off."""
    both = F.array_compact(F.array(incident_finding(cfg), holiday_finding(cfg)))
    return (
        series_totals(sums, cfg)
        .select(*cfg.series_keys, F.inline(both))
        .drop("dim_order", "driver")
    )


def rank_drivers(findings: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Apply the cut-off to the unrounded share, then rank by the rounded one.

    The ranking is a range-partitioned sort, so many drivers above the cut-off do not meet in one task. Equal shares are
    ordered by dimension, then by group. Placeholder rows (null share) come
    last and survive only where they are alone.
    """
    keys = list(cfg.series_keys)
    real = F.col("share").isNotNull()
    kept = findings.filter(~real | (F.abs("share") >= cfg.min_share_pct)).select(
        *keys,
        "dimension",
        "dim_order",
        "group_value",
        half_even(F.col("delta"), 2).alias("delta"),
        half_even(F.col("share"), 1).alias("contribution_pct"),
        "driver",
    )
    order = [
        F.abs("contribution_pct").desc_nulls_last(), F.col("dim_order").asc(), F.col("group_value").asc()
    ]
    return (
        numbered(kept, keys, order, "rank")
        .filter(F.col("contribution_pct").isNotNull() | (F.col("rank") == 1))
        .withColumn(
            "contribution_pct",
            F.coalesce("contribution_pct", F.when(F.col("delta") != 0, 100.0).otherwise(0.0)),
        )
    )


def drivers(source: FactSource, cfg: AnalysisConfig) -> DataFrame:
    """Ranked drivers of the change, with a placeholder row where there are none."""
    return drivers_from_sums(window_sums(source, cfg), cfg)


def drivers_from_sums(sums: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Drivers from the sums of both windows.

    Every row of the sums becomes its candidates in place: a group row itself, a
    totals row the flag signals and the placeholder.
    """
    keys = list(cfg.series_keys)
    signals = F.array(incident_finding(cfg), holiday_finding(cfg), no_driver_finding())
    candidates = F.when(F.col("dimension").isNull(), signals).otherwise(F.array(group_finding()))
    findings = attach(sums, series_totals(sums, cfg), keys).select(
        *keys, F.inline(F.array_compact(candidates))
    )
    return rank_drivers(findings, cfg).select(
        *keys, "rank", "driver", "dimension", "group_value", "delta", "contribution_pct"
    )


def both_windows(source: FactSource, dimension: str, cfg: AnalysisConfig) -> DataFrame:
    """Both windows of one dimension side by side, groups of either window kept, from one pass over the slice."""
    keys = list(dict.fromkeys([*cfg.series_keys, dimension]))
    sliced = comparison_slice(source, cfg, [*keys, "date", "revenue"])

    def side(condition: Column, name: str) -> Column:
        return exact_sum(F.when(condition, F.col("revenue"))).cast("double").alias(name)

    return sliced.groupBy(*keys).agg(
        side(F.col("is_current"), "cur_revenue"), side(~F.col("is_current"), "prv_revenue")
    )
