"""Profiling, smoothing, segmentation, decomposition and significance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveer.config import AnalysisConfig
from tallyveer.functions import attach, half_even, pct_change, quoted
from tallyveer.operators.attribute import comparison_slice
from tallyveer.operators.forecast import weekday_profile
from tallyveer.operators.isolation import score_dates
from tallyveer.operators.rollup import exact_sum
from tallyveer.operators.series import FactSource, eligible, series_window


def _distinct_values(df: DataFrame) -> Callable[[Column], Column]:
    """Exact numbers of distinct values as scalar subqueries: rows are not expanded, and only the column travels."""

    def count(c: Column) -> Column:
        return df.select(c.alias("value")).distinct().agg(F.count("value")).scalar()

    return count


def profile_columns(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """One row per column: rows, nulls, distinct values, and number statistics.

    All columns are profiled in a single aggregation. Distinct counts are
    approximate unless asked for, which costs one pass over each column alone.
    """
    count_distinct = _distinct_values(df) if exact_distinct else F.approx_count_distinct
    records = []
    for field in df.schema.fields:
        c = quoted(field.name)
        numeric = isinstance(field.dataType, T.NumericType)
        number = c.cast("double") if numeric else F.lit(None).cast("double")
        records.append(
            (
                field.name,
                [
                    F.count(F.lit(1)),
                    F.count_if(c.isNull()),
                    count_distinct(c),
                    F.min(c).cast("double") if numeric else F.min(number),
                    F.max(c).cast("double") if numeric else F.max(number),
                    F.sum(c.cast("decimal(28,4)")).cast("double") / F.count(c)
                    if numeric
                    else F.max(number),
                ],
            )
        )
    names = ("rows", "nulls", "distinct_values", "min_value", "max_value", "mean_value")
    aggregated = df.agg(
        *[
            expr.alias(f"{i}_{name}")
            for i, (_, exprs) in enumerate(records)
            for name, expr in zip(names, exprs)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(column).alias("column"), *[F.col(f"{i}_{n}").alias(n) for n in names])
            for i, (column, _) in enumerate(records)
        ]
    )
    return aggregated.select(F.inline(rows))


def quantiles(
    df: DataFrame, column: str, by: Sequence[str], levels: Sequence[float], accuracy: int = 10000
) -> DataFrame:
    """Approximate quantiles per group with mergeable, bounded state."""
    values = F.percentile_approx(quoted(column).cast("double"), list(levels), accuracy)
    pairs = F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("level"), F.col("values"))
    return (
        df.groupBy(*by)
        .agg(values.alias("values"))
        .select(*by, F.explode(pairs).alias("pair"))
        .select(*by, F.col("pair").getField("level").alias("level"), F.col("pair.values").alias("value"))
    )


def calendar_gaps(daily: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Days between the first and last date of a series that have no row.

    Each date is compared with the next one, so the table is read once.
    """
    keys = list(cfg.series_keys)
    seen = daily.select(*keys, "date").distinct()
    following = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    gaps = seen.withColumn("next", following).filter(F.datediff("next", "date") > 1)
    days = F.sequence(F.date_add("date", 1), F.date_sub("next", 1))
    return gaps.select(*keys, F.explode(days).alias("date"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct rows that occur more than once, with their count."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_summary(df: DataFrame) -> DataFrame:
    return duplicate_rows(df).agg(
        F.count(F.lit(1)).alias("duplicated_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_rows"),
    )


def rolling(series: DataFrame, cfg: AnalysisConfig, rows: int = 7) -> DataFrame:
    """Trailing mean and day-over-day growth per series."""
    order = series_window(cfg.series_keys).orderBy("date")
    frame = order.rowsBetween(-(rows - 1), 0)
    total = F.sum("amount").over(frame).cast("double")
    before = F.lag("value").over(order)
    return series.select(
        *cfg.series_keys,
        "metric",
        "date",
        "value",
        (total / F.count(F.lit(1)).over(frame)).alias("rolling_mean"),
        F.coalesce(pct_change(F.col("value"), before), F.lit(0.0)).alias("growth_pct"),
    )


def bollinger(
    series: DataFrame, cfg: AnalysisConfig, rows: int = 20, width: float = 2.0
) -> DataFrame:
    """Moving average with a band of ``width`` population deviations; full frames only."""
    order = series_window(cfg.series_keys).orderBy("date")
    frame = order.rowsBetween(-(rows - 1), 0)
    return (
        series.withColumns(
            {
                "n": F.count(F.lit(1)).over(frame),
                # exact sum: a sliding mean must not depend on the order of additions
                "mean": F.sum("amount").over(frame).cast("double") / float(rows),
                "sd": F.stddev_pop("value").over(frame),
            }
        )
        .filter(F.col("n") == rows)
        .select(
            *cfg.series_keys,
            "metric",
            "date",
            "value",
            "mean",
            (F.col("mean") - width * F.col("sd")).alias("lower"),
            (F.col("mean") + width * F.col("sd")).alias("upper"),
        )
    )


def segments(fact: DataFrame, dimensions: Sequence[str], cfg: AnalysisConfig) -> DataFrame:
    """Revenue and orders for every group of every dimension (grouping sets)."""
    keys = list(cfg.series_keys)
    for d in dimensions:
        fact = fact.withColumn(f"_d_{d}", F.col(d))
    copies = [f"_d_{d}" for d in dimensions]
    sums = fact.groupingSets([[*keys, c] for c in copies], *keys, *copies).agg(
        *[F.grouping(c).alias(f"_g{c}") for c in copies],
        exact_sum("revenue").alias("revenue"),
        exact_sum("orders").alias("orders"),
    )
    dimension, value = F.lit(None), F.lit(None)
    for d in dimensions:
        here = F.col(f"_g_d_{d}") == 0
        dimension = F.when(here, d).otherwise(dimension)
        value = F.when(here, F.coalesce(F.col(f"_d_{d}"), F.lit("Unknown"))).otherwise(value)
    return sums.select(
        *keys,
        dimension.cast("string").alias("dimension"),
        value.cast("string").alias("group_value"),
        F.col("revenue").cast("double").alias("revenue"),
        F.col("orders").cast("double").alias("orders"),
        F.col("revenue").alias("revenue_exact"),
    )


def segment_cube(fact: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Revenue for every combination of the dimensions, subtotals included."""
    cells = fact.cube(*dimensions).agg(
        *[F.grouping(d).cast("int").alias(f"all_{d}") for d in dimensions],
        exact_sum("revenue").cast("double").alias("revenue"),
        exact_sum("orders").cast("double").alias("orders"),
    )
    return cells.select(
        *[
            F.when(F.col(f"all_{d}") == 1, "(all)").otherwise(F.col(d)).alias(d)
            for d in dimensions
        ],
        "revenue",
        "orders",
    )


def concentration(groups: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Herfindahl index, largest share and number of groups per dimension.

    Computed from sums, so no group list is sorted or collected.
    """
    value = F.col("revenue")
    total = F.sum("revenue_exact").cast("double")
    return (
        groups.groupBy(*cfg.series_keys, "dimension")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            total.alias("total"),
            F.sum(value * value).alias("squares"),
            F.max("revenue").alias("largest"),
        )
        .select(
            *cfg.series_keys,
            "dimension",
            "groups",
            F.when(F.col("total") != 0, F.col("squares") / (F.col("total") * F.col("total")))
            .otherwise(0.0)
            .alias("hhi"),
            F.when(F.col("total") != 0, F.col("largest") / F.col("total"))
            .otherwise(0.0)
            .alias("largest_share"),
        )
    )


def anomaly_calendar(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Flagged dates per ISO week and weekday, one column per weekday."""
    flags = score_dates(eligible(series, cfg), cfg).withColumns(
        {"week_start": F.date_trunc("week", "date").cast("date"), "day": F.weekday("date")}
    )
    names = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
    return flags.groupBy(*cfg.series_keys, "metric", "week_start").agg(
        *[F.count_if(F.col("flagged") & (F.col("day") == i)).alias(n) for i, n in enumerate(names)]
    )


def decompose(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Trend, weekday seasonality and remainder of the trend rows."""
    return weekday_profile(series, cfg).select(
        *cfg.series_keys, "metric", "date", "value", "weekday", "trend", "seasonal", "remainder"
    )


def correlated_groups(fact: DataFrame, dimension: str, cfg: AnalysisConfig) -> DataFrame:
    """Correlation of each group's daily revenue with the rest of the total.

    Dates without rows of a group count as 0. The sums come from one pass over (group, date); groups are compared with the total, not with
    each other. Values are centred, in exact decimals, before they are squared.
    """
    keys = list(cfg.series_keys)
    by_day = fact.groupBy(*keys, "date", F.col(dimension).alias("group_value")).agg(
        exact_sum("revenue").alias("own")
    )
    totals = by_day.groupBy(*keys, "date").agg(F.sum("own").alias("total"))
    days = totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean"))
    moves = attach(totals, days, keys).select(
        *keys, "date", "n", (F.col("total") - F.col("mean")).cast("double").alias("move")
    )
    spread = moves.groupBy(*keys).agg(F.sum(F.col("move") * F.col("move")).alias("stt"))
    usual = (F.sum("own").over(Window.partitionBy(*keys, "group_value")) / F.col("n")).alias("usual")
    own = by_day.join(moves, [*keys, "date"]).select("*", usual)
    own = own.withColumn("off", (F.col("own") - F.col("usual")).cast("double"))
    off, move = F.col("off"), F.col("move")
    rest = move - off
    sums = own.groupBy(*keys, "group_value").agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("present"),
        F.max("usual").cast("double").alias("usual"),
        F.sum(off * off).alias("soo"),
        F.sum(off * rest).alias("sor"),
        F.sum(rest * rest).alias("srr"),
        F.sum(move).alias("st"),
        F.sum(move * move).alias("stt_present"),
    )
    # dates without rows: the group is its usual value below, the rest that much above
    absent = (F.col("n") - F.col("present")).cast("double")
    usual, lacking = F.col("usual"), absent > 0
    far = absent * usual * usual
    cov = F.col("sor") + F.when(lacking, usual * F.col("st") - far).otherwise(0.0)
    var_own = F.col("soo") + F.when(lacking, far).otherwise(0.0)
    var_rest = F.col("srr") + F.when(
        lacking, F.col("stt") - F.col("stt_present") - 2.0 * usual * F.col("st") + far
    ).otherwise(0.0)
    var = var_own * var_rest
    return attach(sums, spread, keys).select(
        *keys,
        "group_value",
        F.when(var > 0, cov / F.sqrt(var)).otherwise(0.0).alias("correlation"),
    )


def change_significance(source: FactSource, cfg: AnalysisConfig) -> DataFrame:
    """Welch statistic of daily revenue between the two windows, per dimension group."""
    keys, dims = list(cfg.series_keys), list(cfg.dimensions)
    sliced = comparison_slice(source, cfg, [*keys, "date", *dims, "revenue"])
    daily = sliced.groupBy(*keys, "date", "is_current", *dims).agg(
        exact_sum("revenue").alias("revenue")
    )
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("group_value")) for d in dims]
    )
    per_day = (
        daily.select(*keys, "date", "is_current", "revenue", F.inline(pairs))
        .groupBy(*keys, "dimension", "group_value", "date", "is_current")
        .agg(F.sum("revenue").cast("double").alias("value"))
    )

    def side(current: bool):
        value = F.when(F.col("is_current") == F.lit(current), F.col("value"))
        return F.count(value), F.avg(value), F.var_samp(value)

    (n1, m1, v1), (n0, m0, v0) = side(True), side(False)
    stats = per_day.groupBy(*keys, "dimension", "group_value").agg(
        n1.alias("n1"), m1.alias("m1"), v1.alias("v1"),
        n0.alias("n0"), m0.alias("m0"), v0.alias("v0"),
    )
    error = F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")
    return stats.filter((F.col("n1") > 1) & (F.col("n0") > 1)).select(
        *keys,
        "dimension",
        "group_value",
        half_even(F.col("m1"), 2).alias("mean_current"),
        half_even(F.col("m0"), 2).alias("mean_previous"),
        half_even(
            F.when(error > 0, (F.col("m1") - F.col("m0")) / F.sqrt(error)).otherwise(0.0), 4
        ).alias("welch_t"),
    )
