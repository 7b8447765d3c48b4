"""Roll the canonical fact up and derive its ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.functions import half_even
from tallyveer.schema import (
    MEASURES,
    MONEY,
    REDUCED_DIMENSIONS,
    REDUCED_MEASURES,
    ROLLUP_DIMENSIONS,
)


def exact_sum(column: str | Column) -> Column:
    """Order-independent sum: decimal accumulation, null counts as 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(c.cast(MONEY)), F.lit(0).cast(MONEY))


def average_order_value(revenue: Column, orders: Column) -> Column:
    rev, cnt = revenue.cast("double"), orders.cast("double")
    return F.when(cnt > 0, half_even(rev / cnt, 2)).otherwise(0.0)


def conversion_rate(orders: Column, impressions: Column) -> Column:
    cnt, seen = orders.cast("double"), impressions.cast("double")
    return F.when(seen > 0, half_even(cnt / seen * 100.0, 4)).otherwise(0.0)


def derive_ratios(df: DataFrame) -> DataFrame:
    """Ticket size and conversion of each row."""
    return df.withColumns(
        {
            "avg_order_value": average_order_value(F.col("revenue"), F.col("orders")),
            "conversion_rate": conversion_rate(F.col("orders"), F.col("impressions")),
        }
    )


def roll_up(
    fact: DataFrame,
    dimensions: Sequence[str] = ROLLUP_DIMENSIONS,
    measures: Sequence[str] = MEASURES,
) -> DataFrame:
    """Sum the measures per combination of dimensions.

    One shuffle on the dimensions. Spark combines on the map side first, so a
    combination that holds a large part of the rows reaches the shuffle as one
    row per task.
    """
    sums = fact.groupBy(*dimensions).agg(*[exact_sum(m).alias(m) for m in measures])
    return derive_ratios(sums) if set(MEASURES) <= set(measures) else sums


def roll_up_reduced(fact: DataFrame) -> DataFrame:
    """The seven-column profile: five dimensions, revenue and orders, no ratios."""
    return roll_up(fact, REDUCED_DIMENSIONS, REDUCED_MEASURES)
