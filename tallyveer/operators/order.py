"""Numbers and running totals in a global order, without one task that sees all rows.

Rows are range-partitioned by the order and stored, so that both passes see the same ranges; small rows per range say what came
before it. A range is as large as Spark makes it, and the per-range rows are as many as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.session import stored

PART = "_range"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` stored in ranges of (keys, order), with the number of each row's range."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return stored(ranged.withColumn(PART, F.spark_partition_id()), "ranges")


def before_ranges(fixed: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per range and series, the totals of ``sums`` over all earlier ranges of the series."""
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = fixed.groupBy(PART, *keys).agg(*[c.alias(n) for n, c in sums.items()])
    return parts.select(PART, *keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the place of each row within its series as ``name``, from 1."""
    fixed = in_ranges(df, keys, order)
    before = before_ranges(fixed, keys, {"_before": F.count(F.lit(1))})
    inside = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order))
    out = fixed.join(before, [PART, *keys]).withColumn(name, (F.col("_before") + inside).cast("int"))
    return out.drop(PART, "_before")
