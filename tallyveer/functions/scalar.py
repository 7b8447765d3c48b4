"""Scalar column functions. All are built-in expressions, none is a UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def half_even(value: Column, places: int) -> Column:
    """Round half to even the way array libraries do: scale, ``rint``, unscale."""
    if places == 0:
        return F.rint(value)
    scale = float(10**places)
    return F.rint(value * scale) / scale


def pct_change(new: Column, old: Column) -> Column:
    """Percentage change, 0 when the base is 0."""
    return F.when(old != 0, (new - old) / old * 100.0).otherwise(0.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(
        F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None).cast("double")
    ).otherwise(value)


def signed_pct(value: Column) -> Column:
    """``+3.1%`` with half-even rounding before formatting."""
    return F.format_string("%+.1f%%", half_even(value, 1))


def tree_path_length(n: Column) -> Column:
    """Mean path length of an unsuccessful search in a random binary tree of ``n`` points."""
    m = n.cast("double")
    return (
        F.when(m <= 1, 0.0)
        .when(m == 2, 1.0)
        .otherwise(2.0 * (F.log(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m)
    )


def attach(df: DataFrame, per_series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the one row per series of ``per_series`` to every row of ``df``.

    Without keys there is exactly one such row and it is read as a scalar
    subquery; with keys it is an equi-join whose strategy Catalyst picks.
    """
    if keys:
        return df.join(per_series, list(keys), "inner")
    row = per_series.select(F.struct(*per_series.columns).alias("row")).scalar()
    return df.withColumn("_attached", row).select(
        *df.columns, *[F.col(f"_attached.{c}").alias(c) for c in per_series.columns]
    )
