"""Deterministic isolation scores for daily series.

A forest of random one-dimensional splits isolates a point after a number of
cuts whose expectation has a closed form. Inside an interval, a uniform cut
falls into a gap with probability proportional to its length, so the gap
``[lo, hi]`` to the right of ``v`` separates ``v`` first with probability
``(hi - lo) / (hi - v)`` and one to the left with ``(hi - lo) / (v - lo)``.
The expected depth is the sum over all gaps, plus the mean path length of the
ties of ``v``.

A series is represented by ``grid_points`` mid-quantile ranks: the dates whose rank by value is ``floor(n * (i + 1/2) / points)`` for
some ``i``. That is one rule at every length: a series of fewer dates holds all its ranks, a longer one every n-th, like the
fixed-size subsample of a forest. Dates between two such points take the linear interpolation of their depths. Ranks come from
a window sort, so each date knows its place among the points without a search; the state per series is an array of at most
``grid_points`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import half_even, tree_path_length
from tallyveer.operators.series import series_window

SCORE_PLACES = 10


def _at(array: str | Column, index: Column) -> Column:
    return F.get(F.col(array) if isinstance(array, str) else array, index)


def _ranks_below(count: Column, n: Column, points: int) -> Column:
    """How many ranks ``floor(n * (i + 1/2) / points)``, i = 0, 1, ..., are below ``count``."""
    return F.ceil((2.0 * points * count - n) / (2.0 * n)).cast("long")


def ranked(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Add ``point``, whether a date represents the series, and ``place``, the points up to its value."""
    g = cfg.grid_points
    whole = series_window(cfg.series_keys)
    rising = whole.orderBy("value")
    n, rank = F.count(F.lit(1)).over(whole), F.row_number().over(whole.orderBy("value", "date")) - 1
    upto = F.count(F.lit(1)).over(rising.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    out = series.withColumns({"_n": n, "_rank": rank, "_upto": upto})
    first = F.greatest(_ranks_below(F.col("_rank"), F.col("_n"), g), F.lit(0))
    point = (first < g) & (F.floor(F.col("_n") * (2 * first + 1) / F.lit(2 * g)) == F.col("_rank"))
    # the points are different ranks, so there are no more of them than dates
    place = F.least(F.col("_upto"), F.greatest(_ranks_below(F.col("_upto"), F.col("_n"), g), F.lit(0)), F.lit(g))
    return out.withColumns({"point": point, "place": place}).drop("_n", "_rank", "_upto")


def collected(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per series and metric with its dates as an array and the sorted values of its points.

    A series has one value per date, so the array is bounded by the calendar,
    not by the facts; scores come out of it without reading the facts again.
    """
    keys = [*cfg.series_keys, "metric"]
    rest = [c for c in series.columns if c not in keys]
    return (
        ranked(series, cfg)
        .groupBy(*keys)
        .agg(
            F.collect_list(F.struct(*rest, "place")).alias("points"),
            F.sort_array(F.collect_list(F.when(F.col("point"), F.col("value")))).alias("sample"),
        )
    )


def depth_grid(values: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Add support points ``xs``, the points up to each (``upto``), their depths ``ds`` and the sample size ``m``."""
    keys = [*cfg.series_keys, "metric", "points"]
    m = F.size("sample")
    # positions where a run of equal values ends
    ends = F.filter(
        F.sequence(F.lit(0), m - 1),
        lambda i: (i == m - 1) | (_at("sample", i) < _at("sample", F.least(i + 1, m - 1))),
    )
    support = values.select(*keys, "sample", m.alias("m"), ends.alias("ends"))
    support = support.select(
        *keys,
        "m",
        F.transform("ends", lambda i: _at("sample", i)).alias("xs"),
        F.transform("ends", lambda i: i + 1).alias("upto"),
    )

    def gap_sum(i: Column) -> Column:
        here = _at("xs", i)
        gaps = F.slice(F.sequence(F.lit(0), F.size("xs")), F.lit(1), F.size("xs") - 1)

        def add(total: Column, j: Column) -> Column:
            lo, hi = _at("xs", j), _at("xs", j + 1)
            return total + (hi - lo) / F.when(j >= i, hi - here).otherwise(here - lo)

        return F.aggregate(gaps, F.lit(0.0), add)

    def ties(i: Column) -> Column:
        return _at("upto", i) - F.when(i > 0, _at("upto", F.greatest(i - 1, F.lit(0)))).otherwise(0)

    return support.select(
        *keys,
        "m",
        "xs",
        "upto",
        F.transform(
            F.slice(F.sequence(F.lit(0), F.size("xs")), F.lit(1), F.size("xs")),
            lambda i: gap_sum(i) + tree_path_length(ties(i)),
        ).alias("ds"),
    )


def _depth_of(value: Column) -> Column:
    """Depth of ``value``: its support point, else interpolated between neighbours."""
    below = F.col("below")
    x0, x1 = _at("xs", below - 1), _at("xs", below)
    d0, d1 = _at("ds", below - 1), _at("ds", below)
    return (
        F.when(below == 0, _at("ds", F.lit(0)))
        .when(below == F.size("xs"), d0)
        .otherwise(d0 + (d1 - d0) * (value - x0) / (x1 - x0))
    )


def score_dates(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Add ``score``, ``decision`` and ``flagged`` to every date of every series.

    ``decision`` is the score minus its ``contamination`` quantile; negative
    values are anomalies. Constant and single-row series are never flagged.
    """
    columns = series.columns
    scored = (
        depth_grid(collected(series, cfg), cfg)
        .select(*cfg.series_keys, "metric", "m", "xs", "upto", "ds", F.inline("points"))
        # runs of equal points end exactly where a value's place does
        .withColumn("below", F.array_position("upto", F.col("place").cast("int")).cast("int"))
        .withColumn("depth", _depth_of(F.col("value")))
        .withColumn("degenerate", F.size("xs") < 2)
        .withColumn(
            "score",
            F.when(F.col("degenerate"), 0.0).otherwise(
                half_even(
                    -F.pow(F.lit(2.0), -F.col("depth") / tree_path_length(F.col("m"))),
                    SCORE_PLACES,
                )
            ),
        )
    )
    cut = F.percentile("score", F.lit(cfg.contamination)).over(series_window(cfg.series_keys))
    return scored.withColumn(
        "decision",
        F.when(F.col("degenerate"), 0.0).otherwise(
            half_even(F.col("score") - cut, SCORE_PLACES)
        ),
    ).select(
        *columns,
        "score",
        "decision",
        (F.col("decision") < 0).alias("flagged"),
        "degenerate",
    )


def standardise(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Population z-score of each date; isolation depth does not change under it."""
    w = series_window(cfg.series_keys)
    sd = F.stddev_pop("value").over(w)
    return series.withColumn(
        "zscore",
        F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(0.0),
    )
