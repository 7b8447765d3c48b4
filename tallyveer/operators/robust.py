"""Robust decomposition of a daily series: trend, weekday season and remainder by iterated local regression.

Seasonal-trend smoothing. A round takes the trend off, smooths each weekday's values by local regression, takes a low-pass of the
result away from it so that the season sums to nothing, and smooths the series without that season into the next trend. After some
rounds every date gets a weight by its remainder: a date far beyond the usual remainder counts for little or nothing in the
next rounds, so an outlier moves neither trend nor season and stays visible in the remainder.

Local regression at a date needs its neighbours in order, again and again, which windows and aggregates cannot say; so each series and
metric is one call on arrays. A series has at most a row per date, and series are spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyveer.config import AnalysisConfig
from tallyveer.session import share_package

WEEK = 7
#: Values of a weekday that are smoothed together, and dates for the trend and the low-pass.
SEASON_SPAN = 13
TREND_SPAN = 15
PASS_SPAN = 7
#: Rounds between new weights, and times the weights are renewed.
ROUNDS = 2
RENEWALS = 10
#: A remainder of so many medians (of all remainders) counts for nothing.
FAR = 6.0


def local_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Local regression at the places ``at``: a line through the ``span`` nearest points, near ones counting more.

    ``x`` is ascending. With fewer points than ``span``, all are used, and the reach grows as if the rest lay beyond. Where no neighbour
    has weight, the result is their plain mean.
    """
    many = min(span, len(x))
    middles = (x[: len(x) - many] + x[many:]) / 2.0
    first = np.searchsorted(middles, at, side="left")
    near = first[:, None] + np.arange(many)
    off = x[near] - at[:, None]
    reach = np.abs(off).max(axis=1) * max(1.0, span / len(x))
    reach = np.where(reach > 0, reach, 1.0)
    share = np.clip(np.abs(off) / reach[:, None], 0.0, 1.0)
    w = (1.0 - share**3) ** 3 * weight[near]
    total = w.sum(axis=1)
    plain = total <= 1e-12
    w[plain] = 1.0
    w /= w.sum(axis=1)[:, None]
    values = y[near]
    mean_off, mean = (w * off).sum(axis=1), (w * values).sum(axis=1)
    spread = (w * (off - mean_off[:, None]) ** 2).sum(axis=1)
    slope = (w * (off - mean_off[:, None]) * values).sum(axis=1) / np.where(spread > 1e-9, spread, 1.0)
    return mean - np.where((spread > 1e-9) & ~plain, slope * mean_off, 0.0)


def running_mean(values: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[length:] - sums[:-length]) / length


def decomposed(day: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, season and weight of values on ascending day numbers; days may be missing."""
    day = day - day[0]
    grid = np.arange(-WEEK, day[-1] + WEEK + 1)  # every day, and a week more on both sides
    trend, weight, season = np.zeros(len(day)), np.ones(len(day)), np.zeros(len(day))
    x = day.astype(float)
    for renewal in range(RENEWALS + 1):
        for _ in range(ROUNDS):
            rest = value - trend
            cycle = np.zeros(len(grid))
            for weekday in range(WEEK):
                own, there = day % WEEK == weekday, grid % WEEK == weekday
                if own.any():
                    cycle[there] = local_line(x[own] / WEEK, rest[own], weight[own], grid[there] / WEEK, SEASON_SPAN)
            low = running_mean(running_mean(running_mean(cycle, WEEK), WEEK), 3)
            known = np.arange(len(low), dtype=float)
            low = local_line(known, low, np.ones(len(low)), known, PASS_SPAN)
            season = (cycle[WEEK:-WEEK] - low)[day]
            trend = local_line(x, value - season, weight, x, TREND_SPAN)
        if renewal < RENEWALS:
            size = np.abs(value - trend - season)
            usual = FAR * np.median(size)
            near = np.clip(size / usual, 0.0, 1.0) if usual > 1e-9 * max(1.0, np.abs(value).max()) else np.zeros(len(size))
            weight = (1.0 - near**2) ** 2
    return trend, season, weight


def robust_decompose(series: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """``trend``, ``seasonal``, ``remainder`` and ``weight`` (0: an outlier) of every date, over whole series.

    A value is the sum of its three parts. A series of fewer dates than two weeks has its mean as trend, and no season.
    """
    keys = [*cfg.series_keys, "metric"]
    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema += ", date date, value double, trend double, seasonal double, remainder double, weight double"

    def one_series(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("date", ignore_index=True)
        value = points["value"].to_numpy(float)
        if len(points) < 2 * WEEK:
            trend, season, weight = np.full(len(value), value.mean()), np.zeros(len(value)), np.ones(len(value))
        else:
            day = pd.to_datetime(points["date"]).to_numpy().astype("datetime64[D]").astype(np.int64)
            trend, season, weight = decomposed(day, value)
        return points.assign(trend=trend, seasonal=season, remainder=value - trend - season, weight=weight)

    share_package(series.sparkSession)
    points = series.select(*keys, "date", "value")
    return points.groupBy(*keys).applyInPandas(one_series, schema)
