import math

import numpy as np
import pytest
from conftest import series_facts
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.operators.detect import scorecard
from tallyveer.operators.isolation import collected, depth_grid, score_dates, standardise
from tallyveer.operators.series import daily_series

CFG = AnalysisConfig(metrics=("revenue",))


def path_length(n):
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def closed_form(values):
    """Depth of each value by the gap sum, one pair at a time."""
    points, counts = np.unique(np.asarray(values, float), return_counts=True)
    depth = {}
    for v, m in zip(points, counts):
        total = path_length(m)
        for lo, hi in zip(points[:-1], points[1:]):
            total += (hi - lo) / (hi - v) if lo >= v else (hi - lo) / (v - lo)
        depth[v] = total
    return np.array([depth[v] for v in values])


def simulated(values, trees, rng):
    """Mean isolation depth over random split trees without a depth cap."""
    values = np.asarray(values, float)
    total = np.zeros(len(values))

    def split(index, depth):
        lo, hi = values[index].min(), values[index].max()
        if len(index) == 1 or lo == hi:
            total[index] += depth + path_length(len(index))
            return
        cut = rng.uniform(lo, hi)
        left = values[index] < cut
        if left.all() or not left.any():
            left = values[index] <= lo
        split(index[left], depth + 1)
        split(index[~left], depth + 1)

    for _ in range(trees):
        split(np.arange(len(values)), 0)
    return total / trees


def scores(spark, values, cfg=CFG):
    series = daily_series(series_facts(spark, values), cfg)
    rows = score_dates(series, cfg).orderBy("date").collect()
    return np.array([r["score"] for r in rows]), [r["flagged"] for r in rows]


def test_closed_form_matches_simulation():
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(100, 15, 40))
    assert np.abs(closed_form(values) - simulated(values, 3000, rng)).max() < 0.1


def test_scores_match_closed_form_with_ties(spark):
    rng = np.random.default_rng(7)
    values = np.round(rng.normal(1000, 30, 60))
    values[17] = values[18] = values[19]
    values[40] = 2000
    want = -(2.0 ** (-closed_form(values) / path_length(60)))
    got, flagged = scores(spark, values)
    assert np.allclose(got, want, atol=1e-9)
    cut = np.quantile(np.round(want, 10), 0.08)
    assert flagged == list(np.round(np.round(want, 10) - cut, 10) < 0)
    assert flagged[40]


def expected(values, points=256):
    """Scores by the documented rule, with plain loops."""
    values = np.asarray(values, float)
    order, n = np.argsort(values, kind="stable"), len(values)
    sample = values[order][sorted({n * (2 * i + 1) // (2 * points) for i in range(points)})]
    support, first = np.unique(sample, return_index=True)
    return -(2.0 ** (-np.interp(values, support, closed_form(sample)[first]) / path_length(len(sample))))


@pytest.mark.parametrize("n", [10, 60, 255, 256, 257, 700, 1000])
def test_one_rule_at_every_length(spark, n):
    rng = np.random.default_rng(11)
    values = np.round(rng.gamma(5, 100, n), 1 if n > 300 else 2)
    values[n // 2] = 9000
    got, flagged = scores(spark, values)
    assert np.allclose(got, expected(values), atol=1e-8)
    assert flagged[n // 2] and abs(sum(flagged) - 0.08 * n) <= 1.5


def test_one_more_date_moves_no_other_flag(spark):
    rng = np.random.default_rng(23)
    values = np.round(rng.normal(1000, 80, 258), 2)
    flags = [scores(spark, values[:n])[1] for n in (255, 256, 257, 258)]
    for a, b in zip(flags, flags[1:]):
        assert sum(x != y for x, y in zip(a, b)) <= 1  # the cut itself moves with the number of dates


def test_score_of_a_forest_is_met(spark):
    """Flags agree with simulated forests about as well as two forests do with each other."""
    rng = np.random.default_rng(5)
    for n in (60, 256, 257):
        values = np.round(rng.normal(100, 15, n) + (rng.random(n) < 0.05) * rng.normal(0, 80, n), 2)
        sums = np.zeros(n)
        for _ in range(60):
            part = rng.choice(n, min(n, 256), replace=False)
            at = simulated(values[part], 1, rng)
            order = np.argsort(values[part])
            sums += np.interp(values, values[part][order], at[order])
        cut = np.quantile(-sums, 0.92)
        _, flagged = scores(spark, values)
        both = sum(f and (-s >= cut) for f, s in zip(flagged, sums))
        assert both / (sum(flagged) + (-sums >= cut).sum() - both) > 0.6


def test_grid_state_is_bounded(spark):
    series = daily_series(series_facts(spark, np.arange(900) * 1.5), CFG)
    row = depth_grid(collected(series, CFG), CFG).first()
    assert row["m"] == 256 and len(row["xs"]) <= 256


@pytest.mark.parametrize("values", [[5.0] * 30, [5.0]])
def test_constant_and_single_are_normal(spark, values):
    cfg = CFG.with_(min_dates=1)
    card = scorecard(daily_series(series_facts(spark, values), cfg), cfg).first()
    assert (card["severity"], card["anomaly_count"], card["if_score_worst"]) == ("NORMAL", 0, 0.0)
    assert card["anomaly_detected"] is False and card["anomaly_dates"] == []


def test_scores_do_not_change_under_scaling(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(50, 9, 50), 2)
    series = daily_series(series_facts(spark, values), CFG)
    z = standardise(series, CFG).withColumn("value", F.col("zscore"))
    plain = [r["score"] for r in score_dates(series, CFG).orderBy("date").collect()]
    scaled = [r["score"] for r in score_dates(z.drop("zscore"), CFG).orderBy("date").collect()]
    assert np.allclose(plain, scaled, atol=1e-8)


def test_flags_grow_with_contamination(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(100, 10, 80), 2)
    counts = [sum(scores(spark, values, CFG.with_(contamination=c))[1]) for c in (0.02, 0.1, 0.3)]
    assert counts == sorted(counts) and counts[0] < counts[-1]
