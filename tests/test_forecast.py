import datetime as dt

import numpy as np
import pytest
from conftest import series_facts

from tallyveer.config import AnalysisConfig
from tallyveer.operators.changepoint import trend_breaks
from tallyveer.operators.forecast import custom_forecast, forecast_rows, forecast_summary, trend_model
from tallyveer.operators.series import daily_series

CFG = AnalysisConfig(metrics=("revenue",))


def rows(spark, values, cfg=CFG):
    series = daily_series(series_facts(spark, values), cfg)
    return forecast_rows(series, cfg).orderBy("step").collect()


@pytest.mark.parametrize("n", [2, 13, 60, 200])
def test_matches_weighted_polyfit(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(1000, 50, n) + np.arange(n), 2)
    y = values[-60:]
    x = np.arange(len(y))
    slope, intercept = np.polyfit(x, y, 1, w=np.linspace(0.5, 1.0, len(y)))
    ahead = intercept + slope * np.arange(len(y), len(y) + 7)
    margin = np.std(y - (intercept + slope * x)) * 1.5 + np.abs(ahead) * 0.05
    got = rows(spark, values)
    assert [r["step"] for r in got] == list(range(1, 8))
    assert np.allclose([r["yhat"] for r in got], ahead, atol=0.011)
    assert np.allclose([r["lower"] for r in got], np.maximum(0, ahead - margin), atol=0.011)
    assert np.allclose([r["upper"] for r in got], ahead + margin, atol=0.011)
    assert all(r["lower"] <= r["yhat"] <= r["upper"] for r in got)


def test_single_point_is_flat(spark):
    got = rows(spark, [42.0])
    assert {(r["yhat"], r["lower"], r["upper"], r["model"]) for r in got} == {
        (42.0, 42.0, 42.0, "flat_fallback")
    }


def test_negative_trend_clipping(spark):
    values = [100.0 - 10 * i for i in range(10)]
    clipped = rows(spark, values)
    assert all(0 <= r["lower"] <= r["yhat"] <= r["upper"] for r in clipped)
    literal = rows(spark, values, CFG.with_(clip="lower"))
    assert literal[-1]["yhat"] == pytest.approx(-60.0) and literal[-1]["lower"] == 0.0


def test_dates_continue_after_last(spark):
    got = rows(spark, [1.0, 2.0, 3.0])
    assert [str(r["date"]) for r in got[:2]] == ["2024-01-04", "2024-01-05"]


@pytest.mark.parametrize(
    "values, verdict",
    [
        ([100.0] * 30, "stable"),
        ([100.0 + i for i in range(30)], "increase"),
        ([200.0 - i for i in range(30)], "decline"),
    ],
)
def test_verdict(spark, values, verdict):
    series = daily_series(series_facts(spark, values), CFG)
    row = forecast_summary(forecast_rows(series, CFG), CFG).first()
    assert row["verdict"] == verdict and len(row["forecast_values"]) == 7


def test_recent_mean_needs_a_full_window(spark):
    short = trend_model(daily_series(series_facts(spark, [1.0, 2.0, 9.0]), CFG), CFG).first()
    assert short["recent_avg"] == 9.0
    full = trend_model(
        daily_series(series_facts(spark, [float(i) for i in range(20)]), CFG), CFG
    ).first()
    assert full["recent_avg"] == pytest.approx(np.mean(range(6, 20)))


def test_weekday_profile_repeats(spark):
    cfg = CFG.with_(model="trend_weekday")
    pattern = [100.0, 110.0, 120.0, 130.0, 140.0, 200.0, 210.0]
    got = rows(spark, pattern * 10, cfg)
    best = max(got, key=lambda r: r["yhat"])
    assert best["date"].weekday() in (5, 6)


def test_custom_model_per_series(spark):
    import pandas as pd

    def last_value(points, horizon):
        level = points["value"].iloc[-1]
        return pd.DataFrame(
            {"step": range(1, horizon + 1), "yhat": level, "lower": level - 1, "upper": level + 1}
        )

    cfg = CFG.with_(horizon=3)
    series = daily_series(series_facts(spark, [1.0, 5.0, 3.0]), cfg)
    ahead = custom_forecast(series, cfg, last_value)
    got = [(r["step"], str(r["date"]), r["yhat"]) for r in ahead.orderBy("step").collect()]
    assert got == [(1, "2024-01-04", 3.0), (2, "2024-01-05", 3.0), (3, "2024-01-06", 3.0)]
    assert forecast_summary(ahead, cfg).first()["verdict"] == "stable"


def plain_piecewise(values, cfg, horizon=7):
    """Ridge regression on hinges and weekly waves by NumPy; the dates are consecutive from a Monday."""
    y = np.asarray(values[-cfg.trend_rows :], dtype=float)
    first = len(values) - len(y)

    def design(days):
        u = days / (len(y) - 1)
        places = [0.8 * j / cfg.change_points for j in range(1, cfg.change_points + 1)]
        angle = 2 * np.pi * ((first + days) % 7) / 7
        waves = [f(k * angle) for k in (1, 2, 3) for f in (np.cos, np.sin)]
        return np.column_stack([np.ones_like(u), u, *[np.maximum(0, u - c) for c in places], *waves])

    x, scale = design(np.arange(len(y))), np.abs(y).max()
    ridge = np.diag([1e-9, 1e-9, *[cfg.change_penalty] * cfg.change_points, *[cfg.wave_penalty] * 6])
    beta = np.linalg.solve(x.T @ x + ridge, x.T @ (y / scale))
    rest = y - x @ beta * scale
    centre = design(np.arange(len(y), len(y) + horizon)) @ beta * scale
    return centre, centre + np.quantile(rest, 0.1), centre + np.quantile(rest, 0.9), beta * scale / (len(y) - 1)


@pytest.mark.parametrize("n", [5, 40, 60, 150])
@pytest.mark.parametrize("count", [8, 3])
def test_piecewise_matches_ridge_regression(spark, n, count):
    rng = np.random.default_rng(n)
    values = np.round(1000 + 100 * np.sin(2 * np.pi * np.arange(n) / 7) + rng.normal(0, 20, n) + np.maximum(0, np.arange(n) - n / 2) * 9, 2)
    cfg = CFG.with_(model="piecewise_weekly", change_points=count)
    got = rows(spark, values, cfg)
    for name, want in zip(("yhat", "lower", "upper"), plain_piecewise(values, cfg)[:3], strict=True):
        assert np.allclose([r[name] for r in got], np.maximum(0, want), atol=0.02), name
    assert {r["model"] for r in got} == {"piecewise_weekly"}


def test_a_planted_break_is_found(spark):
    days = np.arange(100)
    season = 30 * ((days % 7) >= 5)
    values = 500 + 2.0 * days - 7.0 * np.maximum(0, days - 50) + season  # from 2 up to 5 down a day
    cfg = CFG.with_(model="piecewise_weekly", trend_rows=100, change_points=8, change_penalty=0.001)
    series = daily_series(series_facts(spark, values), cfg)
    breaks = {r["rank"]: r for r in trend_breaks(series, cfg).collect()}
    assert abs((breaks[1]["date"] - dt.date(2024, 1, 1)).days - 50) <= 6 and breaks[1]["change"] < -4
    last = max(breaks.values(), key=lambda r: r["knot"])
    assert last["slope_after"] == pytest.approx(-5, abs=0.5)
    ahead = 500 + 2.0 * np.arange(100, 107) - 7.0 * (np.arange(100, 107) - 50) + 30 * ((np.arange(100, 107) % 7) >= 5)
    error = [abs(r["yhat"] - w) for r, w in zip(rows(spark, values, cfg), ahead, strict=True)]
    straight = [abs(r["yhat"] - w) for r, w in zip(rows(spark, values, cfg.with_(model="trend_weekday")), ahead, strict=True)]
    assert max(error) < 8 and np.mean(error) < np.mean(straight) / 5


def test_piecewise_single_point_and_constant(spark):
    cfg = CFG.with_(model="piecewise_weekly")
    assert {(r["yhat"], r["lower"], r["model"]) for r in rows(spark, [42.0], cfg)} == {(42.0, 42.0, "flat_fallback")}
    assert {r["yhat"] for r in rows(spark, [0.0] * 20, cfg)} == {0.0}
    assert {round(r["yhat"], 1) for r in rows(spark, [7.0] * 20, cfg)} == {7.0}
