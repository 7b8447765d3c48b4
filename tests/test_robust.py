import datetime as dt

import numpy as np
import pytest
from conftest import facts, series_facts

from tallyveer.config import AnalysisConfig
from tallyveer.operators import robust
from tallyveer.operators.insight import decompose
from tallyveer.operators.series import daily_series

CFG = AnalysisConfig(metrics=("revenue",))


def plain_line(x, y, weight, place, span):
    """Local regression at one place, from the definition."""
    near = sorted(range(len(x)), key=lambda i: (abs(x[i] - place), i))[:span]
    reach = max(abs(x[i] - place) for i in near) * max(1.0, span / len(x)) or 1.0
    w = [(1 - min(1.0, abs(x[i] - place) / reach) ** 3) ** 3 * weight[i] for i in near]
    if sum(w) <= 1e-12:
        return float(np.mean([y[i] for i in near]))
    a = np.array([[1.0, x[i] - place] for i in near])
    sw = np.sqrt(np.array(w) / sum(w))
    mean = sum(wi * (x[i] - place) for wi, i in zip(w, near)) / sum(w)
    if sum(wi * (x[i] - place - mean) ** 2 for wi, i in zip(w, near)) / sum(w) <= 1e-9:
        return float(sum(wi * y[i] for wi, i in zip(w, near)) / sum(w))
    return float(np.linalg.lstsq(a * sw[:, None], np.array([y[i] for i in near]) * sw, rcond=None)[0][0])


def plain_parts(days, value, renewals, rounds):
    """Seasonal-trend smoothing with loops, a day and a neighbour at a time."""
    n, last = len(days), days[-1]
    trend, season, weight = [0.0] * n, [0.0] * n, [1.0] * n
    for renewal in range(renewals + 1):
        for _ in range(rounds):
            cycle = {}
            for d in range(-7, last + 8):
                own = [i for i in range(n) if days[i] % 7 == d % 7]
                cycle[d] = plain_line(
                    [days[i] / 7 for i in own], [value[i] - trend[i] for i in own], [weight[i] for i in own], d / 7, 13
                ) if own else 0.0
            line = [cycle[d] for d in range(-7, last + 8)]
            for length in (7, 7, 3):
                line = [sum(line[i : i + length]) / length for i in range(len(line) - length + 1)]
            low = [plain_line(list(range(len(line))), line, [1.0] * len(line), i, 7) for i in range(len(line))]
            season = [cycle[d] - low[d] for d in days]
            trend = [plain_line(days, [v - s for v, s in zip(value, season)], weight, d, 15) for d in days]
        size = [abs(v - t - s) for v, t, s in zip(value, trend, season)]
        far = 6 * float(np.median(size))
        if renewal < renewals:
            weight = [(1 - min(1.0, s / far) ** 2) ** 2 for s in size]
    return trend, season, weight


@pytest.mark.parametrize("missing", [(), (3, 4, 17, 40)])
def test_matches_a_plain_implementation(monkeypatch, missing):
    rng = np.random.default_rng(len(missing))
    days = [d for d in range(61) if d not in missing]
    value = [100 + d + 20 * (d % 7 >= 5) + rng.normal(0, 3) + 90 * (d == 30) for d in days]
    monkeypatch.setattr(robust, "RENEWALS", 3)
    got = robust.decomposed(np.array(days), np.array(value))
    for mine, want in zip(got, plain_parts(days, value, 3, 2), strict=True):
        assert np.allclose(mine, want, atol=1e-6)


def test_an_outlier_moves_neither_trend_nor_season(spark):
    rng = np.random.default_rng(1)
    days = np.arange(140)
    calm = 1000 + 3.0 * days + 80 * np.sin(2 * np.pi * days / 7) + rng.normal(0, 5, 140)
    hit = calm.copy()
    hit[[50, 51, 90]] += [900, -600, 1500]
    parts = {}
    for name, values in (("calm", calm), ("hit", hit)):
        series = daily_series(series_facts(spark, np.round(values, 2)), CFG)
        parts[name] = robust.robust_decompose(series, CFG).toPandas().sort_values("date", ignore_index=True)
    for column in ("trend", "seasonal"):
        assert np.abs(parts["calm"][column] - parts["hit"][column]).max() < 8
    hit_rows = parts["hit"].iloc[[50, 51, 90]]
    assert np.allclose(hit_rows["remainder"], [900, -600, 1500], atol=30) and (hit_rows["weight"] == 0).all()
    assert np.allclose(parts["hit"]["value"], parts["hit"][["trend", "seasonal", "remainder"]].sum(axis=1))
    season = parts["hit"].set_index("date")["seasonal"]
    assert abs(season.iloc[20:27].sum()) < 8 and np.corrcoef(season, np.sin(2 * np.pi * days / 7))[0, 1] > 0.99
    # the plain profile is moved by them
    straight = decompose(daily_series(series_facts(spark, np.round(hit, 2)), CFG.with_(trend_rows=140)), CFG.with_(trend_rows=140))
    assert straight.toPandas()["trend"].sub(1000 + 3.0 * days).abs().max() > 8


def test_short_and_many_series(spark):
    rows = [{"date": dt.date(2024, 1, 1) + dt.timedelta(days=i), "revenue": float(i), "orders": 1.0, "region": r}
            for r, n in (("a", 5), ("b", 40), ("c", 1)) for i in range(n)]
    cfg = CFG.with_(series_keys=("region",))
    out = robust.robust_decompose(daily_series(facts(spark, rows), cfg), cfg).toPandas()
    assert out.groupby("region").size().to_dict() == {"a": 5, "b": 40, "c": 1}
    assert (out[out["region"] == "a"]["trend"] == 2.0).all() and (out[out["region"] != "b"]["seasonal"] == 0).all()
    assert np.allclose(out[out["region"] == "b"]["trend"], np.arange(40), atol=1e-6)
    assert np.allclose(out["value"], out[["trend", "seasonal", "remainder"]].sum(axis=1))
