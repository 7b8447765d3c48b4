import datetime as dt
from collections import defaultdict
from itertools import combinations, product

import numpy as np
from conftest import facts

from tallyveer.config import AnalysisConfig
from tallyveer.operators.combination import OTHERS, combination_drivers, lattice

CFG = AnalysisConfig(lookback=7)
DIMS = ("region", "channel", "category")


def table(spark, effect, seed=1, **extra):
    rng = np.random.default_rng(seed)
    rows = []
    for day in range(14):
        for region, channel, category in product(("north", "south", "east"), ("web", "shop"), ("a", "b")):
            value = 1000.0 + float(rng.integers(-20, 20))
            if day >= 7:
                value += effect(region, channel, category)
            rows.append({"date": dt.date(2024, 1, 1) + dt.timedelta(days=day), "revenue": value, "orders": 1.0,
                         "region": region, "channel": channel, "category": category, **extra})
    return facts(spark, rows), rows


def test_a_planted_cause_of_two_dimensions_is_found(spark):
    fact, _ = table(spark, lambda r, c, k: -600.0 if (r, c) == ("south", "web") else 0.0)
    rows = combination_drivers(fact, CFG, DIMS, 3).collect()
    causes = [(r["dimensions"], r["group"]) for r in rows if r["cause"]]
    assert causes == [("region,channel", "south,web")]
    cause = next(r for r in rows if r["cause"])
    assert cause["delta"] < -8000 and cause["part"] > 0.9
    sums = defaultdict(float)
    for r in rows:
        sums[r["dimensions"]] += r["share"]
    assert all(abs(s - 100.0) < 1e-6 for s in sums.values())


def test_a_single_dimension_stays_the_cause(spark):
    fact, _ = table(spark, lambda r, c, k: -300.0 if k == "a" else 0.0)
    causes = {(r["dimensions"], r["group"]) for r in combination_drivers(fact, CFG, DIMS, 3).collect() if r["cause"]}
    assert causes == {("category", "a")}


def test_pruning_leaves_out_nothing_above_the_cut_off(spark):
    # changes that cancel out: parents stand still while their parts move
    fact, raw = table(spark, lambda r, c, k: {"web": -400.0, "shop": 380.0}[c] * (1 if r == "east" else 0.1), seed=3)
    cfg = CFG.with_(min_share_pct=20.0)
    got = {(r["dimensions"], r["group"]): r["delta"] for r in combination_drivers(fact, cfg, DIMS, 3).collect() if r["group"] != OTHERS}
    change = defaultdict(float)
    total = 0.0
    for r in raw:
        sign = 1 if r["date"] >= dt.date(2024, 1, 8) else -1
        total += sign * r["revenue"]
        for depth in (1, 2, 3):
            for dims in combinations(DIMS, depth):
                change[",".join(dims), ",".join(r[d] for d in dims)] += sign * r["revenue"]
    want = {k: v for k, v in change.items() if abs(v) >= 0.2 * abs(total)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_groups_are_not_built_below_a_parent_that_stands_still(spark):
    fact, _ = table(spark, lambda r, c, k: -900.0 if r == "east" else 0.0, seed=5)
    found = {(r["dimensions"], tuple(r["group"])) for r in lattice(fact, CFG.with_(min_share_pct=30.0), DIMS, 2).collect()}
    assert not any(g[d.split(",").index("region")] != "east" for d, g in found if "region" in d)


def test_series_and_no_change(spark):
    one, _ = table(spark, lambda r, c, k: -600.0 if (r, c) == ("south", "web") else 0.0, campaign="x")
    two, _ = table(spark, lambda r, c, k: -500.0 if (k, c) == ("b", "shop") else 0.0, campaign="y")
    cfg = CFG.with_(series_keys=("campaign",))
    rows = combination_drivers(one.unionByName(two), cfg, DIMS, 2).collect()
    causes = {(r["campaign"], r["dimensions"], r["group"]) for r in rows if r["cause"]}
    assert causes == {("x", "region,channel", "south,web"), ("y", "channel,category", "shop,b")}
    flat = facts(spark, [{"date": dt.date(2024, 1, d), "revenue": 5.0, "orders": 1.0, "region": "r"} for d in range(1, 15)])
    assert combination_drivers(flat, CFG, DIMS, 3).count() == 0
