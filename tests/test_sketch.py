import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveer.operators import sketch as sk


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    rows = [
        (int(i % 3), float(v), None if i % 10 == 0 else f"k{int(i * 7 % 4001)}", float("nan") if i % 50 == 0 else float(i))
        for i, v in enumerate(rng.normal(100, 15, 30_000))
    ]
    rows += [(0, 1000.0, "far", 1.0), (1, -900.0, "far", 1.0), (2, None, None, None), (2, math.inf, "x", 2.0)]
    return spark.createDataFrame(rows, "g int, v double, word string, n double").repartition(6).cache()


COLUMNS = ["v", "word", "n"]


def test_sketches_of_halves_merge_to_the_whole(spark, numbers, tmp_path):
    path = str(tmp_path / "runs")
    sk.add_run(numbers.where("n % 2 = 0 AND n = n"), path, "even", COLUMNS)
    sk.add_run(numbers.where("NOT coalesce(n % 2 = 0 AND n = n, false)"), path, "rest", COLUMNS)
    sk.add_run(numbers.where("NOT coalesce(n % 2 = 0 AND n = n, false)"), path, "rest", COLUMNS)  # stored again: replaced
    got = {r["column"]: r for r in sk.profile(sk.read_runs(spark, path)).collect()}
    whole = {r["column"]: r for r in sk.profile(sk.sketches(numbers, COLUMNS)).collect()}
    for name in COLUMNS:
        for field in ("rows", "nulls", "smallest", "largest"):
            assert got[name][field] == whole[name][field], (name, field)
        exact = numbers.select(F.count_distinct(F.col(name).cast("string"))).first()[0]
        assert abs(got[name]["distinct_values"] - exact) <= 0.05 * exact
    finite = np.array([r["v"] for r in numbers.where("abs(v) < 1e300").collect()])
    for field, level in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert abs((finite <= got["v"][field]).mean() - level) <= 0.01
    assert got["word"]["q1"] is None and got["word"]["high_fence"] is None


def test_values_beyond_the_fences(numbers):
    fences = sk.exact_fences(numbers, COLUMNS)
    got = {r["column"]: r for r in sk.outliers(numbers, fences, COLUMNS).collect()}
    finite = np.array([r["v"] for r in numbers.where("abs(v) < 1e300").collect()])
    q1, q3 = np.quantile(finite, [0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert got["v"]["low_fence"] == pytest.approx(low) and got["v"]["high_fence"] == pytest.approx(high)
    assert (got["v"]["below"], got["v"]["above"]) == ((finite < low).sum(), (finite > high).sum())
    assert (got["word"]["below"], got["word"]["share"], got["n"]["above"]) == (0, 0.0, 0)
    rows = sk.outlier_rows(numbers, fences, COLUMNS)
    assert rows.count() == got["v"]["below"] + got["v"]["above"] and "_fences" not in rows.columns
    near = {r["column"]: r for r in sk.outliers(numbers, sk.profile(sk.sketches(numbers, COLUMNS)), COLUMNS).collect()}
    assert abs(near["v"]["share"] - got["v"]["share"]) < 0.005


def test_groups_have_fences_of_their_own(numbers):
    shifted = numbers.withColumn("v", F.col("v") + 1000 * F.col("g"))
    found = sk.outliers(shifted, sk.profile(sk.sketches(shifted, ["v"], ["g"])), ["v"], ["g"])
    rows = {r["g"]: r for r in found.collect()}
    assert set(rows) == {0, 1, 2} and rows[0]["above"] >= 1 and rows[1]["below"] >= 1
    assert all(r["share"] < 0.02 for r in rows.values())


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "v double, w string")
    assert [r["rows"] for r in sk.profile(sk.sketches(empty, ["v", "w"])).collect()] == [0, 0]
    nulls = spark.createDataFrame([(None, None)], "v double, w string")
    row = {r["column"]: r for r in sk.profile(sk.sketches(nulls, ["v", "w"])).collect()}["v"]
    assert (row["nulls"], row["distinct_values"], row["q1"], row["low_fence"]) == (1, 0, None, None)
    assert sk.outliers(nulls, sk.exact_fences(nulls, ["v"]), ["v"]).first()["share"] == 0.0


def test_exact_quantiles_match_sorted_values(spark):
    rng = np.random.default_rng(9)
    rows = [(None if i % 7 == 0 else int(i % 3), float(rng.integers(0, 40)), float(rng.normal())) for i in range(3000)]
    rows += [(1, None, math.nan), (9, None, math.inf), (None, -0.0, None)]
    frame = spark.createDataFrame(rows, "g int, v double, w double").repartition(5)
    levels = {"a": 0.0, "q1": 0.25, "median": 0.5, "z": 0.987, "b": 1.0}
    got = {(r["g"], r["column"]): r for r in sk.exact_quantiles(frame, ["v", "w"], levels, ["g"]).collect()}
    assert set(got) == {(g, c) for g in (None, 0, 1, 2, 9) for c in ("v", "w")}
    for (g, name), r in got.items():
        held = [x for x in (row[1 if name == "v" else 2] for row in rows if row[0] == g) if x is not None and math.isfinite(x)]
        for level, p in levels.items():
            assert r[level] == (pytest.approx(float(np.quantile(held, p))) if held else None), (g, name, level)


def test_exact_fences_hold_no_column_in_one_task(spark, numbers, monkeypatch):
    plans = []
    kept = sk.stored
    monkeypatch.setattr(sk, "stored", lambda df, purpose: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, purpose))
    sk.exact_fences(numbers, COLUMNS)
    assert plans and "percentile(" not in plans[0] and "Window" in plans[0]
