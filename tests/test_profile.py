import math

from tallyveer.operators import insight as ins


def test_exact_distinct_counts_without_expansion(spark):
    rows = [(i % 5 or None, (0.0, -0.0, math.nan, float("nan"), None)[i % 5], f"k{i % 11}", None) for i in range(200)]
    frame = spark.createDataFrame(rows, "`a.b` int, v double, word string, nothing long").repartition(3)
    exact = ins.profile_columns(frame, exact_distinct=True)
    assert "Expand" not in exact._jdf.queryExecution().optimizedPlan().toString()
    got = {r["column"]: (r["rows"], r["nulls"], r["distinct_values"]) for r in exact.collect()}
    assert got == {"a.b": (200, 40, 4), "v": (200, 40, 2), "word": (200, 0, 11), "nothing": (200, 200, 0)}
    empty = ins.profile_columns(frame.where("false"), exact_distinct=True).collect()
    assert [(r["rows"], r["distinct_values"]) for r in empty] == [(0, 0)] * 4
