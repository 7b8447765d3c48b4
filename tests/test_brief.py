import json
from dataclasses import replace

import pytest
from conftest import day, facts, series_facts
from pyspark.sql import functions as F

from tallyveer import AnalysisConfig, analyze
from tallyveer.functions import finite_or_null
from tallyveer.operators import explain as ex
from tallyveer.operators import recommend as rec
from tallyveer.operators import scenario as sc
from tallyveer.plans.brief import to_json_rows
from tallyveer.sources.star import star_fact

CFG = AnalysisConfig()

DOCUMENT_FIELDS = {
    "dates", "revenue", "orders", "aov", "kpis", "forecast_dates", "metric", "anomaly_detected",
    "severity", "change", "change_pct", "anomaly_count", "anomaly_dates", "per_metric",
    "root_cause", "prediction", "forecast_pct_change", "forecast_values",
    "forecast_confidence_lower", "forecast_confidence_upper", "model", "per_metric_forecast",
    "recommendation", "confidence", "explanation", "llm_powered", "timestamp", "pipeline_version",
}


@pytest.fixture(scope="module")
def brief(spark, data):
    return analyze(star_fact(spark, data), CFG)


def test_document(brief):
    row = to_json_rows(brief.document(), CFG).first()
    document = json.loads(row["document"])
    assert set(document) == DOCUMENT_FIELDS
    assert len(document["dates"]) == len(document["revenue"]) == 1084
    assert document["dates"] == sorted(document["dates"])
    assert set(document["per_metric"]) == {"revenue", "orders", "avg_order_value"}
    assert len(document["forecast_values"]) == len(document["forecast_dates"]) == 7
    ranks = [d["rank"] for d in document["root_cause"]]
    assert ranks == list(range(1, len(ranks) + 1))
    assert 0.4 <= document["confidence"] <= 0.95


def test_document_lists_every_driver_unless_told(spark):
    # 75 groups fall and 75 rise by nearly as much, so each passes the cut
    rows = [
        {"date": day(i), "revenue": 100.0 + (i >= 14) * (9 if g % 2 else -9) + (g == 0 and i >= 14), "orders": 1.0, "campaign": f"c{g:03d}"}
        for i in range(28)
        for g in range(150)
    ]
    cfg = CFG.with_(dimensions=("campaign",))
    brief = analyze(facts(spark, rows), cfg)
    n = brief.drivers.count()
    assert n == 150

    def document(**more):
        told = replace(brief, config=cfg.with_(**more))
        return json.loads(to_json_rows(told.document(), cfg).first()["document"])

    whole = document()
    assert [d["rank"] for d in whole["root_cause"]] == list(range(1, n + 1)) and "root_cause_cut" not in whole
    for top, cut in ((3, True), (n, False)):
        part = document(document_drivers=top)
        assert part["root_cause"] == whole["root_cause"][:top]
        assert (part["root_cause_total"], part["root_cause_cut"]) == (n, cut)


def test_recommendations_are_ordered(brief):
    rows = brief.recommendations.orderBy("position").collect()
    order = [rec.PRIORITIES.index(r["priority"]) for r in rows]
    assert order == sorted(order)
    assert len({r["source"] for r in rows}) == len(rows)


def test_too_few_dates_are_refused(spark):
    with pytest.raises(ValueError, match="9 dates"):
        analyze(series_facts(spark, range(1, 10)), CFG)
    with pytest.raises(ValueError, match="no rows"):
        analyze(facts(spark, []), CFG)


def test_calm_series_gets_monitoring_advice(spark):
    rows = analyze(series_facts(spark, [100.0] * 40), CFG).recommendations.collect()
    assert [(r["source"], r["priority"], r["confidence"]) for r in rows] == [("monitor", "LOW", 0.95)]


def test_series_run_covers_every_key(spark, data):
    cfg = CFG.with_(series_keys=("region",))
    b = analyze(star_fact(spark, data), cfg)
    regions = {r["region"] for r in b.explanation.collect()}
    assert len(regions) == 5
    assert {r["region"] for r in b.document().select("region").collect()} == regions


@pytest.mark.parametrize(
    "share, severity, want",
    [(40, "NORMAL", "HIGH"), (39.9, "NORMAL", "MEDIUM"), (19.9, "NORMAL", "LOW"),
     (1, "CRITICAL", "HIGH"), (1, "WARNING", "MEDIUM")],
)
def test_priority(spark, share, severity, want):
    row = spark.range(1).select(rec.priority(F.lit(share), F.lit(severity)).alias("p")).first()
    assert row["p"] == want


def _advice(spark, drivers, severity="NORMAL"):
    d = spark.createDataFrame(
        drivers, "rank int, driver string, dimension string, group_value string, delta double, "
        "contribution_pct double"
    )
    s = spark.createDataFrame([(severity,)], "severity string")
    return {
        r["source"]: r for r in rec.driver_advice(d, s, rec.playbook_table(spark), CFG).collect()
    }


def test_playbook_rules(spark):
    found = _advice(
        spark,
        [
            (1, "", "campaign", "A$1", 10.0, -60.0),
            (2, "", "campaign", "B$2", -10.0, 50.0),
            (3, "", "campaign", "C", -9.0, 45.0),
            (4, "", "inventory_status", "out_of_stock", -5.0, 21.0),
            (5, "", "discount_band", "high", -5.0, 20.0),
            (6, "", "n/a", "n/a", -5.0, 20.0),
        ],
    )
    assert set(found) == {"campaign", "inventory_status"}
    assert "B$2" in found["campaign"]["action"]
    assert (found["campaign"]["impact_low"], found["campaign"]["impact_high"]) == (27, 42)
    assert found["campaign"]["confidence"] == 0.88
    assert found["inventory_status"]["timeline"] == "this week"
    assert found["campaign"]["action"].startswith("B$2 is down by 10, 50% of the change")
    assert found["inventory_status"]["priority"] == "MEDIUM"


def test_metric_rules(spark):
    card = spark.createDataFrame(
        [("orders", True, "+9.0%", 9.0), ("avg_order_value", True, "-5.0%", -5.0)],
        "metric string, anomaly_detected boolean, change string, change_pct double",
    )
    # any anomaly of orders counts, even upward; ticket size must fall by more than 5 %
    assert [r["source"] for r in rec.metric_advice(card, CFG).collect()] == ["orders_volume"]


def test_confidence_weights(spark):
    def score(*values):
        columns = [F.lit(v) for v in values]
        return spark.range(1).select(ex.confidence_score(*columns).alias("c")).first()["c"]

    assert score(False, 0.0, 0, 0, 0.0, False) == 0.50
    assert score(True, -16.0, 2, 2, -1.0, True) == 0.95
    assert score(True, 6.0, 1, 1, -1.0, False) == 0.72
    assert score(False, 15.0, 0, 1, 3.0, False) == 0.65


def test_question_intents(spark):
    texts = ["Why did it fall?", "What is NEXT?", "Anything to fix", "Worst case?", "By region", "hm"]
    df = spark.createDataFrame([(t,) for t in texts], ["text"])
    got = [r[0] for r in df.select(ex.question_intent(F.col("text"))).collect()]
    assert got == ["cause", "forecast", "action", "risk", "segment", "overview"]


def test_answers(spark, brief):
    asked = spark.createDataFrame([("why?",), ("hello",)], ["text"])
    rows = ex.answer_questions(asked, brief.explanation, brief.recommendations).collect()
    assert all(r["answer"] for r in rows)


def test_scenario_with_factor_one_changes_nothing(spark, data):
    fact = star_fact(spark, data)
    same = [sc.Shock(F.col("region") == "ASIA", {"revenue": 1.0, "orders": 1.0})]
    rows = sc.run_scenario(fact, same, ["region"], CFG).collect()
    assert len(rows) == 5 and all(r["difference"] == 0 for r in rows)


def test_scenario_mask_is_fixed_before_relabel(spark):
    fact = facts(spark, [{"date": day(0), "campaign": "A", "revenue": 10.0, "orders": 4.0}])
    shock = sc.Shock(F.col("campaign") == "A", {"revenue": 0.5, "orders": 0.25}, {"campaign": "B"})
    row = sc.apply_scenario(fact, [shock]).first()
    assert (row["campaign"], row["revenue"], row["orders"]) == ("B", 5.0, 1.0)


def test_finite_or_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(finite_or_null(F.col("v"))).collect()] == [None, None, 1.0, None]


@pytest.mark.parametrize(
    "bad", [{"aov": "x"}, {"clip": "x"}, {"model": "x"}, {"lookback": 0}, {"contamination": 0.9},
            {"metrics": ("profit",)}]
)
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        AnalysisConfig(**bad)


def test_command_line(spark, tmp_path):
    from tallyveer.__main__ import main

    source, target = tmp_path / "in.csv", str(tmp_path / "out")
    lines = [f"{day(i)};{100 + i % 5};{1 + i % 3};{'north' if i % 2 else 'south'}" for i in range(60)]
    source.write_text("Date;Sales;Units;City\n" + "\n".join(lines) + "\n")
    main([str(source), target, "--series-keys", "region", "--horizon", "3"])
    document = spark.read.json(f"{target}/documents")
    assert {r["region"] for r in document.collect()} == {"north", "south"}
    assert spark.read.parquet(f"{target}/forecast_rows").count() == 2 * 3 * 3
    assert sorted(p.name for p in (tmp_path / "out" / "processed").glob("month=*"))[0] == "month=2024-01"
    main([str(source), target + "1", "--dimensions", "region", "--min-share-pct", "50", "--change-critical", "-99"])
    assert {r["dimension"] for r in spark.read.parquet(f"{target}1/drivers").collect()} <= {"region", "n/a"}
    main([str(source), target + "2", "--only", "scorecard"])
    assert spark.read.parquet(f"{target}2/scorecard").count() == 3
    main([str(source), target + "3", "--only", "forecast"])
    assert spark.read.parquet(f"{target}3/forecast").count() == 3


def test_discarded_brief_leaves_no_tables(spark, data, tmp_path):
    from pathlib import Path

    from tallyveer.sources.star import star_source

    brief = analyze(star_source(spark, data), AnalysisConfig(), check=False)
    paths = [Path(f.removeprefix("file:")) for f in brief.folders]
    assert len(paths) >= 6 and all(p.exists() for p in paths)
    brief.discard()
    assert not any(p.exists() for p in paths)
