"""Registered queries: contracts, comparison SQL, the pipeline."""

from __future__ import annotations

import duckdb
import pytest
from compare import connect, difference

import corpus_pipeline
from tallyveer.llm import quality, secret_scan, simhash, toxicity
from tallyveer.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2_": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3_": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_": "doc_id fingerprint component_id",
    "op5_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_": "vec_id n_links component_id kept",
    "op7_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8_": "doc_id n_tokens bucket",
    "op9_": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10_": "doc_id held_out score predicted",
    "op11_": "doc_id size text_crc32 law shard slot grown_shard",
    "op13_": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_each_query_returns_a_row_per_input_row(spark, data, start):
    name = next(n for n in QUERIES if n.startswith(start))
    out = QUERIES[name](spark, data)
    assert out.columns[: len(COLUMNS[start].split())] == COLUMNS[start].split()
    table = "embeddings" if start == "op6_" else "documents"
    assert out.count() == spark.read.parquet(f"{data}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, name):
    assert difference(spark, connect(data), QUERIES[name], ORACLES[name], data) is None


def test_quality_sql_handles_edges(spark, edges):
    con = duckdb.connect()
    con.register("documents", edges.select("doc_id", "text").toArrow())
    want = sorted(map(str, con.execute(ORACLES["op5_quality_rules"]).fetchall()))
    got = quality.judge(edges).drop("n_lines", "n_stop_words").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_stages_chain_as_their_operators_decide(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "simhash near-dedup", "secret scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).cache()
        before, after = ({r.doc_id for r in d.collect()} for d in (docs, out))
        if name == "toxicity":
            scorer = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(docs, scorer).collect() if not r.predicted}
        elif name == "quality rules":
            want = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
        elif name == "simhash near-dedup":
            want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
        else:
            want = before
        assert after == want, name
        if name == "secret scan":
            assert not any(secret_scan.base_spans(r.text) for r in out.collect())
        if name != "packing":
            assert out.columns == columns
        kept[name], docs = len(after), out
    result = corpus_pipeline.run(spark, data)
    assert result.count() == kept["packing"] > 0


def test_pipeline_on_edges(spark, edges, nothing, tmp_path):
    for i, docs in enumerate((edges, nothing)):
        folder = str(tmp_path / str(i))
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert len(rows) == len({r.doc_id for r in rows}) <= docs.count()
