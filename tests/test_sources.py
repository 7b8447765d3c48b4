import datetime as dt
import uuid
from collections import Counter

import pytest

from tallyveer.operators import repair as rp
from tallyveer.sources import catalog as cat
from tallyveer.sources import raw as rw
from tallyveer.sources.delimited import inspect, inspect_files, read_delimited, text_lines, unique_names


def written(tmp_path, text: str, encoding="utf-8", name="data.csv") -> str:
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
@pytest.mark.parametrize(
    "encoding, found",
    [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("latin-1", "ISO-8859-1"), ("utf-16", "UTF-16LE")],
)
def test_separator_and_encoding(spark, tmp_path, separator, encoding, found):
    lines = ["Date", "Région", "Sales"], ["2024-01-05", "Île", "1.5"], ["2024-01-06", "Süd", "2"]
    path = written(tmp_path, "\n".join(separator.join(x) for x in lines) + "\n", encoding)
    what = inspect(spark, path)
    assert (what.encoding, what.separator) == (found, separator)
    rows = read_delimited(spark, path).orderBy("Date").collect()
    assert [tuple(r) for r in rows] == [(*lines[1], None), (*lines[2], None)]


def test_encoding_looks_at_every_line(spark, tmp_path):
    body = "a,b\n" + "x,1\n" * 500
    path = tmp_path / "late.csv"
    path.write_bytes(body.encode() + "é,2\n".encode("latin-1"))
    assert inspect(spark, str(path)).encoding == "ISO-8859-1"


def test_separator_with_quotes(spark, tmp_path):
    found = inspect(spark, written(tmp_path, 'a;b;c\n1;"x;y";2,5\n2;"p";3,5\n'))
    assert found.separator == ";" and found.agreement == 1.0


def test_separator_is_checked_on_every_line(spark, tmp_path):
    # the first hundred lines would pass for commas
    text = "a,1;b\n" + "1,2;3\n" * 100 + "x;y\n" * 400
    assert inspect(spark, written(tmp_path, text)).separator == ";"
    with pytest.raises(ValueError, match="lines have the header's"):
        read_delimited(spark, written(tmp_path, "a,b\n" + "no separator\n" * 9, name="prose.csv"))


def test_folder_of_mixed_files(spark, tmp_path):
    folder = tmp_path / "many files.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("date,revenue,orders\n2024-01-01,10,1\n".encode())
    (folder / "b.csv").write_bytes("orders;revenue;region;date\n1;10;Süd;2024-01-02\n".encode("latin-1"))
    (folder / "c.csv").write_bytes("date,revenue,orders\n2024-01-03,10,1\n".encode())
    (folder / "d e.csv").write_bytes("date\trevenue\n2024-01-04\t7\n".encode("utf-16"))
    assert [f.encoding for f in inspect_files(spark, str(folder))] == ["UTF-8", "ISO-8859-1", "UTF-8", "UTF-16LE"]
    rows = {r["date"]: (r["revenue"], r["orders"], r["region"]) for r in read_delimited(spark, str(folder)).collect()}
    assert rows == {
        "2024-01-01": ("10", "1", None), "2024-01-02": ("10", "1", "Süd"), "2024-01-03": ("10", "1", None),
        "2024-01-04": ("7", None, None),
    }


def test_malformed_rows_are_kept_and_counted(spark, tmp_path):
    path = written(tmp_path, "date,revenue,orders\n2024-01-01,1,1\n2024-01-02,2\n2024-01-03,3,1,9\n2024-01-04,4,1\n")
    raw = rp.map_columns(read_delimited(spark, path))
    assert rp.quality_report(raw).first()["malformed_rows"] == 2
    assert sum(r["_malformed"] is not None for r in raw.collect()) == 2
    fact = rw.load_fact(spark, path).orderBy("date").collect()
    assert [r["revenue"] for r in fact] == [1.0, 2.0, 3.0, 4.0] and "_malformed" not in fact[0]


@pytest.mark.parametrize("header", ["State,Region", "Region,State", "Sales,Revenue", "REGION,region", "x.y,a`b"])
def test_names_that_collide_or_need_quotes(spark, tmp_path, header):
    path = written(tmp_path, f"{header},Day,note\n1,2,2024-01-01,5\n3,4,2024-01-02,6\n")
    raw = rw.load_raw(spark, path)
    assert len({c.lower() for c in raw.columns}) == len(raw.columns)
    assert rw.load_fact(spark, path).count() == 2
    assert rp.unfilled_columns(raw).count() > 0
    assert rp.date_candidates(read_delimited(spark, path)).count() == 4


def test_numbers_as_written(spark):
    cells = ["12", " 1.5 ", "-2e2", ".5", "5.", "12d", "12f", "1e20", "inf", "NaN", "0x1F", "1,5", "", None]
    df = spark.createDataFrame([("2024-01-01", c) for c in cells], ["date", "revenue"])
    got = [r[0] for r in df.select(rp.number_in(df, "revenue")).collect()]
    assert got == [12.0, 1.5, -200.0, 0.5, 5.0] + [None] * 9
    row = rp.quality_report(df).first()
    assert row["coerced_revenue"] == 8 and row["null_revenue"] == 1


def test_date_column_behind_junk(spark):
    values = ["junk"] * 6 + [f"2024-01-{d:02d}" for d in range(1, 29)]
    df = spark.createDataFrame([(v, "1700000000") for v in values], ["when", "stamp"]).coalesce(1)
    assert rp.find_date_column(df).columns == ["date", "stamp"]


def test_undated_file_needs_an_anchor(spark, tmp_path):
    path = written(tmp_path, "region,revenue,orders\n" + "".join(f"r{i:03d},{i},1\n" for i in range(50)))
    with pytest.raises(ValueError, match="anchor"):
        rw.load_fact(spark, path)
    fact = rw.load_fact(spark, path, dt.date(2024, 3, 1), ["region"]).collect()
    assert {r["region"]: r["date"] for r in fact} == {
        f"r{i:03d}": dt.date(2024, 3, 1) - dt.timedelta(days=49 - i) for i in range(50)
    }


def test_stored_fact_reads_the_text_twice(spark, tmp_path):
    path = written(tmp_path, "date,sales,orders\n" + "".join(f"2024-01-{d:02d},{d},1\n" for d in range(1, 29)))
    stored = rw.load_processed(spark, path, str(tmp_path / "processed"))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "csv" not in plan.lower()
    assert stored.count() == 28 and stored.agg({"revenue": "sum"}).first()[0] == sum(range(1, 29))


def test_capped_results_say_so(spark):
    df = spark.range(10_001).withColumnRenamed("id", "k")
    assert cat.query(spark, "SELECT * FROM range(10001)").count() == 10_001
    top = cat.first_rows(df, 10_000, ["k"]).collect()
    assert len(top) == 10_000 and all(r["cut"] for r in top) and top[-1]["k"] == 9_999
    assert not any(r["cut"] for r in cat.first_rows(df, 10_001, ["k"]).collect())
    with pytest.raises(ValueError, match="order"):
        cat.first_rows(df, 5, [])


def test_duplicate_headers(spark, tmp_path):
    assert unique_names(["rev", "rev", "x", "rev"]) == ["rev", "rev_1", "x", "rev_2"]
    df = read_delimited(spark, written(tmp_path, "rev,rev,x\n1,2,3\n"))
    assert df.columns == ["rev", "rev_1", "x", "_malformed"] and tuple(df.first()) == ("1", "2", "3", None)


def test_quoted_separator_in_value(spark, tmp_path):
    df = read_delimited(spark, written(tmp_path, 'date,item\n2024-01-01,"a,b"\n'))
    assert df.first()["item"] == "a,b"


def test_first_alias_wins(spark):
    df = spark.createDataFrame([("1", "2", "3")], ["Total Sales", "Amount", "Units"])
    assert rp.map_columns(df).columns == ["revenue", "Amount", "orders"]
    assert rp.unmapped_aliases(df.columns) == ["Amount"]
    kept = spark.createDataFrame([("1", "2")], ["sales", "revenue"])
    assert rp.map_columns(kept).columns == ["sales", "revenue"]


def test_mixed_date_formats(spark):
    texts = [
        "2024-03-05", "2024-03-05 10:11:12", "03/05/2024", "2024/03/05", "05.03.2024",
        "Mar 5 2024", "5 Mar 2024", " 2024-03-05 ", "3/5/2024", "2024-3-5", "2024-03-05T10:00:00Z",
        "2024-03-05 10:00:00.123", "2024-03-05T10:00:00+00:00", "03/05/2024 10:00", "05-Mar-2024", "03/05/24", "20240305",
        "March 5, 2024", "5.3.2024", "2024-03-05 10:00 PM", "03-05-2024", "5.3.24",
    ]
    df = spark.createDataFrame([(t,) for t in texts], ["d"])
    parsed = {r[0] for r in df.select(rp.parse_date(df["d"])).collect()}
    assert parsed == {dt.date(2024, 3, 5)}


def test_numbers_and_junk_are_not_dates(spark):
    df = spark.createDataFrame([("20",), ("1700000000",), ("soon",), ("2024-13-01",), ("2024-02-30",), ("31/31/2024",), ("12:30",), ("5 Foo 2024",), ("20241301",), ("",), (None,)], ["d"])
    assert {r[0] for r in df.select(rp.parse_date(df["d"])).collect()} == {None}


def test_repair_fills_and_drops(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "x", None, "0"), ("bad", "5", "b", "1"), ("2024-01-02", "7", "b", "NaN")],
        ["date", "revenue", "region", "orders"],
    )
    rows = rp.repair(df).orderBy("date").collect()
    assert [(r["revenue"], r["region"], r["orders"], r["channel"]) for r in rows] == [
        (0.0, "Unknown", 0.0, "Unknown"), (7.0, "b", 0.0, "Unknown")
    ]


def test_true_zeros_are_not_coerced(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "0"), ("2024-01-01", "abc"), ("2024-01-01", None)], ["date", "revenue"]
    )
    row = rp.quality_report(df).first()
    assert (row["coerced_revenue"], row["null_revenue"], row["input_rows"]) == (1, 1, 3)


def test_observed_counters(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([("2024-01-01", "1"), ("nope", "2")], ["date", "revenue"])
    seen = Observation("quality")
    rp.observe_quality(df, seen).collect()
    assert (seen.get["input_rows"], seen.get["dropped_rows"]) == (2, 1)


def test_date_column_by_content(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], ["name", "stamp"])
    assert rp.find_date_column(df).columns == ["name", "date"]


def test_sequential_dates(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    dated = rp.assign_sequential_dates(df, ["k"], dt.date(2024, 12, 31)).collect()
    assert {r["k"]: r["date"] for r in dated} == {
        k: dt.date(2024, 12, 31) - dt.timedelta(days=999 - k) for k in range(1000)
    }


def test_promoted_measures(spark):
    df = spark.createDataFrame([(1.0, 50.0, "x"), (3.0, 70.0, "y")], ["small", "big", "name"])
    assert rp.ensure_measures(df).columns == ["orders", "revenue", "name"]
    none = rp.ensure_measures(spark.createDataFrame([("x",)], ["name"])).first()
    assert (none["revenue"], none["orders"]) == (1.0, 1.0)


def test_missing_columns(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0)], ["date", "revenue"])
    names = [r[0] for r in rp.missing_columns(df).collect()]
    assert names == sorted(names) and "orders" in names and "date" not in names
    assert set(rp.add_missing_columns(df).columns) >= set(names)


def test_load_fact_end_to_end(spark, tmp_path):
    text = "Sale-Date;Total Sales;Units;City;Password\n2024-01-01;10,5;1;Rome;x\n2024-01-02;7;2;;y\n"
    fact = rw.load_fact(spark, written(tmp_path, text))
    assert "Password" not in fact.columns
    rows = fact.orderBy("date").collect()
    assert [(r["region"], r["revenue"]) for r in rows] == [("Rome", 0.0), ("Unknown", 7.0)]


def test_load_promotes_text_numbers(spark, tmp_path):
    fact = rw.load_fact(spark, written(tmp_path, "when,score,size\n2024-01-01,900,3\n2024-01-02,800,4\n"))
    row = fact.orderBy("date").first()
    assert (row["revenue"], row["orders"]) == (900.0, 3.0)


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="workbooks"):
        rw.read_any(spark, "book.xlsx")
    with pytest.raises(ValueError, match="unsupported"):
        rw.read_any(spark, "file.bin")
    with pytest.raises(ValueError, match="no data rows"):
        rw.load_raw(spark, written(tmp_path, "date,revenue\n"))
    with pytest.raises(ValueError, match="date"):
        rw.load_fact(spark, written(tmp_path, "date,revenue,orders\nx,1,1\n", name="b.csv"))
    path = str(tmp_path / "narrow")
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError, match="lacks"):
        rw.load_snapshot(spark, path)


def test_snapshot_overwrites_only_its_date(spark, tmp_path):
    path = str(tmp_path / "snap")
    df = spark.createDataFrame([("in", 1.0)], ["inventory_status", "impressions"])
    rw.write_snapshot(df, path, dt.date(2024, 1, 1))
    rw.write_snapshot(df, path, dt.date(2024, 1, 2))
    rw.write_snapshot(df, path, dt.date(2024, 1, 2))
    assert rw.load_snapshot(spark, path).count() == 2


def test_processed_prunes_months(spark, tmp_path, data):
    from tallyveer.operators.rollup import roll_up
    from tallyveer.sources.star import star_fact

    path = str(tmp_path / "processed")
    rw.write_processed(roll_up(star_fact(spark, data)), path)
    df = rw.read_processed(spark, path, ["2001-07"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "month" in plan.split("PartitionFilters")[1][:80]
    assert {str(r[0])[:7] for r in df.select("date").distinct().collect()} == {"2001-07"}


def test_retention_and_purge(spark, tmp_path):
    name = f"keep_{uuid.uuid4().hex[:8]}"
    df = spark.createDataFrame(
        [(i, f"2024-01-{i:02d}", "r1" if i % 2 else "r2") for i in range(1, 11)],
        ["id", "ingest_date", "run_id"],
    )
    df.write.partitionBy("ingest_date").option("path", str(tmp_path / name)).saveAsTable(name)
    dropped = cat.drop_expired(spark, name, 7, dt.date(2024, 1, 10))
    assert dropped == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert cat.retained(df, 7, dt.date(2024, 1, 10)).count() == 7
    runs = f"runs_{uuid.uuid4().hex[:8]}"
    df.write.partitionBy("run_id").saveAsTable(runs)
    cat.purge_run(spark, runs, "r1")
    assert {r[0] for r in spark.table(runs).select("run_id").collect()} == {"r2"}
    assert cat.without_run(df, "r1").count() == 5
    spark.sql(f"DROP TABLE {runs}")


def test_a_column_of_dates_is_read_in_one_order(spark, tmp_path):
    text = "date,revenue,orders\n" + "".join(f"{d},1,1\n" for d in ("13/02/2024", "05/02/2024", "28/02/2024", "01/03/2024"))
    (tmp_path / "days.csv").write_text(text)
    days = [r["date"].isoformat() for r in rw.load_fact(spark, str(tmp_path / "days.csv")).orderBy("date").collect()]
    assert days == ["2024-02-05", "2024-02-13", "2024-02-28", "2024-03-01"]
    (tmp_path / "open.csv").write_text("date,revenue,orders\n05/02/2024,1,1\n1-3-24,2,2\n")
    for order, want in ((None, ["2024-01-03", "2024-05-02"]), (rp.DAY_FIRST, ["2024-02-05", "2024-03-01"])):
        fact = rw.load_fact(spark, str(tmp_path / "open.csv"), date_order=order)
        assert sorted(r["date"].isoformat() for r in fact.collect()) == want


def test_contradicting_dates_are_counted(spark):
    df = spark.createDataFrame([(d,) for d in ("13/02/2024", "14/02/2024", "02/15/2024", "03/04/2024", "1.2.2024", "x")], ["date"])
    row = rp.quality_report(df).first()
    assert (row["day_first_dates"], row["month_first_dates"], row["contradicted_dates"]) == (2, 1, 1)
    days = {r["date"]: str(r["_day"]) for r in rp.with_parsed_day(df).collect()}
    assert days["03/04/2024"] == "2024-04-03" and days["02/15/2024"] == "2024-02-15" and days["1.2.2024"] == "2024-02-01"


def test_own_aliases_and_holidays(spark, tmp_path):
    (tmp_path / "own.csv").write_text("Tag;Umsatz;Menge;Sales\n2024-05-01;5;1;9\n2024-05-02;7;2;9\n")
    own = {"date": ["tag"], "revenue": ["Umsatz"], "orders": ["menge"]}
    fact = rw.load_fact(spark, str(tmp_path / "own.csv"), aliases=own, holidays=[(5, 1)])
    rows = sorted((str(r["date"]), r["revenue"], r["orders"], r["holiday_flag"]) for r in fact.collect())
    assert rows == [("2024-05-01", 5.0, 1.0, 1.0), ("2024-05-02", 7.0, 2.0, 0.0)]
    with pytest.raises(ValueError, match="no column"):
        rp.canonical_names(["a"], {"income_tax": ["a"]})


BREAKS = [
    ("1", 'said "no"', "plain"), ("2", "two\nlines", "x,y"), ("3", "\n\nblank before", ""), ("4", 'a "q"\n,"b"\n', "7"),
    ("5", "long\n" * 300, "end"), ("6", "", "\n"),
]


@pytest.mark.parametrize(("encoding", "end"), [("utf-8", "\n"), ("utf-8", "\r\n"), ("latin-1", "\n"), ("utf-16-le", "\n")])
def test_line_breaks_in_quotes_in_many_splits(spark, tmp_path, encoding, end):
    rows = [(str(i), *BREAKS[i % 6][1:]) for i in range(900)] + [("900", "süß", "é")]
    body = end.join(",".join('"' + v.replace('"', '""') + '"' for v in r) for r in [("id", "note\nof it", "more"), *rows]) + end
    path = tmp_path / "breaks.csv"
    path.write_bytes(body.encode(encoding))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (what,) = inspect_files(spark, str(path))
        assert what.breaks and what.agreement == 1.0 and what.header == ("id", "note\nof it", "more")
        got = read_delimited(spark, str(path))
        assert text_lines(spark, str(path)).rdd.getNumPartitions() > 20
        found = sorted((tuple(r) for r in got.collect()), key=lambda r: int(r[0]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == [tuple(v or None for v in r) + (None,) for r in rows]
    if encoding != "utf-16-le":  # Spark's own reading of a whole file in one task
        own = spark.read.csv(str(path), header=True, multiLine=True, escape='"', encoding=what.encoding)
        assert sorted(map(tuple, own.collect()), key=lambda r: int(r[0])) == [r[:3] for r in found]


def test_a_stray_quote_does_not_join_lines(spark, tmp_path):
    text = "item,size\n" + "".join(f"pipe {i},{i}\" long\n" for i in range(9)) + "rest,1\n"
    path = written(tmp_path, text)
    assert not inspect(spark, path).breaks and read_delimited(spark, path).count() == 10
    assert read_delimited(spark, written(tmp_path, 'a,b\n1,"x\n2,y"\n', name="n.csv")).collect()[0]["b"] == "x\n2,y"
    assert read_delimited(spark, written(tmp_path, 'a,b\n1,"x\n2,y"\n', name="n.csv"), multi_line=False).count() == 2


def test_broken_records_with_breaks_are_kept(spark, tmp_path):
    df = read_delimited(spark, written(tmp_path, 'a,b\n1,"x\ny"\n2\n3,"p\nq",9\n4,z\n5,z\n6,z\n'))
    rows = {r["a"]: r for r in df.collect()}
    assert rows["1"]["b"] == "x\ny" and rows["1"]["_malformed"] is None
    assert rows["2"]["_malformed"] == "2" and rows["3"]["_malformed"] == '3,"p\nq",9' and len(rows) == 6


@pytest.mark.parametrize("words", [("Umsatz", "Süd"), ("営業", "東京")])
def test_utf16_without_a_mark(spark, tmp_path, words):
    folder = tmp_path / "wide.csv"
    folder.mkdir()
    lines = [f"date,{words[0]},orders"] + [f"2024-01-{i:02d},{words[1]}{i},{i}" for i in range(1, 29)]
    for name in ("utf-16-le", "utf-16-be", "utf-8", "utf-16"):
        (folder / f"{name}.csv").write_bytes(("\n".join(lines) + "\n").encode(name))
    assert [f.encoding for f in inspect_files(spark, str(folder))] == ["UTF-16BE", "UTF-16LE", "UTF-16LE", "UTF-8"]
    rows = Counter(tuple(r) for r in read_delimited(spark, str(folder)).collect())
    assert rows == {(f"2024-01-{i:02d}", f"{words[1]}{i}", str(i), None): 4 for i in range(1, 29)}
