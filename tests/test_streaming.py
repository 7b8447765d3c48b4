import datetime as dt

from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.operators.detect import scorecard
from tallyveer.operators.series import daily_series
from tallyveer.sources.star import event_fact, table
from tallyveer.streaming import events as ev
from tallyveer.streaming import refresh as rf

CFG = AnalysisConfig(series_keys=("category",))


def write_events(spark, folder, rows):
    spark.createDataFrame(rows, ev.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def event(i, ts, kind="view", value=1.0):
    return (i, ts, 1, kind, value, None)


def test_new_files_are_picked_up_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_events(spark, source, [event(1, dt.datetime(2024, 1, 1))])
    stream = lambda: ev.stream_files(spark, source)
    assert ev.run_to_table(stream(), out).count() == 1
    write_events(spark, source, [event(2, dt.datetime(2024, 1, 2))])
    assert ev.run_to_table(stream(), out).count() == 2
    assert ev.run_to_table(stream(), out).count() == 2


def test_late_rows_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    totals = lambda: ev.tumbling_totals(ev.stream_files(spark, source), delay="1 hour")
    write_events(
        spark, source, [event(1, dt.datetime(2024, 1, 1, 12)), event(2, dt.datetime(2024, 1, 5))]
    )
    ev.run_to_table(totals(), out)
    write_events(
        spark, source, [event(3, dt.datetime(2024, 1, 1, 13)), event(4, dt.datetime(2024, 1, 9))]
    )
    rows = {r["window_start"].day: r["events"] for r in ev.run_to_table(totals(), out).collect()}
    assert rows == {1: 1, 5: 1}


def test_redelivery_is_removed(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: ev.without_redelivery(ev.stream_files(spark, source))
    again = event(1, dt.datetime(2024, 1, 1))
    write_events(spark, source, [again, again])
    ev.run_to_table(stream(), out)
    write_events(spark, source, [again, event(2, dt.datetime(2024, 1, 1))])
    assert ev.run_to_table(stream(), out).count() == 2


DAILY = "date date, category string, revenue double, orders double"


def test_replayed_batch_counts_once(spark, tmp_path):
    folder = str(tmp_path / "daily")
    batch = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 5.0, 1.0)], DAILY)
    for batch_id in (0, 1, 1):
        rf.merge_batch(batch, batch_id, folder, CFG)
    row = rf.current_daily(spark, folder, CFG).first()
    assert (float(row["revenue"]), float(row["orders"])) == (10.0, 2.0)


def test_batches_touch_only_their_dates(spark, tmp_path):
    folder = tmp_path / "daily"
    for batch_id, (day, value) in enumerate([(1, 5.0), (2, 7.0), (1, 11.0), (3, 1.0)]):
        rows = [(dt.date(2024, 1, day), c, value, 1.0) for c in "ab"] + [(None, "a", 9.0, 1.0)]
        rf.merge_batch(spark.createDataFrame(rows, DAILY), batch_id, str(folder), CFG)
        if batch_id == 1:
            files = {f.name for f in (folder / "date=2024-01-02").iterdir()}
    assert {f.name for f in (folder / "date=2024-01-02").iterdir()} == files
    rows = rf.current_daily(spark, str(folder), CFG).where("category = 'a'").collect()
    assert {r["date"].day: float(r["revenue"]) for r in rows} == {1: 16.0, 2: 7.0, 3: 1.0}


def test_stored_and_open_windows_are_the_batch_result(spark, tmp_path):
    # one user holds a third of the events
    rows = [
        (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), 1 if i % 3 == 0 else i % 40, "view", float(i % 7), None)
        for i in range(2000)
    ]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, ev.EVENT_SCHEMA).repartition(4).write.parquet(source)
    events = spark.read.parquet(source)
    for name, build, longest in (
        ("day", ev.tumbling_totals, "1 day"), ("slide", ev.sliding_totals, "14 days"), ("user", ev.user_sessions, None)
    ):
        closed = ev.run_to_table(build(ev.stream_files(spark, source)), str(tmp_path / name))
        both = ev.with_open_windows(closed, events, build, longest=longest).collect()
        want = build(events).collect()
        assert closed.count() < len(want)
        assert sorted(map(str, both)) == sorted(map(str, want))


def test_refreshed_card_equals_batch(spark, data, tmp_path):
    # several files, so several micro-batches
    source = str(tmp_path / "in")
    table(spark, data, "events").repartition(3).write.parquet(source)
    facts = ev.stream_files(spark, source, files_per_trigger=1).select(
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("category"),
        F.col("value").alias("revenue"),
        F.lit(1.0).alias("orders"),
    )
    home = str(tmp_path / "home")
    rf.follow(facts, home, CFG).awaitTermination()
    streamed = rf.refresh_scorecard(spark, f"{home}/daily", CFG)
    batch = scorecard(daily_series(event_fact(spark, data), CFG), CFG)
    key = lambda r: (r["category"], r["metric"])
    assert sorted(streamed.collect(), key=key) == sorted(batch.collect(), key=key)
    assert spark.read.parquet(f"{home}/cards").select("batch_id").distinct().count() == 3


def test_ring_change():
    assert rf.ring_change([1.0] * 27, 14) == 0.0
    assert rf.ring_change([2.0] * 14 + [1.0] * 14, 14) == -50.0
    assert rf.ring_change([0.0] * 14 + [1.0] * 14, 14) == 0.0


def test_alerts_survive_batches(spark, tmp_path):
    schema = "window_start timestamp, event_type string, value double"
    source = str(tmp_path / "in")
    for part in ([100.0] * 14, [90.0] * 7, [20.0] * 7):
        n = sum(1 for _ in (tmp_path / "in").glob("*.parquet")) if (tmp_path / "in").exists() else 0
        start = [0, 14, 21][n]
        rows = [
            (dt.datetime(2024, 1, 1) + dt.timedelta(days=start + i), "view", v)
            for i, v in enumerate(part)
        ]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    daily = ev.stream_files(
        spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=1
    )
    cfg = AnalysisConfig(lookback=7, change_warning=-5.0, change_critical=-40.0)
    out = ev.run_to_table(rf.severity_alerts(daily, cfg), str(tmp_path / "out"))
    steps = [(r["before"], r["after"]) for r in out.orderBy("date").collect()]
    assert steps == [("NORMAL", "WARNING"), ("WARNING", "CRITICAL")]


def test_windows_add_up_panes_not_events(spark, data):
    plan = ev.sliding_totals(table(spark, data, "events"))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Expand", 1)
    assert "Aggregate" in above and "Aggregate" in below and "Expand" not in below


def test_sliding_windows_from_a_stream(spark, tmp_path):
    source, start = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    for part in range(3):
        rows = [event(i, start + dt.timedelta(hours=5 * i), value=float(i)) for i in range(part * 60, part * 60 + 60)]
        write_events(spark, source, rows)
    batch = {tuple(r) for r in ev.sliding_totals(spark.read.parquet(source), "4 days").collect()}
    stream = ev.stream_files(spark, source, files_per_trigger=1)
    closed = ev.run_to_table(ev.sliding_totals(stream, "4 days"), str(tmp_path / "out"))
    assert {tuple(r) for r in closed.collect()} < batch and closed.count() > 25
    whole = ev.with_open_windows(closed, spark.read.parquet(source), lambda e: ev.sliding_totals(e, "4 days"), longest="4 days")
    assert whole.count() == len(batch) and {tuple(r) for r in whole.collect()} == batch


def test_an_idle_series_leaves_the_state(spark, tmp_path):
    schema = "window_start timestamp, event_type string, value double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cfg = AnalysisConfig(lookback=2, change_warning=-5.0, change_critical=-40.0)

    def run(rows):
        full = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), kind, v) for d, kind, v in rows]
        spark.createDataFrame(full, schema).coalesce(1).write.mode("append").parquet(source)
        daily = ev.stream_files(spark, source, spark.createDataFrame([], schema).schema)
        table = ev.run_to_table(rf.severity_alerts(daily, cfg, late_days=1, idle_days=5), out)
        state = spark.read.format("statestore").option("stateVarName", "level").load(f"{out}/progress")
        return {(r.series, r.before, r.after) for r in table.collect()}, {r.key.series for r in state.collect()}

    fall = [100.0, 100.0, 50.0, 50.0]
    alerts, held = run([(d, kind, v) for kind in ("a", "b") for d, v in enumerate(fall)])
    assert alerts == {("a", "NORMAL", "CRITICAL"), ("b", "NORMAL", "CRITICAL")}
    assert held == {"a", "b"}
    _, held = run([(d, "a", 50.0) for d in range(4, 8)])
    assert held == {"a", "b"}
    # b has been silent for its five days; a goes on, over restarts, from what it was
    alerts, held = run([(d, "a", 50.0) for d in range(8, 16)])
    recovered = {("a", "CRITICAL", "WARNING"), ("a", "WARNING", "NORMAL")}
    assert held == {"a"} and alerts == {("a", "NORMAL", "CRITICAL"), ("b", "NORMAL", "CRITICAL")} | recovered
    _, held = run([(16, "b", 10.0)])
    assert held == {"a", "b"}


def test_settings_come_back(spark, tmp_path):
    name = next(iter(ev.STREAM_SETTINGS))
    before = spark.conf.get(name, None)
    write_events(spark, str(tmp_path / "in"), [event(1, dt.datetime(2024, 1, 1))])
    ev.run_to_table(ev.user_sessions(ev.stream_files(spark, str(tmp_path / "in"))), str(tmp_path / "out"))
    assert spark.conf.get(name, None) == before
