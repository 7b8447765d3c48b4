"""Streaming queries: run to completion over the events file, then read the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.registry import sql as q
from tallyveer.registry.core import query
from tallyveer.registry.stage_queries import CARD_COLUMNS, EVENT_CARD, plain_card
from tallyveer.session import work_folder
from tallyveer.sources.star import table
from tallyveer.streaming import events as ev
from tallyveer.streaming import refresh as rf

BY_TYPE = AnalysisConfig(series_keys=("category",))


def event_stream(spark, folder):
    return ev.stream_files(spark, folder, pattern="events.parquet")


def finished(stream, purpose):
    return ev.run_to_table(stream, work_folder(stream.sparkSession, purpose))


@query(
    "t1_incremental_ingest",
    "SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS value "
    "FROM events GROUP BY event_type",
)
def _(spark, folder):
    rows = finished(event_stream(spark, folder), "ingest")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value")
    )


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
TOTALS = "count(*) AS events, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS value"
# what the second stream of the alerts gets: windows the watermark has passed
CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(
    "t2_tumbling_totals",
    f"""SELECT {STAMP.format('day')} AS window_start,
    {STAMP.format('day + INTERVAL 1 DAY')} AS window_end, event_type, {TOTALS}
    FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS day FROM events) GROUP BY day, event_type""",
)
def _(spark, folder):
    closed = finished(ev.tumbling_totals(event_stream(spark, folder)), "tumbling")
    return ev.with_open_windows(closed, table(spark, folder, "events"), ev.tumbling_totals, longest="1 day")


@query(
    "t3_sliding_totals",
    f"""SELECT {STAMP.format('start')} AS window_start,
    {STAMP.format('start + INTERVAL 14 DAY')} AS window_end, {TOTALS}
    FROM (SELECT value, date_trunc('day', ts)::TIMESTAMP - to_days(CAST(k AS INTEGER)) AS start
          FROM events, range(0, 14) AS steps(k))
    GROUP BY start""",
)
def _(spark, folder):
    closed = finished(ev.sliding_totals(event_stream(spark, folder)), "sliding")
    return ev.with_open_windows(closed, table(spark, folder, "events"), ev.sliding_totals, longest="14 days")


@query(
    "t4_user_sessions",
    f"""WITH marked AS (
      SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL
                     THEN 1 ELSE 0 END AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                 ROWS UNBOUNDED PRECEDING) AS session FROM marked),
    sessions AS (
      SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 30 MINUTE AS e, {TOTALS}
      FROM numbered GROUP BY user_id, session)
    SELECT {STAMP.format('s')} AS window_start, {STAMP.format('e')} AS window_end, user_id,
           events, value FROM sessions""",
)
def _(spark, folder):
    closed = finished(ev.user_sessions(event_stream(spark, folder)), "sessions")
    return ev.with_open_windows(closed, table(spark, folder, "events"), ev.user_sessions)


@query(
    "t5_without_redelivery",
    "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
)
def _(spark, folder):
    stream = event_stream(spark, folder)
    # the same delivery arrives twice
    twice = stream.unionByName(event_stream(spark, folder))
    rows = finished(ev.without_redelivery(twice), "dedup")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def fact_stream(spark, folder):
    """The event stream as canonical facts."""
    return event_stream(spark, folder).select(
        F.col("ts").cast("date").alias("date"),
        F.coalesce("event_type", F.lit("Unknown")).alias("category"),
        F.coalesce("value", F.lit(0.0)).alias("revenue"),
        F.lit(1.0).alias("orders"),
    )


@query("t6_scorecard_refresh", f"{EVENT_CARD} SELECT category, {CARD_COLUMNS} FROM card")
def _(spark, folder):
    home = work_folder(spark, "refresh")
    rf.follow(fact_stream(spark, folder), home, BY_TYPE).awaitTermination()
    return plain_card(rf.refresh_scorecard(spark, f"{home}/daily", BY_TYPE))


@query(
    "t7_severity_alerts",
    f"""WITH days AS (
      SELECT event_type AS series, day, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS total
      FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS day FROM events)
      WHERE day + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL),
    rings AS (
      SELECT series, day, count(*) OVER (PARTITION BY series ORDER BY day) AS k,
        sum(total) OVER (PARTITION BY series ORDER BY day
                         ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS recent,
        sum(total) OVER (PARTITION BY series ORDER BY day
                         ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS prior FROM days),
    graded AS (
      SELECT series, day, change, CASE WHEN change < -5 THEN 'CRITICAL' WHEN change < -1
        THEN 'WARNING' ELSE 'NORMAL' END AS after FROM (
        SELECT *, CASE WHEN k < 14 OR prior = 0 THEN 0 ELSE (recent - prior) / prior * 1e2 END
          AS change FROM rings))
    SELECT series, strftime(day, '%Y-%m-%d') AS date, before, after, {q.rnd('change', 2)} AS change_pct
    FROM (SELECT *, lag(after, 1, 'NORMAL') OVER (PARTITION BY series ORDER BY day) AS before
          FROM graded) WHERE before <> after""",
)
def _(spark, folder):
    cfg = AnalysisConfig(lookback=7, change_critical=-5.0, change_warning=-1.0)
    daily = ev.tumbling_totals(event_stream(spark, folder))
    home = work_folder(spark, "totals")
    ev.run_to_table(daily, home)
    # the closed windows are the input of the second stream
    stored = ev.stream_files(spark, f"{home}/rows", daily.schema)
    return finished(rf.severity_alerts(stored, cfg), "alerts")
