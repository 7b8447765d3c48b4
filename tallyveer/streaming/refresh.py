"""Scorecards and alerts that follow a stream of facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyveer.config import AnalysisConfig
from tallyveer.operators.detect import scorecard
from tallyveer.operators.rollup import average_order_value, exact_sum
from tallyveer.operators.series import AMOUNT, to_long
from tallyveer.session import remove_folder, share_package, stored

TOTALS = ("revenue", "orders")


def batch_totals(facts: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Sums of one micro-batch per series and date."""
    return facts.groupBy(*cfg.series_keys, "date").agg(
        *[exact_sum(c).cast(AMOUNT).alias(c) for c in TOTALS]
    )


def daily_schema(batch: DataFrame, cfg: AnalysisConfig) -> T.StructType:
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    fields = [T.StructField(k, kinds[k]) for k in cfg.series_keys]
    amount = T.DecimalType(28, 4)
    fields += [T.StructField(c, amount) for c in TOTALS] + [T.StructField("last_batch", T.LongType())]
    return T.StructType([*fields, T.StructField("date", T.DateType())])


def merge_batch(batch: DataFrame, batch_id: int, folder: str, cfg: AnalysisConfig) -> None:
    """Add the sums of a micro-batch to the table of daily totals, which is partitioned by date.

    Only the dates of the batch are read and replaced, so the cost of a batch does not grow with the batches before it. Each date knows the
    last batch it holds; a replayed batch leaves the dates that hold it already as they are. Facts without a date are left out.
    """
    spark, schema = batch.sparkSession, daily_schema(batch, cfg)
    made: list[str] = []
    sums = stored(batch_totals(batch.where("date IS NOT NULL"), cfg), "batch", made)
    dates = [r.date for r in sums.select("date").distinct().collect()]  # bounded by the calendar
    if not dates:
        for path in made:
            remove_folder(spark, path)
        return
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("date").parquet(folder)
    old = spark.read.schema(schema).parquet(folder).where(F.col("date").isin(dates))
    held = old.where(F.col("last_batch") >= batch_id)
    new = sums.join(held.select("date").distinct(), "date", "left_anti").withColumn("last_batch", F.lit(batch_id).cast("long"))
    earlier = old.where(F.col("last_batch") < batch_id)
    merged = earlier.unionByName(new).groupBy(*cfg.series_keys, "date").agg(
        *[F.sum(c).cast(AMOUNT).alias(c) for c in TOTALS]
    )
    merged = merged.withColumn("last_batch", F.lit(batch_id).cast("long"))
    # the table is both read and written: fix the result first
    result = stored(merged.select(*schema.names), "merged", made)
    result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(folder)
    for path in made:
        remove_folder(spark, path)


def current_daily(spark: SparkSession, folder: str, cfg: AnalysisConfig) -> DataFrame:
    """Daily totals over all merged micro-batches."""
    return (
        spark.read.parquet(folder)
        .select(*cfg.series_keys, "date", *TOTALS)
        .withColumn(
            "avg_order_value",
            average_order_value(F.col("revenue"), F.col("orders")).cast(AMOUNT),
        )
    )


def refresh_scorecard(spark: SparkSession, folder: str, cfg: AnalysisConfig) -> DataFrame:
    return scorecard(to_long(current_daily(spark, folder, cfg), cfg), cfg)


def follow(facts: DataFrame, folder: str, cfg: AnalysisConfig, write_cards: bool = True):
    """Start a query that refreshes the stored scorecard after every micro-batch.

    The scorecard of a batch is written to ``cards/batch_id=N``; a replayed
    batch replaces its own card.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, f"{folder}/daily", cfg)
        if write_cards:
            cards = refresh_scorecard(batch.sparkSession, f"{folder}/daily", cfg)
            cards.write.mode("overwrite").parquet(f"{folder}/cards/batch_id={batch_id}")

    return (
        facts.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )


ALERT_SCHEMA = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("change_pct", T.DoubleType()),
    ]
)


def ring_change(totals: list[float], lookback: int) -> float:
    """Percentage change of the latest ``lookback`` totals against those before."""
    if len(totals) < 2 * lookback:
        return 0.0
    recent, prior = sum(totals[-lookback:]), sum(totals[-2 * lookback : -lookback])
    return (recent - prior) / prior * 100.0 if prior else 0.0


class RingOfTotals(StatefulProcessor):
    """The latest two windows of daily totals of a series, and the severity they had.

    A timer in event time stands ``idle`` days after the last total. When the watermark reaches it, the series leaves the state
    store; should it come back, it starts anew.
    """

    def __init__(self, cfg: AnalysisConfig, idle: int) -> None:
        self.lookback, self.critical, self.warning = cfg.lookback, cfg.change_critical, cfg.change_warning
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "day long", "total double")
        self.level = handle.getValueState("level", "severity string")

    def due(self, day: int) -> int:
        return (day + self.idle) * 86_400_000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ring = {k[0]: v[0] for k, v in self.ring.iterator()}
        level = self.level.get()[0] if self.level.exists() else "NORMAL"
        held, last = set(ring), max(ring, default=None)
        alerts = []
        new = sorted((int(d), float(t)) for part in rows for d, t in zip(part["day"], part["total"], strict=True))
        for day, total in new:
            ring[day] = ring.get(day, 0.0) + total
            kept = sorted(ring)[-2 * self.lookback :]
            ring = {d: ring[d] for d in kept}
            change = ring_change([ring[d] for d in kept], self.lookback)
            now = "CRITICAL" if change < self.critical else "WARNING" if change < self.warning else "NORMAL"
            if now != level:
                date = (pd.Timestamp("1970-01-01") + pd.Timedelta(days=day)).date()
                alerts.append((key[0], date, level, now, round(change, 2)))
                level = now
        for day in held - set(ring):
            self.ring.removeKey((day,))
        for day, _ in new:
            if day in ring:
                self.ring.updateValue((day,), (ring[day],))
        self.level.update((level,))
        if last is not None:
            self.handle.deleteTimer(self.due(last))
        self.handle.registerTimer(self.due(max(ring)))
        yield pd.DataFrame(alerts, columns=ALERT_SCHEMA.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        self.level.clear()
        yield pd.DataFrame([], columns=ALERT_SCHEMA.names)

    def close(self) -> None:
        pass


def severity_alerts(
    daily: DataFrame,
    cfg: AnalysisConfig,
    series: str = "event_type",
    value: str = "value",
    late_days: int = 7,
    idle_days: int = 90,
) -> DataFrame:
    """Alert when the severity of a series changes, from a stream of daily totals.

    ``daily`` holds closed daily windows (``window_start``, series, value). Each series keeps the latest two windows of daily totals as
    state, nothing more. Totals more than ``late_days`` behind the latest of all are dropped, and a series without totals for
    ``idle_days`` is forgotten. Run it with :func:`tallyveer.streaming.events.run_to_table`, whose state store has timers.
    """
    share_package(daily.sparkSession)
    points = daily.withWatermark("window_start", f"{late_days} days").select(
        "window_start",
        F.col(series).alias("series"),
        F.unix_date(F.col("window_start").cast("date")).cast("bigint").alias("day"),
        F.col(value).cast("double").alias("total"),
    )
    return points.groupBy("series").transformWithStateInPandas(
        RingOfTotals(cfg, idle_days), ALERT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
