"""Catalog tables, SQL, retention and purge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETENTION_DAYS = {"raw": 30, "processed": 7}


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = f" LOCATION {_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(name)}{at}")


def register_table(
    spark: SparkSession, name: str, location: str, schema: str, kind: str = "parquet",
    partitioned_by: tuple[str, ...] = (),
) -> None:
    """External table over existing files, columns by name."""
    options = " OPTIONS (header 'true')" if kind == "csv" else ""
    parts = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({schema}) USING {kind}{options}"
        f"{parts} LOCATION {_literal(location)}"
    )
    if partitioned_by:
        spark.sql(f"MSCK REPAIR TABLE {_quoted(name)}")


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Typed result of a SQL text, whole."""
    return spark.sql(sql)


def first_rows(result: DataFrame, rows: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``rows`` rows in a stated order; ``cut`` tells whether there are more.

    One row beyond the limit is asked for, so the answer costs no count.
    """
    if not order_by:
        raise ValueError("a capped result needs an order, else its rows are arbitrary")
    head = result.orderBy(*order_by).limit(rows + 1)
    place = Window.orderBy(*order_by)  # at most rows + 1 rows
    numbered = head.withColumns({"_at": F.row_number().over(place), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    return numbered.where(F.col("_at") <= rows).select(*result.columns, (F.col("_n") > rows).alias("cut"))


def retained(df: DataFrame, days: int, as_of: dt.date, column: str = "ingest_date") -> DataFrame:
    """Rows not older than ``days`` days on ``as_of``."""
    return df.filter(F.col(column) > F.date_sub(F.lit(as_of), days))


def without_run(df: DataFrame, run_id: str, column: str = "run_id") -> DataFrame:
    """Rows of all other runs."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(run_id)))


def drop_expired(
    spark: SparkSession, table: str, days: int, as_of: dt.date, column: str = "ingest_date"
) -> list[str]:
    """Drop the partitions of a catalog table that are past their retention."""
    cutoff = (as_of - dt.timedelta(days=days)).isoformat()
    dropped = []
    for row in spark.sql(f"SHOW PARTITIONS {_quoted(table)}").collect():
        value = dict(part.split("=", 1) for part in row[0].split("/"))[column]
        if value <= cutoff:
            spark.sql(
                f"ALTER TABLE {_quoted(table)} DROP IF EXISTS PARTITION ({column} = {_literal(value)})"
            )
            dropped.append(value)
    return dropped


def purge_run(spark: SparkSession, table: str, run_id: str, column: str = "run_id") -> None:
    """Drop everything one run wrote to a managed table partitioned by run."""
    spark.sql(
        f"ALTER TABLE {_quoted(table)} DROP IF EXISTS PARTITION ({column} = {_literal(run_id)})"
    )
