"""Where raw data comes from and where its snapshots go."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveer.functions import quoted
from tallyveer.operators.repair import (
    DATE_RATE,
    Aliases,
    assign_sequential_dates,
    ensure_measures,
    find_date_column,
    flag_holidays,
    looks_like_date,
    map_columns,
    number_in,
    repair,
    require_rows,
    text_columns,
)
from tallyveer.operators.rollup import roll_up
from tallyveer.session import stored
from tallyveer.sources.delimited import EXTENSIONS, read_delimited

CACHED_MARKERS = ("inventory_status", "impressions")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC or JSON by extension, else delimited text."""
    name = path.lower().rstrip("/")
    for kind in ("parquet", "orc", "json"):
        if name.endswith(f".{kind}"):
            return spark.read.format(kind).load(path)
    if name.endswith((".xlsx", ".xls")):
        raise ValueError("workbooks have no Spark source: save them as CSV or Parquet")
    if not name.endswith(EXTENSIONS):
        raise ValueError(f"unsupported file {path!r}: expected delimited text, Parquet, ORC or JSON")
    return read_delimited(spark, path)


def profiled(df: DataFrame, dates: bool, numbers: bool) -> Row:
    """One row over the whole table: rows, and what each column could be, as far as asked.

    ``d<i>`` is the share of dates in text column ``i``, ``n<i>`` whether all its values are numbers and ``m<i>`` the mean of a
    column's numbers.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = quoted(f.name)
        if f.name in text_columns(df):
            number = number_in(df, f.name)
            if dates:
                share = F.try_divide(F.count_if(looks_like_date(f.name)).cast("double"), F.count(c))
                measures.append(F.coalesce(share, F.lit(0.0)).alias(f"d{i}"))
            if numbers:
                measures.append(((F.count(c) > 0) & (F.count(c) == F.count(number))).alias(f"n{i}"))
                measures.append(F.avg(number).alias(f"m{i}"))
        elif numbers and isinstance(f.dataType, T.NumericType):
            measures.append(F.avg(c.cast("double")).alias(f"m{i}"))
    return df.agg(*measures).first()


def shaped(df: DataFrame) -> DataFrame:
    """A mapped table with a ``date`` column, where one can be found, and two measures.

    Reads the table once, and only where a column has to be found: the first text column with enough dates becomes the date, the
    numeric column with the highest mean the revenue, the first one left the orders.
    """
    typed = (T.DateType, T.TimestampType, T.TimestampNTZType)
    undated = "date" not in df.columns and not any(isinstance(f.dataType, typed) for f in df.schema.fields)
    unmeasured = "revenue" not in df.columns or "orders" not in df.columns
    if not (undated or unmeasured):
        return find_date_column(df)
    row = profiled(df, undated, unmeasured)
    if not row["rows"]:
        raise ValueError("the file holds no data rows")
    names = df.columns
    date = next((c for i, c in enumerate(names) if undated and (row.asDict().get(f"d{i}") or 0) >= DATE_RATE), None)
    if unmeasured:
        numeric = {c for i, c in enumerate(names) if c != date and row.asDict().get(f"n{i}")}
        means = {c: row.asDict().get(f"m{i}") for i, c in enumerate(names)}
        df = df.select(*[number_in(df, c).alias(c) if c in numeric else quoted(c) for c in names])
        df = ensure_measures(df, means)
    return df.withColumnRenamed(date, "date") if date else find_date_column(df) if not undated else df


def load_raw(
    spark: SparkSession,
    source: str,
    anchor: dt.date | None = None,
    order_by: Sequence[str] = (),
    aliases: Aliases = None,
    date_order: str | None = None,
) -> DataFrame:
    """A user's file with canonical names, a date column and two measures.

    ``aliases`` are further spellings per canonical column. A table without dates gets consecutive days that end at ``anchor``, its
    rows ordered by ``order_by`` (all columns if not given); without an anchor it is refused. Text in which columns have to be found, or
    the order of the dates, is parsed once into the work folder.
    """
    df = map_columns(read_any(spark, source), aliases)
    clear = {"date", "revenue", "orders"} <= set(df.columns) and date_order is not None
    if not clear and source.lower().rstrip("/").endswith(EXTENSIONS):
        df = stored(df, "raw-text")
    before, df = df.columns, shaped(df)
    if "date" not in df.columns:
        if anchor is None:
            raise ValueError("the file has no date column: give the date of its last row as anchor")
        renamed = dict(zip(before, df.columns, strict=False))  # new columns come last
        df = assign_sequential_dates(df, [renamed[c] for c in order_by] or df.columns, anchor)
    return df


def load_repaired(
    spark: SparkSession,
    source: str,
    anchor: dt.date | None = None,
    order_by: Sequence[str] = (),
    aliases: Aliases = None,
    holidays: Sequence[tuple[int, int]] | None = None,
    date_order: str | None = None,
) -> DataFrame:
    """Canonical fact of a user's file, without a look at whether it has rows.

    ``holidays`` are (month, day) pairs for a file that does not flag its own; ``date_order`` (``day_first`` or ``month_first``) settles how
    dates are read, which otherwise the column's values do.
    """
    raw = load_raw(spark, source, anchor, order_by, aliases, date_order)
    fact = repair(raw, date_order)
    return flag_holidays(fact, holidays) if holidays is not None and "holiday_flag" not in raw.columns else fact


def load_fact(spark: SparkSession, source: str, *args, **options) -> DataFrame:
    """Canonical fact of a user's file, options as of :func:`load_repaired`; refused where no row has a readable date."""
    return require_rows(load_repaired(spark, source, *args, **options), "no row has a date that can be read")


def load_processed(spark: SparkSession, source: str, path: str, *args, **options) -> DataFrame:
    """Roll a user's file up once, store it by month, and give the stored fact; options as of :func:`load_repaired`.

    The text is read twice: for the formats of its files, and to be parsed.
    """
    write_processed(roll_up(load_repaired(spark, source, *args, **options)), path)
    return require_rows(read_processed(spark, path), "no row has a date that can be read")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored raw snapshot; refused when it lacks the columns that mark one."""
    df = spark.read.parquet(path)
    absent = [c for c in CACHED_MARKERS if c not in df.columns]
    if absent:
        raise ValueError(f"snapshot {path!r} lacks {absent}; load the source again")
    return df


def write_snapshot(df: DataFrame, path: str, ingest_date: dt.date) -> None:
    """Store a raw snapshot under its ingest date; other dates stay untouched."""
    (
        df.withColumn("ingest_date", F.lit(ingest_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_date")
        .parquet(path)
    )


def write_processed(rolled: DataFrame, path: str) -> None:
    """Store the rolled-up fact by month, dates sorted inside each file.

    Rows are rebalanced by month: a task holds few months, so few files are written, and a month with most of the rows is split. The input
    is computed once.
    """
    month = F.date_format("date", "yyyy-MM")
    (
        rolled.withColumn("month", month)
        .hint("rebalance", "month")
        .sortWithinPartitions("month", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def read_processed(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The stored fact, optionally pruned to some months."""
    df = spark.read.parquet(path)
    if months is not None:
        df = df.filter(F.col("month").isin(months))
    return df.drop("month")


def write_csv(df: DataFrame, path: str, separator: str = ",", encoding: str = "UTF-8") -> None:
    """Delimited export to any file system Spark knows."""
    df.write.mode("overwrite").option("header", True).option("sep", separator).option(
        "encoding", encoding
    ).csv(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per row."""
    documents.write.mode("overwrite").json(path)
