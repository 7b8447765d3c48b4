"""Queries over sources, sinks, schema repair and data quality.

Raw inputs are derived from the given tables with the defects a user's file
has: mixed date formats, text in numbers, missing values, other column names.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.functions import finite_or_null, half_even
from tallyveer.operators import insight as ins
from tallyveer.operators import repair as rp
from tallyveer.operators import rollup as ru
from tallyveer.operators import similar as sm
from tallyveer.operators import sketch as sk
from tallyveer.registry import sql as q
from tallyveer.registry.core import query
from tallyveer.schema import HOLIDAYS
from tallyveer.session import stored, work_folder
from tallyveer.sources import catalog as cat
from tallyveer.sources import raw as rw
from tallyveer.sources.star import star_fact, table

FACTS = f"WITH {q.FACT}"


def under_header(header: str, line: Column) -> Column:
    """The lines of text files, each file under its own header: tasks write their files side by side."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its task
    return F.explode(F.when(first, F.array(F.lit(header), line)).otherwise(F.array(line))).alias("value")


def messy_lines(spark, folder) -> DataFrame:
    """Order lines as a user might upload them, every column as text."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    day, source = F.col("o_orderdate"), F.col("o_orderpriority")
    formats = {
        "1-URGENT": "yyyy-MM-dd",
        "2-HIGH": "MM/dd/yyyy",
        "3-MEDIUM": "dd.MM.yyyy",
        "5-LOW": "MMM d yyyy",
    }
    written = F.lit("not recorded")
    for name, pattern in formats.items():
        written = F.when(source == name, F.date_format(day, pattern)).otherwise(written)
    price = F.col("l_extendedprice").cast("string")
    return lines.select(
        written.alias("Order Date"),
        F.when(F.col("l_returnflag") == "R", "n/a")
        .when(F.col("l_returnflag") == "A", F.concat(F.lit(" "), price))
        .otherwise(price)
        .alias("Total-Sales"),
        F.col("l_tax").cast("string").alias("Amount"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("string")).alias("Units"),
        F.when(F.col("l_discount") != 0, F.col("l_linestatus")).alias("Segment"),
        source.alias("Platform"),
        F.col("l_suppkey").cast("string").alias("Remark"),
    )


MESSY = """messy AS (
  SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              ELSE CAST(o_orderdate AS DATE) END AS date,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS revenue_raw,
         CASE WHEN l_linestatus = 'F' THEN l_quantity END AS orders_raw,
         CASE WHEN l_discount <> 0 THEN l_linestatus END AS category_raw,
         o_orderpriority AS channel, l_returnflag, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "p1_p2_alias_mapping",
    f"WITH {MESSY} SELECT channel, count(*) AS n, sum(CAST(coalesce(revenue_raw, 0) AS "
    "DECIMAL(18,4)))::DOUBLE AS revenue, sum(CAST(l_tax AS DECIMAL(18,4)))::DOUBLE AS amount, "
    "sum(coalesce(orders_raw, 0)) AS orders FROM messy GROUP BY channel",
)
def _(spark, folder):
    mapped = rp.map_columns(messy_lines(spark, folder))
    return mapped.groupBy("channel").agg(
        F.count("*").alias("n"),
        ru.exact_sum(F.coalesce(rp.number_in(mapped, "revenue"), F.lit(0.0))).alias("revenue"),
        # the second alias of revenue keeps its own name
        ru.exact_sum(F.col("Amount").cast("double")).alias("amount"),
        F.sum(F.coalesce(rp.number_in(mapped, "orders"), F.lit(0.0))).alias("orders"),
    )


@query(
    "p7_p8_p9_p10_repair",
    f"WITH {MESSY} SELECT {q.iso('date')} AS date, coalesce(category_raw, 'Unknown') AS category, "
    "channel, 'Unknown' AS region, count(*) AS n, "
    "sum(CAST(coalesce(revenue_raw, 0) AS DECIMAL(18,4)))::DOUBLE AS revenue, "
    "sum(coalesce(orders_raw, 0)) AS orders, 0.0::DOUBLE AS impressions "
    "FROM messy WHERE date IS NOT NULL GROUP BY ALL",
)
def _(spark, folder):
    fact = rp.repair(rp.map_columns(messy_lines(spark, folder)))
    return fact.groupBy("date", "category", "channel", "region").agg(
        F.count("*").alias("n"),
        ru.exact_sum("revenue").alias("revenue"),
        F.sum("orders").alias("orders"),
        F.sum("impressions").alias("impressions"),
    )


@query(
    "p2_names_that_differ_in_case",
    "SELECT o_orderstatus AS region, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE "
    "AS revenue, sum(o_custkey) AS other FROM orders GROUP BY 1",
)
def _(spark, folder):
    # the canonical spelling wins over the alias before it, and the same name in capitals gets a number
    orders = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("State"),
        F.col("o_orderstatus").alias("Region"),
        F.col("o_custkey").cast("string").alias("Sales"),
        F.col("o_totalprice").cast("string").alias("Revenue"),
    )
    mapped = rp.map_columns(orders.toDF("State", "Region", "Sales", "Revenue").withColumn("x.y", F.lit(1)))
    return mapped.groupBy("region").agg(
        F.count("*").alias("n"),
        ru.exact_sum(F.col("revenue").cast("double")).alias("revenue"),
        F.sum(F.col("Sales").cast("bigint")).alias("other"),
    )


@query(
    "p8_date_parsing",
    f"WITH {MESSY} SELECT channel, count(date) AS parsed, count(*) - count(date) AS failed, "
    f"{q.iso('min(date)')} AS first_date, {q.iso('max(date)')} AS last_date FROM messy GROUP BY channel",
)
def _(spark, folder):
    day = rp.parse_date(F.col("Order Date"))
    return messy_lines(spark, folder).groupBy(F.col("Platform").alias("channel")).agg(
        F.count(day).alias("parsed"),
        F.count_if(day.isNull()).alias("failed"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
    )


#: Ways to write a date, by the remainder of the order's key; further remainders are no dates.
WRITTEN = (
    "M/d/yyyy",
    "yyyy-M-d",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss'+00:00'",
    "MM/dd/yyyy HH:mm",
    "dd-MMM-yyyy",
    "MM/dd/yy",
    "yyyyMMdd",
    "dd.MM.yyyy",
    "MMMM d, yyyy",
    "yyyy/MM/dd hh:mm a",
)
JUNK = ("2024-13-01", "31/31/2024", "20", "1700000000", "soon", "2024-02-30", "12:30")


def written_dates(spark, folder) -> DataFrame:
    """Orders with their date as text in many ways, and texts that are no dates."""
    kind = F.col("o_orderkey") % (len(WRITTEN) + len(JUNK))
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(WRITTEN):
        text = F.when(kind == i, F.date_format("o_orderdate", pattern)).otherwise(text)
    for i, junk in enumerate(JUNK, len(WRITTEN)):
        text = F.when(kind == i, junk).otherwise(text)
    return table(spark, folder, "orders").select(kind.alias("kind"), text.alias("written"))


@query(
    "p8_date_shapes",
    "SELECT o_orderkey % 19 AS kind, count(*) AS n, count(*) FILTER (o_orderkey % 19 < 12) AS parsed, "
    "sum(CASE WHEN o_orderkey % 19 < 12 THEN datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) END)::BIGINT "
    "AS days FROM orders GROUP BY 1",
)
def _(spark, folder):
    day = rp.parse_date(F.col("written"))
    return written_dates(spark, folder).groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count(day).alias("parsed"),
        F.sum(F.datediff(day, F.lit("1990-01-01").cast("date"))).alias("days"),
    )


def dates_in_orders(spark, folder) -> DataFrame:
    """Orders with their date in columns that write day before month, month before day, undecided, and both."""
    day = F.col("o_orderdate")
    contrary = F.col("o_orderkey") % 7 == 0
    return table(spark, folder, "orders").select(
        F.date_format(day, "dd/MM/yyyy").alias("day_first"),
        F.date_format(day, "MM-dd-yy").alias("month_first"),
        F.when(F.dayofmonth(day) <= 12, F.date_format(day, "d/M/yyyy HH:mm")).alias("undecided"),
        F.when(contrary, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy")).alias("both"),
    )


_TURNED = "CASE WHEN low THEN make_date(year(day), dayofmonth(day), month(day)) END"


@query(
    "p8_date_order_by_column",
    f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 7 = 0 AS contrary, dayofmonth(o_orderdate) <= 12 AS low FROM orders),
    r AS (
      SELECT 'day_first' AS "column", day AS read, NOT low AS d, false AS m FROM o
      UNION ALL SELECT 'month_first', day, false, NOT low FROM o
      UNION ALL SELECT 'undecided', {_TURNED}, false, false FROM o
      UNION ALL SELECT 'both', CASE WHEN contrary AND low THEN {_TURNED} ELSE day END, NOT low AND NOT contrary, NOT low AND contrary FROM o)
    SELECT "column", count(read) AS parsed, sum(datediff('day', DATE '1990-01-01', read))::BIGINT AS days,
      count(*) FILTER (d) AS day_first_dates, count(*) FILTER (m) AS month_first_dates,
      least(count(*) FILTER (d), count(*) FILTER (m)) AS contradicted_dates FROM r GROUP BY 1""",
)
def _(spark, folder):
    written = dates_in_orders(spark, folder)
    parts = []
    for name in written.columns:
        one = written.select(F.col(name).alias("date"))
        counters = rp.quality_columns(one)
        names = ("day_first_dates", "month_first_dates", "contradicted_dates")
        days = F.sum(F.datediff("_day", F.lit("1990-01-01").cast("date")))
        parts.append(
            rp.with_parsed_day(one).agg(
                F.lit(name).alias("column"),
                counters["kept_rows"].alias("parsed"),
                days.alias("days"),
                *[counters[c].alias(c) for c in names],
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "p9_number_shapes",
    "SELECT l_linenumber % 7 AS kind, count(*) AS n, sum(CASE l_linenumber % 7 WHEN 0 THEN CAST(l_extendedprice AS DECIMAL(18,4)) "
    "WHEN 1 THEN 1200 ELSE 0 END)::DOUBLE AS revenue, count(*) FILTER (l_linenumber % 7 > 1) AS lost "
    "FROM lineitem GROUP BY 1",
)
def _(spark, folder):
    kind = F.col("l_linenumber") % 7
    text = F.concat(F.lit(" "), F.col("l_extendedprice").cast("string"))
    for i, cell in enumerate(("+1.2e3", "12d", "12f", "1e20", "inf", "0x1F"), 1):
        text = F.when(kind == i, cell).otherwise(text)
    lines = table(spark, folder, "lineitem").select(
        F.lit("2024-01-05").alias("date"), kind.cast("string").alias("channel"), text.alias("revenue")
    )
    sums = rp.repair(lines).groupBy("channel").agg(F.count("*").alias("n"), ru.exact_sum("revenue").alias("revenue"))
    lost = lines.groupBy("channel").agg(F.count_if(rp.number_in(lines, "revenue").isNull()).alias("lost"))
    return sums.join(lost, "channel").select(F.col("channel").cast("bigint").alias("kind"), "n", "revenue", "lost")


@query(
    "p14_quality_counters",
    f"""WITH {MESSY} SELECT count(*) AS input_rows, count(*) FILTER (date IS NULL) AS dropped_rows,
    count(date) AS kept_rows, {q.iso('min(date)')} AS first_date, {q.iso('max(date)')} AS last_date,
    count(*) FILTER (date IS NOT NULL AND l_returnflag = 'R') AS coerced_revenue,
    0 AS null_revenue, 0 AS coerced_orders, 0 AS day_first_dates, 0 AS contradicted_dates,
    count(*) FILTER (channel = '2-HIGH' AND dayofmonth(date) > 12) AS month_first_dates,
    count(*) FILTER (date IS NOT NULL AND orders_raw IS NULL) AS null_orders,
    count(*) FILTER (date IS NOT NULL AND category_raw IS NULL) AS filled_category,
    0 AS filled_channel,
    sum(CAST(coalesce(revenue_raw, 0) AS DECIMAL(18,4))) FILTER (date IS NOT NULL)::DOUBLE
      AS total_revenue FROM messy""",
)
def _(spark, folder):
    return rp.quality_report(rp.map_columns(messy_lines(spark, folder)))


@query(
    "p13_u2_unfilled_columns",
    f"""WITH {MESSY} SELECT unnest(['date', 'region', 'product', 'category', 'channel', 'revenue',
      'orders', 'impressions', 'campaign', 'inventory_status', 'discount_band', 'holiday_flag',
      'incident_flag']) AS "column"
    EXCEPT SELECT held FROM (SELECT 'date' AS held, count(date) AS n FROM messy
      UNION ALL SELECT 'revenue', count(revenue_raw) FROM messy
      UNION ALL SELECT 'orders', count(orders_raw) FROM messy
      UNION ALL SELECT 'category', count(category_raw) FROM messy
      UNION ALL SELECT 'channel', count(channel) FROM messy) WHERE n > 0""",
)
def _(spark, folder):
    return rp.unfilled_columns(rp.map_columns(messy_lines(spark, folder)))


@query(
    "p4_date_candidates",
    "SELECT 'placed.on' AS \"column\", count(*) FILTER (o_orderkey % 3 <> 0)::DOUBLE / count(*) AS parse_rate FROM orders "
    "UNION ALL SELECT 'o_orderpriority', 0.0::DOUBLE UNION ALL SELECT 'digits', 0.0::DOUBLE",
)
def _(spark, folder):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    orders = table(spark, folder, "orders").select(
        "o_orderpriority",
        F.date_format("o_orderdate", "yyyyMMdd").alias("digits"),
        F.when(F.col("o_orderkey") % 3 == 0, "pending").otherwise(day).alias("placed.on"),
    )
    return rp.date_candidates(orders).drop("position")


@query(
    "p4_find_date_column",
    f"SELECT {q.iso('o_orderdate')} AS date, count(*) AS n FROM orders GROUP BY 1",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("when.placed")
    )
    return rp.find_date_column(orders).groupBy("date").agg(F.count("*").alias("n"))


@query(
    "p5_sequential_dates",
    f"SELECT c_custkey, {q.iso('''DATE '2001-08-01' - CAST(count(*) OVER () - row_number() OVER (ORDER BY c_custkey) AS INTEGER)''')} "
    "AS date FROM customer",
)
def _(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    return rp.assign_sequential_dates(customers, ["c_custkey"], dt.date(2001, 8, 1))


@query(
    "p6_o6_promoted_measures",
    "SELECT p_type, sum(CAST(p_retailprice AS DECIMAL(18,4)))::DOUBLE AS revenue, "
    "sum(p_size) AS orders FROM part GROUP BY p_type",
)
def _(spark, folder):
    parts = table(spark, folder, "part").select("p_type", "p_size", "p_retailprice")
    return rp.ensure_measures(parts).groupBy("p_type").agg(
        ru.exact_sum("revenue").alias("revenue"), F.sum("orders").alias("orders")
    )


@query(
    "p15_nonempty_guard",
    "SELECT count(*) AS n FROM events",
)
def _(spark, folder):
    events = rp.require_rows(table(spark, folder, "events"), "no events")
    return events.agg(F.count("*").alias("n"))


@query(
    "p21_finite_or_null",
    f"SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount <> 0) AS finite, "
    f"{q.rnd('avg(l_tax / l_discount) FILTER (l_discount <> 0)', 6)} AS mean_ratio "
    "FROM lineitem GROUP BY l_returnflag",
)
def _(spark, folder):
    ratio = F.when(
        F.col("l_discount") == 0,
        F.when(F.col("l_tax") == 0, float("nan")).otherwise(float("inf")),
    ).otherwise(F.col("l_tax") / F.nullif(F.col("l_discount"), F.lit(0.0)))
    clean = finite_or_null(ratio)
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.count(clean).alias("finite"),
        half_even(F.avg(clean), 6).alias("mean_ratio"),
    )


@query(
    "p23_holiday_flag",
    f"SELECT {q.iso('o_orderdate')} AS date, count(*) AS n FROM orders "
    f"WHERE month(o_orderdate) * 100 + day(o_orderdate) IN ({q.HOLIDAY_CODES}) GROUP BY 1",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    holidays = orders.filter(rp.holiday_flag(F.col("date"), HOLIDAYS) == 1)
    return holidays.groupBy("date").agg(F.count("*").alias("n"))


# --- sources and sinks ----------------------------------------------------------------


def exported(spark, folder, separator: str, encoding: str = "UTF-8") -> str:
    """Orders with customer names, written as delimited text."""
    path = f"{work_folder(spark, 'export')}.csv"
    orders = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("o_totalprice").cast("string").alias("Sales"),
        F.regexp_replace("o_orderpriority", "E", "É").alias("Channel"),
        F.col("o_orderstatus").alias("Product Type"),
    )
    rw.write_csv(orders, path, separator, encoding)
    return path


EXPORT_SQL = """SELECT replace(o_orderpriority, 'E', 'É') AS channel, count(*) AS n,
  sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE AS revenue FROM orders GROUP BY 1"""


def by_channel(df: DataFrame) -> DataFrame:
    return df.groupBy("channel").agg(
        F.count("*").alias("n"),
        ru.exact_sum(F.col("revenue").cast("double")).alias("revenue"),
    )


@query("s1_s9_csv_utf8", EXPORT_SQL)
def _(spark, folder):
    return by_channel(rp.map_columns(rw.read_any(spark, exported(spark, folder, ","))))


@query("s2_csv_latin1_tab", EXPORT_SQL)
def _(spark, folder):
    path = exported(spark, folder, "\t", "ISO-8859-1")
    return by_channel(rp.map_columns(rw.read_any(spark, path)))


@query("s3_csv_semicolon", EXPORT_SQL)
def _(spark, folder):
    return by_channel(rp.map_columns(rw.read_any(spark, exported(spark, folder, ";"))))


@query("s3_csv_pipe", EXPORT_SQL)
def _(spark, folder):
    return by_channel(rp.map_columns(rw.read_any(spark, exported(spark, folder, "|"))))


@query(
    "s4_load_fact",
    f"""SELECT {q.iso('o_orderdate')} AS date, replace(o_orderpriority, 'E', 'É') AS channel,
    o_orderstatus AS category, 'Unknown' AS region,
    sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE AS revenue, count(*)::DOUBLE AS orders
    FROM orders GROUP BY ALL""",
)
def _(spark, folder):
    fact = rw.load_fact(spark, exported(spark, folder, ";"))
    return fact.groupBy("date", "channel", "category", "region").agg(
        ru.exact_sum("revenue").alias("revenue"), F.sum("orders").alias("orders")
    )


@query(
    "s1_s2_folder_of_mixed_files",
    """SELECT replace(o_orderpriority, 'E', 'É') AS channel, count(*) AS n,
    sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE AS revenue,
    sum(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END)::DOUBLE AS orders,
    count(*) FILTER (o_orderkey % 10 = 1) AS malformed FROM orders GROUP BY 1""",
)
def _(spark, folder):
    # two kinds of files in one folder: other column order, separator and encoding; some rows have a field too many
    path = f"{work_folder(spark, 'mixed')}.csv"
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("o_totalprice").cast("string").alias("Sales"),
        F.regexp_replace("o_orderpriority", "E", "É").alias("Channel"),
        F.col("o_custkey").cast("string").alias("Units"),
    )
    even, odd = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    options = {"header": True, "sep": ";", "encoding": "ISO-8859-1"}
    even.select("Units", "Channel", "Order Date", "Sales").write.options(**options).csv(path)
    extra = F.when(F.col("o_orderkey") % 10 == 1, F.concat("Channel", F.lit(",left over"))).otherwise(F.col("Channel"))
    line = F.concat_ws(",", "Order Date", "Sales", extra)
    odd.select(under_header("Order Date,Sales,Channel", line)).write.mode("append").text(path)
    raw = rp.map_columns(rw.read_any(spark, path))
    return raw.groupBy("channel").agg(
        F.count("*").alias("n"),
        ru.exact_sum(F.col("revenue").cast("double")).alias("revenue"),
        F.sum(F.coalesce(rp.number_in(raw, "orders"), F.lit(0.0))).alias("orders"),
        F.count("_malformed").alias("malformed"),
    )


@query(
    "s1_line_breaks_in_quotes",
    """SELECT o_orderpriority AS channel, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE AS revenue,
    sum(length(o_orderpriority || chr(10) || 'key "' || o_orderkey || '",' || repeat(chr(10), CAST(o_orderkey % 3 AS INTEGER))))::BIGINT AS signs,
    count(*) FILTER (o_orderkey % 3 = 2) AS blank_ends FROM orders GROUP BY 1""",
)
def _(spark, folder):
    path = f"{work_folder(spark, 'breaks')}.csv"
    more = F.repeat(F.lit("\n"), (F.col("o_orderkey") % 3).cast("int"))
    note = F.concat("o_orderpriority", F.lit('\nkey "'), F.col("o_orderkey").cast("string"), F.lit('",'), more)
    orders = table(spark, folder, "orders").select(note.alias("Note"), F.col("o_totalprice").alias("Sales"), "o_orderpriority")
    orders.withColumnRenamed("o_orderpriority", "Channel").write.options(
        header=True, escape='"', ignoreTrailingWhiteSpace=False
    ).csv(path)
    raw = rp.map_columns(rw.read_any(spark, path))
    return raw.groupBy("channel").agg(
        F.count("*").alias("n"),
        ru.exact_sum(F.col("revenue").cast("double")).alias("revenue"),
        F.sum(F.length("Note")).alias("signs"),
        F.count_if(F.endswith("Note", F.lit("\n\n"))).alias("blank_ends"),
    )


@query(
    "s2_utf16_without_mark",
    """SELECT o_orderpriority || '漢é' AS channel, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE AS revenue
    FROM orders GROUP BY 1""",
)
def _(spark, folder):
    path = work_folder(spark, "wide")
    orders = table(spark, folder, "orders").select(
        F.concat("o_orderpriority", F.lit("漢é")).alias("Channel"), F.col("o_totalprice").alias("Sales"), "o_orderkey"
    )
    for i, encoding in enumerate(("UTF-16LE", "UTF-16BE", "UTF-8")):
        orders.where(F.col("o_orderkey") % 3 == i).write.options(header=True, encoding=encoding).csv(f"{path}/{encoding}.csv")
    raw = rp.map_columns(rw.read_any(spark, f"{path}/*.csv"))
    return raw.groupBy("channel").agg(F.count("*").alias("n"), ru.exact_sum(F.col("revenue").cast("double")).alias("revenue"))


@query(
    "p3_duplicate_headers",
    """SELECT o_orderstatus AS region, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE AS revenue,
    sum(o_custkey) AS second, sum(o_orderkey) AS third FROM orders GROUP BY 1""",
)
def _(spark, folder):
    path = f"{work_folder(spark, 'twice')}.csv"
    orders = table(spark, folder, "orders")
    cells = [F.col(c).cast("string") for c in ("o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey")]
    orders.select(under_header("Sales,Region,Sales,SALES", F.concat_ws(",", *cells))).write.text(path)
    raw = rp.map_columns(rw.read_any(spark, path))
    return raw.groupBy("region").agg(
        F.count("*").alias("n"),
        ru.exact_sum(F.col("revenue").cast("double")).alias("revenue"),
        F.sum(F.col("Sales_1").cast("bigint")).alias("second"),
        F.sum(F.col("SALES_2").cast("bigint")).alias("third"),
    )


@query(
    "s4_p5_undated_file",
    f"""SELECT {q.iso("DATE '2001-08-01' - CAST(count(*) OVER () - row_number() OVER (ORDER BY c_custkey) AS INTEGER)")} AS date,
    c_mktsegment AS campaign, c_acctbal AS revenue, 1.0::DOUBLE AS orders FROM customer""",
)
def _(spark, folder):
    path = f"{work_folder(spark, 'undated')}.csv"
    customers = table(spark, folder, "customer").select(
        F.format_string("C%012d", "c_custkey").alias("key"), F.col("c_mktsegment").alias("campaign"), F.col("c_acctbal").alias("Amount")
    )
    rw.write_csv(customers, path)
    return rw.load_fact(spark, path, dt.date(2001, 8, 1), ["key"]).select("date", "campaign", "revenue", "orders")


SNAPSHOT_DAY = dt.date(2001, 8, 2)


def snapshot(spark, folder) -> str:
    path = work_folder(spark, "raw")
    fact = star_fact(spark, folder, ("date", "revenue", "orders", "impressions", "inventory_status"))
    rw.write_snapshot(fact, path, SNAPSHOT_DAY)
    return path


@query(
    "s5_s6_raw_snapshot",
    f"{FACTS} SELECT '2001-08-02' AS ingest_date, inventory_status, count(*) AS n, "
    "sum(revenue)::DOUBLE AS revenue, sum(impressions) AS impressions FROM fact GROUP BY ALL",
)
def _(spark, folder):
    stored = rw.load_snapshot(spark, snapshot(spark, folder))
    return stored.groupBy("ingest_date", "inventory_status").agg(
        F.count("*").alias("n"),
        F.sum("revenue").alias("revenue"),
        F.sum("impressions").alias("impressions"),
    )


@query(
    "s7_processed_by_month",
    f"{FACTS}, {q.ROLLED} SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, "
    "sum(revenue)::DOUBLE AS revenue FROM rolled GROUP BY 1",
)
def _(spark, folder):
    path = work_folder(spark, "processed")
    rw.write_processed(ru.roll_up(star_fact(spark, folder)), path)
    return (
        rw.read_processed(spark, path)
        .groupBy(F.date_format("date", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue"))
    )


def _dropped_after(result: DataFrame, name: str) -> DataFrame:
    """Store a result and drop the table it came from, so a query leaves nothing in the catalog."""
    kept = stored(result, "result")
    result.sparkSession.sql(f"DROP TABLE {name}")
    return kept


@query(
    "s11_s12_external_table",
    "SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS value "
    "FROM events GROUP BY event_type",
)
def _(spark, folder):
    path = work_folder(spark, "events")
    table(spark, folder, "events").write.parquet(path)
    base = f"tallyveer_{path.rsplit('-', 1)[1]}"
    name = f"{base}.events"
    cat.create_database(spark, base, work_folder(spark, "db"))
    cat.register_table(
        spark, name, path,
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string",
    )
    result = cat.query(
        spark,
        "SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS value "
        f"FROM {name} GROUP BY event_type",
    )
    kept = _dropped_after(result, name)
    spark.sql(f"DROP DATABASE {base}")
    return kept


@query(
    "s13_o5_sql_query",
    "SELECT l_orderkey, l_linenumber, l_extendedprice AS price, true AS cut FROM lineitem "
    "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5000",
)
def _(spark, folder):
    view = f"lines_{work_folder(spark, 'view').rsplit('-', 1)[1]}"
    table(spark, folder, "lineitem").createOrReplaceTempView(view)
    result = cat.query(
        spark, f"SELECT l_orderkey, l_linenumber, l_extendedprice AS price, -l_extendedprice AS down FROM {view}"
    )
    spark.catalog.dropTempView(view)  # the result is bound to the table already
    return cat.first_rows(result, 5000, ["down", "l_orderkey", "l_linenumber"]).drop("down")


@query(
    "s13_sql_query_whole",
    "SELECT l_returnflag, l_linestatus, l_orderkey % 100 AS slot, count(*) AS n, "
    "sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE AS price FROM lineitem GROUP BY ALL",
)
def _(spark, folder):
    return cat.query(
        spark,
        "SELECT l_returnflag, l_linestatus, l_orderkey % 100 AS slot, count(*) AS n, "
        f"sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS price FROM parquet.`{folder.rstrip('/')}/lineitem.parquet` GROUP BY ALL",
    )


@query(
    "s15_retention",
    f"SELECT event_type, count(*) AS n, {q.iso('min(ts)')} AS first_date FROM events "
    "WHERE CAST(ts AS DATE) > DATE '2024-01-30' - 7 GROUP BY event_type",
)
def _(spark, folder):
    events = table(spark, folder, "events").withColumn("ingest_date", F.col("ts").cast("date"))
    kept = cat.retained(events, cat.RETENTION_DAYS["processed"], dt.date(2024, 1, 30))
    return kept.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("ingest_date").alias("first_date")
    )


@query(
    "s15_drop_expired_partitions",
    f"SELECT {q.iso('ts')} AS ingest_date, count(*) AS n FROM events "
    "WHERE CAST(ts AS DATE) > DATE '2024-01-30' - 7 GROUP BY 1",
)
def _(spark, folder):
    path = work_folder(spark, "retain")
    name = f"retain_{path.rsplit('-', 1)[1]}"
    events = table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("ingest_date")
    )
    events.write.partitionBy("ingest_date").option("path", path).saveAsTable(name)
    cat.drop_expired(spark, name, cat.RETENTION_DAYS["processed"], dt.date(2024, 1, 30))
    return _dropped_after(spark.table(name).groupBy("ingest_date").agg(F.count("*").alias("n")), name)


@query(
    "s16_purge_run",
    "SELECT event_type AS run_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def _(spark, folder):
    path = work_folder(spark, "purge")
    name = f"purge_{path.rsplit('-', 1)[1]}"
    runs = table(spark, folder, "events").select("event_id", F.col("event_type").alias("run_id"))
    runs.write.partitionBy("run_id").option("path", path).saveAsTable(name)
    cat.purge_run(spark, name, "error")
    kept = spark.table(name).groupBy("run_id").agg(F.count("*").alias("n"))
    return _dropped_after(kept, name)


# --- profiling ------------------------------------------------------------------------

PROFILED = {"lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")}


def _profile_sql(name: str, columns: tuple[str, ...], numeric: set[str]) -> str:
    parts = []
    for c in columns:
        stats = (
            f"min({c})::DOUBLE, max({c})::DOUBLE, "
            f"{q.rnd(f'sum(CAST({c} AS DECIMAL(28,4)))::DOUBLE / count({c})', 6)}"
            if c in numeric
            else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
        )
        parts.append(
            f"SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), {stats} FROM {name}"
        )
    return (
        "SELECT * FROM (" + " UNION ALL ".join(parts) + ") AS t(\"column\", \"rows\", nulls, "
        "distinct_values, min_value, max_value, mean_value)"
    )


@query(
    "x1_profile",
    _profile_sql(
        "lineitem", PROFILED["lineitem"], {"l_quantity", "l_extendedprice", "l_discount"}
    ),
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(*PROFILED["lineitem"])
    profile = ins.profile_columns(lines, exact_distinct=True)
    return profile.withColumn("mean_value", half_even(F.col("mean_value"), 6))


@query(
    "x1_profile_approximate",
    "SELECT t.\"column\", count(*) AS \"rows\", count(*) - count(v) AS nulls, true AS close FROM lineitem, "
    + "LATERAL (VALUES "
    + ", ".join(f"('{c}', CAST({c} AS VARCHAR))" for c in ("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag"))
    + ") AS t(\"column\", v) GROUP BY 1",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")
    exact = ins.profile_columns(lines, exact_distinct=True).select("column", F.col("distinct_values").alias("true_values"))
    # the sketch promises a standard error of five percent
    near = F.abs(F.col("distinct_values") - F.col("true_values")) <= 0.15 * F.col("true_values")
    return ins.profile_columns(lines).join(exact, "column").select("column", "rows", "nulls", near.alias("close"))


LEVELS = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(
    "x1_quantiles",
    "SELECT l_returnflag, level, true AS near FROM (SELECT DISTINCT l_returnflag FROM lineitem) "
    "CROSS JOIN (VALUES (0.01::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.99::DOUBLE)) AS t(level)",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    found = ins.quantiles(lines, "l_extendedprice", ["l_returnflag"], LEVELS)
    below = F.avg((F.col("l_extendedprice") < F.col("value")).cast("double"))
    upto = F.avg((F.col("l_extendedprice") <= F.col("value")).cast("double"))
    # the rank of each quantile is off by one in ten thousand at most
    ranks = lines.join(found, "l_returnflag").groupBy("l_returnflag", "level").agg(below.alias("a"), upto.alias("b"))
    near = (F.col("a") <= F.col("level") + 2e-3) & (F.col("b") >= F.col("level") - 2e-3)
    return ranks.select("l_returnflag", "level", near.alias("near"))


@query(
    "x1_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25::DOUBLE) AS q1, quantile_cont(value, 0.75::DOUBLE) AS q3 FROM events GROUP BY 1),
    f AS (SELECT event_type, q1 - (q3 - q1) * 0.25::DOUBLE AS low, q3 + (q3 - q1) * 0.25::DOUBLE AS high FROM q)
    SELECT event_type, 'value' AS "column", count(*) FILTER (value < low) AS below, count(*) FILTER (value > high) AS above,
      count(*) FILTER (value < low OR value > high) / count(value)::DOUBLE AS share, low AS low_fence, high AS high_fence
    FROM events JOIN f USING (event_type) GROUP BY ALL""",
)
def _(spark, folder):
    events, by = table(spark, folder, "events"), ["event_type"]
    return sk.outliers(events, sk.exact_fences(events, ["value"], by, 0.25), ["value"], by)


SKETCHED = ("l_orderkey", "l_extendedprice", "l_quantity", "l_returnflag")


@query(
    "x1_merged_sketches",
    "SELECT t.\"column\", count(*) AS \"rows\", count(*) - count(v) AS nulls, min(n) AS smallest, max(n) AS largest, true AS distinct_near, "
    "CASE WHEN count(n) > 0 THEN true END AS quartiles_near, CASE WHEN count(n) > 0 THEN true END AS outliers_near FROM lineitem, LATERAL (VALUES "
    + ", ".join(
        f"('{c}', CAST({c} AS VARCHAR), {'NULL' if c == 'l_returnflag' else c}::DOUBLE)" for c in SKETCHED
    )
    + ") AS t(\"column\", v, n) GROUP BY 1",
)
def _(spark, folder):
    lines, path = table(spark, folder, "lineitem").select(*SKETCHED), work_folder(spark, "sketches")
    # a run per flag, as if they had come on different days
    for flag in ("A", "N", "R"):
        sk.add_run(lines.where(F.col("l_returnflag") == flag), path, flag, SKETCHED)
    found = sk.profile(sk.read_runs(spark, path), 0.25)
    exact = ins.profile_columns(lines, exact_distinct=True).select("column", F.col("distinct_values").alias("true_values"))
    sure = sk.exact_fences(lines, SKETCHED, reach=0.25)
    counted = sk.outliers(lines, found, SKETCHED).select("column", F.col("share").alias("share"))
    true = sk.outliers(lines, sure, SKETCHED).select("column", F.col("share").alias("true_share"))
    levels = sure.select("column", *[F.col(c).alias(f"true_{c}") for c in ("q1", "median", "q3")])
    both = found.join(exact, "column").join(levels, "column").join(counted, "column").join(true, "column")
    spread = F.col("largest") - F.col("smallest")
    near = [F.abs(F.col(c) - F.col(f"true_{c}")) <= 0.03 * spread for c in ("q1", "median", "q3")]
    return both.select(
        "column", "rows", "nulls", "smallest", "largest",
        (F.abs(F.col("distinct_values") - F.col("true_values")) <= 0.08 * F.col("true_values")).alias("distinct_near"),
        (near[0] & near[1] & near[2]).alias("quartiles_near"),
        F.when(F.col("q1").isNotNull(), F.abs(F.col("share") - F.col("true_share")) <= 0.05).alias("outliers_near"),
    )


@query(
    "x2_near_duplicate_rows",
    """WITH RECURSIVE base AS (
      SELECT c_custkey AS id, substr(md5('n' || c_custkey), 1, 14) AS name, substr(md5('s' || c_custkey), 1, 12) AS street, c_acctbal AS balance
      FROM customer),
    people AS (
      SELECT * FROM base
      UNION ALL SELECT id + 10000000, CASE WHEN id % 3 = 0 THEN name[1:5] || 'x' || name[7:] ELSE name END,
        CASE WHEN id % 3 = 1 THEN street || 'y' ELSE street END, CASE WHEN id % 3 = 2 THEN balance * 1.01::DOUBLE ELSE balance END
      FROM base WHERE id % 5 = 0
      UNION ALL SELECT id + 20000000, name, street, balance FROM base WHERE id % 7 = 0),
    near AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, (
        1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::DOUBLE
        + 1 - levenshtein(a.street, b.street) / greatest(length(a.street), length(b.street))::DOUBLE
        + CASE WHEN greatest(abs(a.balance), abs(b.balance)) = 0 THEN 1
               ELSE greatest(0, 1 - abs(a.balance - b.balance) / greatest(abs(a.balance), abs(b.balance))) END) / 3 AS likeness
      FROM people a JOIN people b ON a.id <> b.id AND length(a.name) + length(b.name) > 0
        AND abs(a.balance - b.balance) <= 0.45::DOUBLE * greatest(abs(a.balance), abs(b.balance)))
      WHERE likeness >= 0.85),
    reach(id, other) AS (SELECT a, b FROM near UNION SELECT r.id, n.b FROM reach r JOIN near n ON r.other = n.a)
    SELECT p.id, least(p.id, coalesce((SELECT min(other) FROM reach r WHERE r.id = p.id), p.id)) AS class,
      1 + (SELECT count(*) FROM near n WHERE n.a = p.id AND likeness = 1) AS copies FROM people p""",
)
def _(spark, folder):
    key = F.col("c_custkey")
    base = table(spark, folder, "customer").select(
        key.alias("id"),
        F.substring(F.md5(F.concat(F.lit("n"), key.cast("string"))), 1, 14).alias("name"),
        F.substring(F.md5(F.concat(F.lit("s"), key.cast("string"))), 1, 12).alias("street"),
        F.col("c_acctbal").alias("balance"),
    )
    name = F.concat(F.substring("name", 1, 5), F.lit("x"), F.substring("name", 7, 20))
    edited = base.where("id % 5 = 0").select(
        (F.col("id") + 10_000_000).alias("id"),
        F.when(F.col("id") % 3 == 0, name).otherwise(F.col("name")).alias("name"),
        F.when(F.col("id") % 3 == 1, F.concat("street", F.lit("y"))).otherwise(F.col("street")).alias("street"),
        F.when(F.col("id") % 3 == 2, F.col("balance") * 1.01).otherwise(F.col("balance")).alias("balance"),
    )
    again = base.where("id % 7 = 0").withColumn("id", F.col("id") + 20_000_000)
    people = stored(base.union(edited).union(again), "people")
    return sm.near_duplicate_rows(people, "id", ["name", "street"], ["balance"]).drop("links")


@query(
    "x2_duplicates",
    "SELECT count(*) AS duplicated_rows, coalesce(sum(copies - 1), 0)::BIGINT AS surplus_rows FROM "
    "(SELECT l_quantity, l_discount, l_returnflag, l_shipdate, count(*) AS copies FROM lineitem "
    "GROUP BY ALL HAVING count(*) > 1)",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_quantity", "l_discount", "l_returnflag", "l_shipdate"
    )
    return ins.duplicate_summary(lines)
