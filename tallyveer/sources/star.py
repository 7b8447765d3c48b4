"""Canonical facts over the star-schema and event tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveer.operators.repair import holiday_flag, repair
from tallyveer.schema import FACT_COLUMNS, HOLIDAYS, MONEY, UNKNOWN
from tallyveer.session import sized_session, stored_bytes


# Known schemas spare a footer-reading job per table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(table_path(folder, name))


def star_fact(
    spark: SparkSession, folder: str, columns: Sequence[str] = FACT_COLUMNS
) -> DataFrame:
    """Order lines as canonical facts.

    Only the dimension tables behind the requested columns are joined, smaller
    tables onto orders first, so order lines are shuffled once per wide table.
    Strategies are left to Catalyst: tables under the broadcast threshold are
    broadcast, larger ones are sort-merged and split by AQE where a key is hot.
    The shuffles of the fact, and of what is derived from it, have partitions by
    the size of these tables, so that no task's sorts and sums grow with them.
    """
    wanted = set(columns)
    joined = ["lineitem", "orders"]
    joined += ["customer"] if wanted & {"region", "campaign"} else []
    joined += ["part"] if wanted & {"product", "category"} else []
    spark = sized_session(spark, sum(stored_bytes(spark, table_path(folder, t)) for t in joined))
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("channel"),
    )
    if wanted & {"region", "campaign"}:
        customer = table(spark, folder, "customer").select(
            "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("campaign")
        )
        if "region" in wanted:
            nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
            region = table(spark, folder, "region").select(
                "r_regionkey", F.col("r_name").alias("region")
            )
            places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            customer = customer.join(
                places, F.col("c_nationkey") == F.col("n_nationkey"), "left"
            )
        orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    lines = table(spark, folder, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner"
    )
    if wanted & {"product", "category"}:
        part = table(spark, folder, "part").select(
            "p_partkey", F.col("p_name").alias("product"), F.col("p_type").alias("category")
        )
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    discount = F.col("l_discount")
    available = {
        "date": F.col("date"),
        "revenue": (F.col("l_extendedprice") * (1 - discount)).cast(MONEY),
        "orders": F.lit(1.0),
        "impressions": F.col("l_quantity"),
        "inventory_status": F.coalesce("l_linestatus", F.lit(UNKNOWN)),
        "discount_band": F.when(discount == 0, "none")
        .when(discount <= 0.03, "low")
        .when(discount <= 0.07, "medium")
        .otherwise("high"),
        "holiday_flag": holiday_flag(F.col("date"), HOLIDAYS),
        "incident_flag": F.coalesce((F.col("l_returnflag") == "R").cast("double"), F.lit(0.0)),
    }
    return lines.filter(F.col("date").isNotNull()).select(
        *[
            available[c].alias(c)
            if c in available
            else F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c)
            for c in FACT_COLUMNS
            if c in wanted
        ]
    )


def star_source(spark: SparkSession, folder: str) -> Callable[[Sequence[str]], DataFrame]:
    """The star fact on demand: each pass joins only the tables its columns need."""
    return lambda columns: star_fact(spark, folder, columns)


def event_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Events as canonical facts: type is the category, value the revenue."""
    events = table(spark, folder, "events").select(
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("category"),
        F.col("value").alias("revenue"),
        F.lit(1.0).alias("orders"),
    )
    return repair(events)
