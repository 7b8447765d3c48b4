from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyveer.session import local_session

    session = local_session(cores=8, memory="6g", app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA


def day(i: int, start: dt.date = dt.date(2024, 1, 1)) -> dt.date:
    return start + dt.timedelta(days=i)


def facts(spark, rows: list[dict]):
    """Canonical fact from partial rows; what a row leaves out is repaired."""
    from pyspark.sql import types as T

    from tallyveer.operators.repair import repair
    from tallyveer.schema import FACT_SCHEMA

    names = [f.name for f in FACT_SCHEMA.fields]
    schema = T.StructType(FACT_SCHEMA.fields)
    table = [
        tuple(
            float(r[n]) if n in r and isinstance(r[n], int) else r.get(n) for n in names
        )
        for r in rows
    ]
    return repair(spark.createDataFrame(table, schema))


def series_facts(spark, values, **extra):
    """One row per day with the given revenues and one order each."""
    return facts(
        spark,
        [{"date": day(i), "revenue": float(v), "orders": 1.0, **extra} for i, v in enumerate(values)],
    )
