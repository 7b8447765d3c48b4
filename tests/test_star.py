"""The star fact's shuffles follow the size of its tables."""

import datetime as dt
import re
from collections import Counter

import pytest

from tallyveer import session
from tallyveer.operators.rollup import roll_up_reduced
from tallyveer.sources.star import SCHEMAS, star_fact, stored_bytes, table_path

COLUMNS = ("date", "region", "product", "category", "campaign", "revenue", "orders")
SHUFFLES = ("spark.sql.shuffle.partitions", *session.READ_PER_TASK)


def write_star(spark, folder: str, lines: int) -> Counter:
    """Lines over ``lines / 4`` orders, a part with a tenth of them, one key that comes twice; the lines per group."""
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k % 97)
    orders = [(k, k % 50, "O", 1.0, day(k), "1-URGENT") for k in range(lines // 4)] + [(1, 7, "O", 1.0, day(1), "1-URGENT")]
    part_of = lambda i: 0 if i % 10 == 0 else i % 400
    tables = {
        "region": [(0, "ASIA"), (1, "EUROPE")],
        "nation": [(n, f"n{n}", n % 2) for n in range(4)],
        "customer": [(c, f"c{c}", c % 4, 0.0, f"segment{c % 3}") for c in range(50)],
        "part": [(p, f"part {p}", "b", f"type{p % 5}", 1, 1.0) for p in range(400)],
        "orders": orders,
        "lineitem": [(i // 4, part_of(i), 0, i % 4, 1.0, 10.0, 0.0, 0.0, "N", "O", day(i)) for i in range(lines)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(table_path(folder, name))
    buyers = {}
    for key, customer, *_ in orders:
        buyers.setdefault(key, []).append(customer)
    return Counter(
        (day(i // 4).date(), ("ASIA", "EUROPE")[c % 4 % 2], f"part {part_of(i)}", f"type{part_of(i) % 5}", f"segment{c % 3}")
        for i in range(lines) for c in buyers[i // 4]
    )


def shuffle_sizes(df) -> list[int]:
    return [int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\), ENSURE", df._jdf.queryExecution().executedPlan().toString())]


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_partitions_follow_the_tables(spark, tmp_path, monkeypatch, threshold):
    monkeypatch.setattr(session, "STORED_PER_PARTITION", 4096, raising=False)
    found = {}
    for lines in (2000, 16000):
        folder = str(tmp_path / str(lines))
        want = write_star(spark, folder, lines)
        before = {name: spark.conf.get(name) for name in SHUFFLES}
        with session.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": threshold}):
            rolled = roll_up_reduced(star_fact(spark, folder, COLUMNS))
            found[lines] = shuffle_sizes(rolled)
            got = {tuple(r)[:5]: (float(r.revenue), float(r.orders)) for r in rolled.collect()}
        assert got == {k: (10.0 * n, float(n)) for k, n in want.items()}
        size = sum(stored_bytes(spark, table_path(folder, t)) for t in ("lineitem", "orders", "customer", "part"))
        assert found[lines] and min(found[lines]) * 4096 >= size
        assert {name: spark.conf.get(name) for name in SHUFFLES} == before
    assert min(found[16000]) > min(found[2000])


def test_small_tables_keep_the_session(spark, data):
    assert star_fact(spark, data, COLUMNS).sparkSession is spark
    assert session.sized_session(spark, 0) is spark


def test_own_settings_are_taken_over(spark):
    mine = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "3",
        "spark.sql.session.timeZone": "Asia/Tokyo",
    }
    with session.settings(spark, mine):
        own = session.sized_session(spark, 1 << 30).conf
    assert own.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    assert own.get("spark.sql.shuffle.partitions") == own.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "128"
    assert session.byte_count(own.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == 1 << 20
    assert session.byte_count(own.get("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")) == 32 << 20


@pytest.mark.parametrize("text, size", [("64MB", 64 << 20), ("8m", 8 << 20), ("1048576b", 1 << 20), ("67108864", 64 << 20), ("2GiB", 2 << 30)])
def test_byte_counts(text, size):
    assert session.byte_count(text) == size


def test_stored_bytes(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(50).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    one, other = (stored_bytes(spark, str(tmp_path / f"{n}.parquet")) for n in "ab")
    assert one > 0 and stored_bytes(spark, str(tmp_path / "?.parquet")) == one + other
    assert stored_bytes(spark, str(tmp_path / "missing.parquet")) == 0
