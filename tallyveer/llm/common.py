"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch: long texts must not meet in a batch by the thousand.
BATCH_ROWS = 512

#: Blank characters that part words, as contracts name them.
BLANKS = " \t\n\x0b\f\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python functions get, and name this checkout to the workers.

    Executors that do not see the checkout need the package from ``--py-files`` as usual.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    here, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(":") if p]
    if here not in paths:
        known["PYTHONPATH"] = ":".join([*paths, here])
    return spark


def field(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors reach.

    Only a local session that has no such setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyveer-llm-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has none."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def held_out(key: Column, modulus: int, value: int) -> Column:
    """True for rows kept from training; a row without id is never held out."""
    return F.coalesce(remainder(key, modulus) == value, F.lit(False))


def sample_order(key: Column) -> Column:
    """Order of a bounded sample: fixed by the id, unrelated to its size."""
    return F.xxhash64(key)


class Taken:
    """Stretches of a text that are taken: asking for an overlap costs a search, whatever their number."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)  # the last stretch that begins before b ends latest of them
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        """Take a stretch that overlaps none."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)

    def free(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """What is left of a stretch."""
        i = bisect_right(self.ends, a)
        while a < b:
            if i == len(self.starts) or self.starts[i] >= b:
                yield a, b
                return
            if a < self.starts[i]:
                yield a, self.starts[i]
            a, i = max(a, self.ends[i]), i + 1


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the groups of each pair of rows (a, b) are one; a group is named by its smallest row."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        low = np.arange(len(label))
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, shorter := low[low]):
            low = shorter
        label = low[label]
    return label


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of each component.

    ``edges`` has columns ``a`` and ``b``; the result has a row ``node, label`` for every node of an edge between two
    different nodes. Large-star and small-star steps hang each node under the smallest neighbour known; they move
    single edges only, so a node with any number of links costs a map-side minimum and a join that AQE may split.
    Every round is written to the shared folder; the rounds end when a round changes nothing.
    """
    pairs = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    pairs = stored(pairs.where("hi <> lo").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u moves under the least node around u
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = stored(moved.where("hi <> lo").distinct(), "large-star")
        # small star: u and its smaller neighbours move under the least of them
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        down = large.join(small, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = down.where("hi <> lo").union(small.select("hi", F.col("m").alias("lo"))).distinct()
        pairs = stored(pairs, "small-star")
        state = pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.count_if(F.col("hi") <= F.col("lo"))
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(roots)


def per_batch(make: Callable[[], Callable[[list], Iterable[tuple]]], returns: str):
    """Arrow-batched column function: ``make()`` once per task gives values -> a tuple of the struct ``returns`` each.

    Keys and other columns stay in the JVM. Batches are bounded by ``BATCH_ROWS``; nothing is kept between them.
    """
    names = [f.name for f in T.StructType.fromDDL(returns).fields]

    def run(batches):
        many = make()
        for values in batches:
            yield pd.DataFrame.from_records(list(many(values.tolist())), columns=names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, returns)


def per_text(make: Callable[[], Callable[[str], tuple]], returns: str):
    """As ``per_batch`` for one text at a time; a null text counts as empty."""

    def lifted():
        one = make()
        return lambda texts: (one(t or "") for t in texts)

    return per_batch(lifted, returns)


def scored(docs: DataFrame, function, key: str, column: str) -> DataFrame:
    """The key and the fields of ``function`` over ``column``."""
    out = docs.select(field(key).alias("key"), function(field(column)).alias("found"))
    return out.select(F.col("key").alias(key), "found.*")
