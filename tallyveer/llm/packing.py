"""Packing: length buckets that pad least, and batches of a token budget inside each bucket.

A histogram of lengths over all documents goes to the driver. Its size is bounded: lengths up to ``EXACT`` have a bin each,
longer ones share bins of a fixed relative width. Dynamic programming over the bins finds the bucket borders with the least
padding, where a bucket pads its documents to its longest one. Batches form inside a bucket: as many documents as the
budget allows at the bucket's length. A bucket is dealt into parts of bounded size, so no bucket meets in one task; each
part orders its documents and cuts batches, and only its last batch may be short.

A length is what ``length`` makes of the text: words between ASCII blanks, or, for scripts and data without blanks, ``by_bytes``.

Defined results: a null or blank text has length 0 and is packed in the bucket that holds length 0; a document over the budget
is a batch of its own; ties in length are ordered by id, equal ids by
their place in the table; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyveer.llm.common import BLANKS, field, stored

#: Lengths that have a bin of their own, and bins per doubling beyond them.
EXACT = 1024
PER_DOUBLING = 256
BUCKETS = 16
TOKEN_BUDGET = 16_384
#: UTF-8 bytes that count as a token where lengths go by bytes.
BYTES_PER_TOKEN = 4
#: Documents that one task orders, about.
PART_ROWS = 4096


def length_of(text: Column) -> Column:
    """Words between blanks."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def by_bytes(text: Column) -> Column:
    """Every four UTF-8 bytes or part of them: a length that does not need blanks."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / BYTES_PER_TOKEN).cast("long")


def bin_of(length: Column) -> Column:
    """Number of the bin, growing with the length."""
    beyond = F.floor(F.log2(length / F.lit(EXACT)) * PER_DOUBLING).cast("long")
    return F.when(length <= EXACT, length).otherwise(EXACT + 1 + beyond)


@dataclass(frozen=True)
class Buckets:
    """Per bucket: its last bin, its longest document and how many documents it has."""

    last_bins: tuple[int, ...]
    lengths: tuple[int, ...]
    rows: tuple[int, ...]
    padding: int


def best_buckets(bins: list[tuple[int, int, int, int]], buckets: int = BUCKETS) -> Buckets:
    """Borders with the least padding for bins of (number, rows, sum of lengths, longest length).

    ``cost[j]`` is the least padding of the bins before ``j`` with the buckets used so far; one more bucket that ends with bin
    ``j`` starts at the bin that adds least.
    """
    bins = sorted(bins)
    n = len(bins)
    if not n:
        return Buckets((), (), (), 0)
    rows = np.concatenate([[0], np.cumsum([b[1] for b in bins])]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum([b[2] for b in bins])]).astype(np.float64)
    longest = np.maximum.accumulate([b[3] for b in bins]).astype(np.float64)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    starts = []
    for _ in range(min(buckets, n)):
        after, start = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            total = cost[:j] + longest[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            start[j] = int(np.argmin(total))
            after[j] = total[start[j]]
        starts.append(start)
        cost = after
    borders, j = [], n
    for start in reversed(starts):
        borders.append(j)
        j = int(start[j])
    ends = borders[::-1]
    begins = [0, *ends[:-1]]
    return Buckets(
        tuple(int(bins[e - 1][0]) for e in ends),
        tuple(int(longest[e - 1]) for e in ends),
        tuple(int(rows[e] - rows[b]) for b, e in zip(begins, ends, strict=True)),
        int(cost[n]),
    )


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
    part_rows: int = PART_ROWS,
    length: Callable[[Column], Column] = length_of,
) -> DataFrame:
    """Id, length, bucket, bucket length, padding, batch (unique in the table) and place in the batch of each document."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType
    rows = docs.select(
        field(key).alias("id"), length(field(text)).alias("n_tokens"), F.monotonically_increasing_id().alias("row")
    )
    rows = stored(rows.withColumn("bin", bin_of(F.col("n_tokens"))), "packing-lengths")
    bins = rows.groupBy("bin").agg(F.count(F.lit(1)), F.sum("n_tokens"), F.max("n_tokens")).collect()
    plan = best_buckets([tuple(b) for b in bins], buckets)
    schema = "n_tokens long, bucket int, bucket_length long, padding long, batch_id string, place int"
    if not plan.last_bins:
        return spark.createDataFrame([], T.StructType([T.StructField(key, kind), *T.StructType.fromDDL(schema).fields]))

    def by_bucket(values: tuple[int, ...]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)

    # the first bucket whose last bin reaches the document's bin
    reached = [F.when(F.col("bin") > last, F.lit(1)).otherwise(F.lit(0)) for last in plan.last_bins]
    total = reached[0]
    for one in reached[1:]:
        total = total + one
    parts = tuple(-(-n // part_rows) for n in plan.rows)
    fitting = tuple(max(1, budget // max(length, 1)) for length in plan.lengths)
    rows = rows.withColumn("bucket", total).withColumns(
        {
            "part": F.pmod(F.xxhash64("row"), by_bucket(parts)),
            "bucket_length": by_bucket(plan.lengths),
            "fitting": by_bucket(fitting),
        }
    )
    ordered = Window.partitionBy("bucket", "part").orderBy("n_tokens", "id", "row")
    rows = rows.withColumn("at", F.row_number().over(ordered) - 1)
    number = F.floor(F.col("at") / F.col("fitting")).cast("string")
    return rows.select(
        F.col("id").alias(key),
        "n_tokens",
        "bucket",
        "bucket_length",
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
        F.concat_ws("-", F.col("bucket").cast("string"), F.col("part").cast("string"), number).alias("batch_id"),
        F.pmod(F.col("at"), F.col("fitting")).cast("int").alias("place"),
    )
