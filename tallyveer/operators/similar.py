"""Rows that are nearly the same: sorted neighbourhood, verified field by field, and the classes that the links make.

Exact copies are collapsed first, so no value of a sort key is hot because of them. For each blocking key the rows are numbered in its
order and every row meets the ``window`` rows after it: rows that agree at the beginning of one key stand close to each other, however
they differ elsewhere. Blocks of numbers have equal sizes, and the first rows of a block also go to the block before it,
so nothing is lost at borders. The work is rows x keys x window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.functions import quoted
from tallyveer.operators.order import numbered
from tallyveer.session import stored

#: Rows that a row is compared with, per blocking key.
WINDOW = 10
#: Rows of a block.
BLOCK = 4096
#: Mean likeness of the fields from which two rows are linked.
LEAST = 0.85


def likeness(a: Column, b: Column, numeric: bool) -> Column:
    """From 0 to 1: texts by edits per letter, numbers by their relative difference; null is like null alone."""
    if numeric:
        x, y = a.cast("double"), b.cast("double")
        larger = F.greatest(F.abs(x), F.abs(y))
        near = F.when(larger == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(x - y) / larger))
    else:
        x, y = F.lower(a.cast("string")), F.lower(b.cast("string"))
        longer = F.greatest(F.length(x), F.length(y))
        near = F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longer)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(near)


def default_keys(texts: Sequence[str], numbers: Sequence[str]) -> list[Column]:
    """One key per field, letters and digits of the field first and the other texts behind; and each text from its end."""

    def plain(name: str) -> Column:
        return F.regexp_replace(F.lower(F.coalesce(quoted(name).cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]", "")

    keys = []
    for name in texts:
        rest = [plain(t) for t in texts if t != name]
        keys.append(F.concat_ws(" ", plain(name), *rest))
        keys.append(F.concat_ws(" ", F.reverse(plain(name)), *rest))
    for name in numbers:
        # numbers as text of equal width, so that their order is the order of the key
        scaled = F.coalesce(quoted(name).cast("double"), F.lit(0.0)) + 1e15
        keys.append(F.concat_ws(" ", F.lpad(scaled.cast("decimal(22,4)").cast("string"), 24, "0"), *[plain(t) for t in texts]))
    return keys


def neighbours(rows: DataFrame, key: Column, window: int, block: int) -> DataFrame:
    """Pairs of rows at most ``window`` places apart in the order of ``key``, as ``a`` and ``b``."""
    fields = F.struct(*[quoted(c) for c in rows.columns])
    placed = numbered(rows.select(fields.alias("row"), key.alias("key")), [], [F.col("key"), F.col("row.id")], "place")
    at = F.floor((F.col("place") - 1) / block)
    early = (F.col("place") - 1) % block < window
    homes = F.array_compact(F.array(F.struct(at.alias("block"), F.lit(True).alias("own")), F.when(early, F.struct((at - 1).alias("block"), F.lit(False).alias("own")))))
    dealt = placed.select("row", "place", F.inline(homes))
    ahead = Window.partitionBy("block").orderBy("place").rowsBetween(1, window)
    met = dealt.withColumn("ahead", F.collect_list("row").over(ahead)).where("own")
    return met.select(F.col("row").alias("a"), F.explode("ahead").alias("b"))


def similar_pairs(
    df: DataFrame,
    key: str,
    texts: Sequence[str],
    numbers: Sequence[str] = (),
    keys: Sequence[Column] | None = None,
    window: int = WINDOW,
    least: float = LEAST,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b, likeness)`` between different rows, and which row stands for which: ``(key, id)`` for all rows.

    ``id`` is the smallest key among the exact copies of a row in the compared fields.
    """
    fields = [*texts, *numbers]
    kinds = {c: c in numbers for c in fields}
    copies = df.groupBy(*[quoted(c) for c in fields]).agg(F.min(quoted(key)).alias("id"))
    copies = stored(copies, "different-rows")
    named = copies.select("id", *[quoted(c).alias(f"_{i}") for i, c in enumerate(fields)])
    wide = df.select(quoted(key).alias("key"), *[quoted(c).alias(f"own_{i}") for i, c in enumerate(fields)])
    same = F.col("own_0").eqNullSafe(F.col("_0"))
    for i in range(1, len(fields)):
        same = same & F.col(f"own_{i}").eqNullSafe(F.col(f"_{i}"))
    members = wide.join(named, same).select("key", "id")
    found = None
    for one in keys or default_keys(texts, numbers):
        met = neighbours(copies.select("id", *[quoted(c) for c in fields]), one, window, block)
        scores = [likeness(F.col("a").getField(c), F.col("b").getField(c), kinds[c]) for c in fields]
        total = scores[0]
        for s in scores[1:]:
            total = total + s
        met = met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), (total / len(fields)).alias("likeness"))
        met = met.where(F.col("likeness") >= least)
        found = met if found is None else found.unionByName(met)
    pairs = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
    return stored(pairs.groupBy("a", "b").agg(F.max("likeness").alias("likeness")), "similar-pairs"), members


def classes(pairs: DataFrame) -> DataFrame:
    """``(id, class)`` of every row in a link: the smallest id it can be reached from.

    Each round a row takes the least class around it and then that class's own class, so ways halve; rounds end when one
    changes nothing. Every round is stored.
    """
    both = stored(pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a")), "links")
    known = stored(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("class")), "classes")
    while True:
        around = both.join(known.select(F.col("id").alias("other"), "class"), "other")
        around = around.groupBy("id").agg(F.min("class").alias("around"))
        near = known.join(around, "id").select("id", F.col("class").alias("before"), F.least("class", "around").alias("class"))
        roots = near.select(F.col("id").alias("root"), F.col("class").alias("further"))
        jumped = near.join(roots, near["class"] == roots["root"])
        fixed = stored(jumped.select("id", "before", F.least("class", "further").alias("class")), "classes")
        known = fixed.select("id", "class")
        if fixed.where(F.col("before") != F.col("class")).isEmpty():
            return known


def near_duplicate_rows(df: DataFrame, key: str, texts: Sequence[str], numbers: Sequence[str] = (), **options) -> DataFrame:
    """``(key, class, copies, links)`` of each row: its class, exact copies of it (itself included), rows linked with it.

    Rows of one class are exact copies or reach each other over links; options as of :func:`similar_pairs`.
    """
    pairs, members = similar_pairs(df, key, texts, numbers, **options)
    links = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    known = classes(pairs)
    counts = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    rated = counts.join(links, "id", "left").join(known, "id", "left")
    rated = rated.select("id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "id").alias("class"))
    return members.join(rated, "id").select(F.col("key").alias(key), "class", "copies", "links")
