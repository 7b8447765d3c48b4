"""Drivers over combinations of dimensions: a lattice search with safe pruning.

Facts of both windows are summed to cells, one per combination of all dimensions. A *group* fixes some dimensions. Level by level,
groups of one dimension, of two, and so on get their change and their movement, the sum of the absolute changes of their cells. No
part of a group can change by more than the group's movement, so a group whose movement stays below the cut-off has no part worth a
look: a level only builds groups all of whose parents moved enough. What is left out that way is exactly what the cut-off would
leave out.

A group *carries* a parent if it holds most of its change. A *cause* is a group that carries all its parents and is not carried by
a part of its own that reaches the cut-off: the narrowest description of where the change sits.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig
from tallyveer.functions import attach
from tallyveer.operators.attribute import comparison_slice
from tallyveer.operators.rollup import exact_sum
from tallyveer.operators.series import FactSource
from tallyveer.schema import UNKNOWN
from tallyveer.session import stored

#: A group carries a parent with this part of its change or more.
CARRIES = 0.8
#: Name of the group that sums up what a set of dimensions has left out.
OTHERS = "(others)"


def cells(source: FactSource, cfg: AnalysisConfig, dimensions: Sequence[str]) -> DataFrame:
    """``(*keys, cell, values, change)``: the change of revenue of every combination of all dimensions."""
    keys = list(cfg.series_keys)
    wanted = list(dict.fromkeys([*keys, *dimensions]))
    sliced = comparison_slice(source, cfg, ["date", *wanted, "revenue"])
    sums = sliced.groupBy(*wanted).agg(
        exact_sum(F.when(F.col("is_current"), F.col("revenue")).otherwise(-F.col("revenue"))).alias("change")
    )
    values = F.array(*[F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)) for d in dimensions])
    found = sums.select(*keys, values.alias("values"), F.col("change").cast("decimal(38,4)").alias("change"))
    return stored(found.withColumn("cell", F.monotonically_increasing_id()), "cells")


def name_of(places: Sequence[int], dimensions: Sequence[str]) -> str:
    return ",".join(dimensions[i] for i in places)


def _members(rows: DataFrame, dimensions: Sequence[str], depth: int, keys: list[str]) -> DataFrame:
    """A row per cell and group of ``depth`` dimensions that it belongs to, if all parents of the group are in ``alive``."""
    groups = []
    for places in combinations(range(len(dimensions)), depth):
        fixed = F.array(*[F.get("values", F.lit(i)) for i in places])
        group = F.struct(F.lit(name_of(places, dimensions)).alias("dimensions"), fixed.alias("group"))
        if depth > 1:
            parents = [name_of(p, dimensions) for p in combinations(places, depth - 1)]
            whole = F.array_contains("alive", parents[0])
            for p in parents[1:]:
                whole = whole & F.array_contains("alive", p)
            group = F.when(whole, group)
        groups.append(group)
    return rows.select(*keys, "cell", "values", "change", F.inline(F.array_compact(F.array(*groups))))


def lattice(
    source: FactSource, cfg: AnalysisConfig, dimensions: Sequence[str] | None = None, depth: int = 3
) -> DataFrame:
    """``(*keys, depth, dimensions, group, change, movement, total)`` of every group that moved by the cut-off or more."""
    dims, keys = list(dimensions or cfg.dimensions), list(cfg.series_keys)
    base = cells(source, cfg, dims)
    totals = stored(base.groupBy(*keys).agg(F.sum("change").cast("decimal(38,4)").alias("total")), "cell-totals")
    enough = F.abs("total") * F.lit(cfg.min_share_pct / 100.0).cast("decimal(18,6)")
    found, rows = None, base
    for level in range(1, min(depth, len(dims)) + 1):
        members = _members(rows, dims, level, keys)
        sums = members.groupBy(*keys, "dimensions", "group").agg(
            F.sum("change").cast("decimal(38,4)").alias("change"), F.sum(F.abs("change")).cast("decimal(38,4)").alias("movement")
        )
        alive = attach(sums, totals, keys).where((F.col("movement") >= enough) & (F.col("total") != 0))
        alive = stored(alive.withColumn("depth", F.lit(level)), f"groups-{level}")
        found = alive if found is None else found.unionByName(alive)
        if level < min(depth, len(dims)):
            left = members.join(alive.select(*keys, "dimensions", "group"), [*keys, "dimensions", "group"], "left_semi")
            known = left.groupBy(*keys, "cell").agg(
                F.first("values").alias("values"), F.first("change").alias("change"), F.collect_list("dimensions").alias("alive")
            )
            rows = stored(known, f"cells-{level}")
    return found


def _parents(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Every group beside each of its parents' names."""
    parted = F.split("dimensions", ",")
    places = F.sequence(F.lit(0), F.col("depth") - 1)

    def without(values: Column, at: Column) -> Column:
        return F.filter(values, lambda _, i: i != at)

    each = groups.where("depth > 1").select(
        *keys, "dimensions", "group", "change", "total", parted.alias("names"), F.explode(places).alias("at")
    )
    return each.select(
        *keys, "dimensions", "group", "change", "total",
        F.array_join(without(F.col("names"), F.col("at")), ",").alias("parent"),
        without(F.col("group"), F.col("at")).alias("parent_group"),
    )


def combination_drivers(
    source: FactSource, cfg: AnalysisConfig, dimensions: Sequence[str] | None = None, depth: int = 3
) -> DataFrame:
    """Groups of up to ``depth`` dimensions whose share of the change reaches the cut-off, and which of them are causes.

    ``part`` is the least part of a parent's change that the group holds (1 for single dimensions). For every set of dimensions a
    row :data:`OTHERS` sums up the rest, so shares of a set add up to 100.
    """
    keys = list(cfg.series_keys)
    groups = stored(lattice(source, cfg, dimensions, depth), "lattice")
    parents = groups.select(
        *keys, F.col("dimensions").alias("parent"), F.col("group").alias("parent_group"), F.col("change").alias("parent_change")
    )
    beside = _parents(groups, keys).join(parents, [*keys, "parent", "parent_group"])
    part = F.try_divide(F.col("change").cast("double"), F.col("parent_change").cast("double"))
    # a part larger than the parent's whole change is its opposite's doing, not the parent's narrower name
    beside = beside.withColumn("part", F.coalesce(F.when(part > 1, 1.0 / part).otherwise(part), F.lit(0.0)))
    parts = beside.groupBy(*keys, "dimensions", "group").agg(F.min("part").alias("part"))
    reaches = F.abs("change") >= F.abs("total") * F.lit(cfg.min_share_pct / 100.0).cast("decimal(18,6)")
    carried = beside.where((F.col("part") >= CARRIES) & reaches).select(
        *keys, F.col("parent").alias("dimensions"), F.col("parent_group").alias("group"), F.lit(True).alias("carried")
    )
    rated = groups.join(parts, [*keys, "dimensions", "group"], "left")
    rated = rated.join(carried.distinct(), [*keys, "dimensions", "group"], "left")
    share = F.col("change").cast("double") / F.col("total").cast("double") * 100.0
    rated = rated.withColumn("share", share).withColumn("part", F.coalesce("part", F.lit(1.0)))
    big = rated.where(F.abs("share") >= cfg.min_share_pct)
    listed = big.select(
        *keys, "depth", "dimensions", F.array_join("group", ",").alias("group"),
        F.col("change").cast("double").alias("delta"), "share", "part",
        ((F.col("part") >= CARRIES) & F.col("carried").isNull()).alias("cause"),
    )
    left = big.groupBy(*keys, "depth", "dimensions").agg(F.sum("change").alias("named"), F.max("total").alias("total"))
    rest = left.select(
        *keys, "depth", "dimensions", F.lit(OTHERS).alias("group"),
        (F.col("total") - F.col("named")).cast("double").alias("delta"),
        ((F.col("total") - F.col("named")).cast("double") / F.col("total").cast("double") * 100.0).alias("share"),
        F.lit(None).cast("double").alias("part"), F.lit(False).alias("cause"),
    )
    return listed.unionByName(rest)
