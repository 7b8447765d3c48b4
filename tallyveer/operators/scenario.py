"""What-if scenarios: scale and relabel facts where a condition holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.config import AnalysisConfig

# Factors add decimals, so scaled measures are summed with more of them.
SCALED = "decimal(28,8)"


@dataclass(frozen=True)
class Shock:
    """Where ``mask`` holds, multiply measures by ``factors`` and set ``labels``."""

    mask: Column
    factors: Mapping[str, float] = field(default_factory=dict)
    labels: Mapping[str, object] = field(default_factory=dict)


def apply_scenario(fact: DataFrame, shocks: Sequence[Shock]) -> DataFrame:
    """Apply shocks one after another; a later mask sees earlier labels."""
    for shock in shocks:
        # the mask is fixed before a label it reads may change
        fact = fact.withColumn("_hit", F.coalesce(shock.mask, F.lit(False)))
        changes = {
            c: F.when(F.col("_hit"), F.col(c).cast("double") * float(f)).otherwise(F.col(c))
            for c, f in shock.factors.items()
        }
        changes |= {
            c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c))
            for c, v in shock.labels.items()
        }
        fact = fact.withColumns(changes).drop("_hit")
    return fact


def compare_scenario(
    base: DataFrame, changed: DataFrame, by: Sequence[str], measure: str = "revenue"
) -> DataFrame:
    """Measure per group before and after, with the difference.

    Both sides are summed per group first and then added up side by side, so
    groups that only exist on one side stay.
    """

    def side(df: DataFrame, before: bool) -> DataFrame:
        total = F.coalesce(F.sum(F.col(measure).cast(SCALED)), F.lit(0)).cast("decimal(38,8)")
        zero = F.lit(0).cast("decimal(38,8)")
        sums = df.groupBy(*by).agg(total.alias("total"))
        return sums.select(
            *by,
            (F.col("total") if before else zero).alias("base"),
            (zero if before else F.col("total")).alias("scenario"),
        )

    both = side(base, True).unionByName(side(changed, False))
    return both.groupBy(*by).agg(
        F.sum("base").cast("double").alias("base"),
        F.sum("scenario").cast("double").alias("scenario"),
        (F.sum("scenario") - F.sum("base")).cast("double").alias("difference"),
    )


def run_scenario(
    fact: DataFrame, shocks: Sequence[Shock], by: Sequence[str], cfg: AnalysisConfig
) -> DataFrame:
    """Shock the fact and report the difference per group."""
    return compare_scenario(fact, apply_scenario(fact, shocks), [*cfg.series_keys, *by])
