"""Running aggregates over ordered positions, without one task per key.

A plain window over (sample, contig) puts a whole contig into one task. Here
positions are cut into bins: each bin is scanned by itself, a small table with
one row per bin carries totals from bin to bin, and the two are combined. Rows
must be unique on (keys, order), so a bin never holds more than ``bin_size``
rows however skewed the keys are; pre-aggregate duplicates first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.session import stage

BIN = 16384

_FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, b * 0) + F.coalesce(b, a * 0)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    # nearest non-NULL value: the one inside the bin wins
    "near": (None, lambda a, b: F.coalesce(a, b)),
}


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``fold`` of ``expr`` over all earlier (or later) rows."""

    name: str
    fold: str
    expr: Column
    inclusive: bool = True
    backwards: bool = False


def running(df: DataFrame, keys: list[str], order: str, runs: list[Run], bin_size: int = BIN) -> DataFrame:
    """Add the running aggregates as columns."""
    binned = df.withColumn("_bin", F.floor(F.col(order) / F.lit(bin_size)).cast("long"))
    for i, run in enumerate(runs):
        binned = binned.withColumn(f"_x{i}", run.expr)
    binned = stage(binned)  # read twice: for the totals and for the rows
    cell = [*keys, "_bin"]
    first = Window.partitionBy(*cell).orderBy(F.col(order))
    last = Window.partitionBy(*cell).orderBy(F.col(order).desc())

    local, totals = [], []
    for i, run in enumerate(runs):
        value = F.col(f"_x{i}")
        frame = (last if run.backwards else first).rowsBetween(
            Window.unboundedPreceding, Window.currentRow if run.inclusive else -1
        )
        if run.fold == "near":
            local.append(F.last(value, ignorenulls=True).over(frame).alias(f"_l{i}"))
            by = F.when(value.isNotNull(), F.col(order))
            totals.append((F.min_by(value, by) if run.backwards else F.max_by(value, by)).alias(f"_t{i}"))
        else:
            fold = _FOLDS[run.fold][0]
            local.append(fold(value).over(frame).alias(f"_l{i}"))
            totals.append(fold(value).alias(f"_t{i}"))

    per_bin = binned.groupBy(*cell).agg(*totals)
    forward = Window.partitionBy(*keys).orderBy(F.col("_bin"))
    reverse = Window.partitionBy(*keys).orderBy(F.col("_bin").desc())
    carried = []
    for i, run in enumerate(runs):
        frame = (reverse if run.backwards else forward).rowsBetween(Window.unboundedPreceding, -1)
        fold = F.last(F.col(f"_t{i}"), ignorenulls=True) if run.fold == "near" else _FOLDS[run.fold][0](F.col(f"_t{i}"))
        carried.append(fold.over(frame).alias(f"_c{i}"))
    carry = per_bin.select(*cell, *carried)

    joined = binned.select("*", *local).join(carry, cell, "left")
    done = [
        _FOLDS[run.fold][1](F.col(f"_l{i}"), F.col(f"_c{i}")).alias(run.name) for i, run in enumerate(runs)
    ]
    return joined.select(*df.columns, *done)
