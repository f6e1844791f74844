"""Sorting and picking: thin names over ``orderBy``, ``limit`` and ``max_by``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_paf(paf: DataFrame) -> DataFrame:
    return paf.orderBy("contig", "start")


def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of an order; planned as a distributed top-n."""
    return df.orderBy(*order).limit(n)


def argmax(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The row of highest ``order`` per key, as a partial aggregate."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*by, "_b.*")
