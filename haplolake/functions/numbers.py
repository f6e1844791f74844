"""Numeric helpers: rounding, phred, hypergeometric tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def half_up(value: Column) -> Column:
    """Round half up; a positive value is at least 1, anything else 0."""
    rounded = F.floor(value + 0.5).cast("long")
    return F.when(value <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), rounded))


def phred(p: Column) -> Column:
    return F.lit(-10.0) * F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)))


@F.pandas_udf(T.DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    values, where = np.unique(x.to_numpy(dtype=float), return_inverse=True)
    return pd.Series(np.array([math.lgamma(v) for v in values], dtype=float)[where])


@F.pandas_udf(T.DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p-value of each 2x2 table of the Arrow batch."""
    tables = pd.DataFrame({"a": a, "b": b, "c": c, "d": d}).astype("int64")
    unique = tables.drop_duplicates()
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(tables.to_numpy().sum(axis=1).max(initial=0)) + 1)))])
    result = []
    for t in unique.itertuples(index=False):
        top, bottom, left = t.a + t.b, t.c + t.d, t.a + t.c
        n = top + bottom
        if 0 in (top, bottom, left, n - left):
            result.append(1.0)
            continue
        k = np.arange(max(0, left - bottom), min(top, left) + 1)
        weight = np.exp(
            logs[left] - logs[k] - logs[left - k]
            + logs[n - left] - logs[top - k] - logs[n - left - top + k]
            - logs[n] + logs[top] + logs[bottom]
        )
        seen = weight[t.a - k[0]]
        result.append(min(1.0, float(weight[weight <= seen + max(seen * 1e-12, 1e-15)].sum())))
    return tables.merge(unique.assign(p=result), on=["a", "b", "c", "d"], how="left")["p"]


def human_size(size: Column) -> Column:
    """Bytes as text in base-1024 units; whole bytes, otherwise one decimal, of which ties round to even."""

    def scaled(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**power, 1))

    text = scaled(5, "PB")
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        text = F.when(size < 1024.0 ** (power + 1), scaled(power, unit)).otherwise(text)
    return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).otherwise(text)


def quality_sum(text: Column) -> Column:
    """Sum of the phred scores of a quality text; NULL for a missing one (``*``)."""
    total = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.when(c != "", F.ascii(c) - 33).otherwise(0))
    return F.when(text != "*", total)
