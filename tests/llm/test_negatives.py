"""Hard negatives against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplolake.llm import negatives

SCHEMA = "vec_id long, label int, ints array<long>"


def brute(rows, anchors):
    usable = {(v, x, tuple(y)) for v, x, y in rows if None not in (v, x, y)}
    out = []
    for a, label, ints in {(v, x, tuple(y)) for v, x, y in anchors if None not in (v, x, y)}:
        scored = [(sum(p * q for p, q in zip(ints, y, strict=False)), v, x) for v, x, y in usable if v != a]
        order = lambda r: (-r[0], r[1], r[2])
        for score, v, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fine = sorted((s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=order)[:10]
            out += [(a, v, i + 1, w, score, s) for i, (s, w, _) in enumerate(fine)]
    return sorted(out)


def _rows(seed, high=200, dims=8):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.randint(-high, high) for _ in range(dims)]) for i in range(300)]
    rows += [(300 + i, rng.randrange(3), rows[i][2]) for i in range(40)]  # ties
    rows += [rows[7]] * 60 + [(9, 2, rows[3][2]), (10, None, rows[1][2]), (None, 1, rows[1][2]), (11, 1, None), (500, 0, []), (501, 1, [0] * dims), (502, 1, rows[0][2][:3])]
    return rows


@pytest.mark.parametrize(("seed", "high", "block", "components"), [(1, 200, 16_384, 2_000_000), (2, 200, 50, 60), (3, 3, 64, 200), (4, 1 << 27, 64, 200), (5, 1 << 40, 64, 200)])
def test_against_all_pairs(spark, seed, high, block, components):
    rows = _rows(seed, high)
    anchors = [r for i, r in enumerate(rows) if i % 17 == 0] + rows[7:10] + rows[-8:]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).repartition(4)
    got = negatives.hard_negatives(df, spark.createDataFrame(anchors, SCHEMA), block=block, components=components)
    want = brute(rows, anchors)
    if high < 1 << 30:
        assert sorted(map(tuple, got.collect())) == want and want
    else:  # scores beyond LONG are cut, so few negatives are left between the bounds
        assert all(0 <= 30 * r.positive_score <= 100 * r.negative_score <= 90 * r.positive_score for r in got.collect())


def test_search_stops_early():
    rng = np.random.default_rng(1)
    ints = rng.integers(-100, 100, (2000, 3))
    ints[5] = (3000, 3000, -3000)
    lists = negatives.Lists(ints, np.int64)
    rows, scores, depth = lists.search(np.array([10, 20, -30]), np.ones(2000, bool), [(-(10**9), 10**9, 1)])
    assert depth < 100 and 5 in rows and scores.max() == 180_000


def test_empty_tables(spark):
    df = spark.createDataFrame(_rows(6), SCHEMA)
    assert negatives.hard_negatives(df.limit(0), df.limit(0)).count() == 0
    assert negatives.hard_negatives(df, df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.limit(0), df.where("vec_id < 5")).count() == 0
