"""Near-duplicates against all pairs, and components against union-find."""

import os
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from haplolake.llm import neardup
from haplolake.llm.components import components


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posting = {}
    for i, s in enumerate(sets):
        for x in s:
            posting.setdefault(x, []).append(i)
    seen = {p for ids in posting.values() for p in combinations(ids, 2)}
    for i, j in seen:
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        lowest[find(i)] = min(lowest.get(find(i), d), d)
    return sorted((d, len(s), lowest[find(i)], d == lowest[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def _rows():
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99))
    rows = []
    for _ in range(60):
        words = [word() for _ in range(rng.choice([3, 9, 60, 200]))]
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    hub = [word() for _ in range(100)]
    for i in range(150):  # one large group of near copies
        copy = list(hub)
        copy[(i * 7) % 100] = word()
        rows.append(" ".join(copy))
    common = " ".join(word() for _ in range(15))
    rows += [common + " " + " ".join(word() for _ in range(40)) for _ in range(80)]
    return list(enumerate(rows)) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One Word"), (1004, "one word"), (1005, "a " * 50_000)]


@pytest.mark.parametrize("small", [24, 4])
def test_against_all_pairs(spark, small):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(1))
    got = neardup.near_duplicates(df, 4, 80, small).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 80)


def test_star_of_copies_unlike_each_other(spark):
    rng = random.Random(5)
    hub = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(hub))]
    for d in range(1, 3001):
        copy = list(hub)
        for part in range(10):  # ten scattered words: 357 of 437 shingles are the original's
            copy[40 * part + rng.randrange(4, 36)] = f"x{d}_{part}"
        rows.append((d, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert {r.component_id for r in neardup.near_duplicates(df, 4, 80).select("component_id").distinct().collect()} == {0}


def test_token_cut_is_negligible():
    from math import ceil, comb

    fewest = ceil(neardup.LEAST_AGREEMENT * neardup.TOKENS)
    assert sum(comb(neardup.TOKENS, i) * 0.8**i * 0.2 ** (neardup.TOKENS - i) for i in range(fewest)) < 1e-17


def test_overlaps():
    import numpy as np

    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(30) if rng.random() < 0.5 else rng.randrange(3000) for _ in range(40)], np.uint64)) for _ in range(150)]
    got = neardup._overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(150), 2))


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (3, "other text"), (1, "A B C D E")], "doc_id long, text string")
    got = neardup.near_duplicates(df).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(doc_id=a, component_id=b, kept=c) for a, b, c in
                                                     [(None, None, True), (3, 1, False), (3, 1, False), (3, 3, True), (1, 1, True)]]))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables are not here")
def test_query_finds_every_link(spark):
    from haplolake.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op3_neardup"](spark, "/root/testdata/sf0.01").select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 80)


def test_unlike_long_texts_share_no_first_node():
    import numpy as np

    rng = np.random.default_rng(9)
    sets = [rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(1500)]
    tokens = [neardup.minwise(s) for s in sets]
    firsts = [{t[24 * k : 24 * k + 4] + t[256 + 4 * k : 260 + 4 * k] for t in tokens} for k in range(neardup.TREES)]
    assert all(len(f) == len(sets) for f in firsts)
    # 32 bits alone are spread as well: 1500 of them agree with a chance of 1 in 3800
    assert all(len({t[4 * i : 4 * i + 4] for t in tokens}) >= len(sets) - 1 for i in range(neardup.TOKENS))


def test_pairs_of_a_large_group_are_few(spark):
    rng = random.Random(6)
    hub = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(1500):
        copy = list(hub)
        copy[rng.randrange(300)] = f"x{d}"
        rows.append((d, " ".join(copy)))
    described = neardup.describe(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    classes = described.select("cls", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "tokens")
    joined = neardup.candidates(classes.withColumn("comp", F.when(F.col("rep") < 1400, F.lit("all")).otherwise(F.col("rep").cast("string")).cast("binary")), neardup.ROUNDS[1])
    assert 0 < joined.count() < 100 * 7 * 60
    assert neardup.candidates(classes.withColumn("comp", F.lit("all").cast("binary")), neardup.ROUNDS[1]).count() == 0
