import random

import pytest
from pyspark.sql import functions as F

from haplolake.operators import intervals as I

SCHEMA = "contig string, start bigint, end bigint"


def brute_merge(rows):
    out = []
    for c, s, e in sorted(r for r in rows if r[2] > r[1]):
        if out and out[-1][0] == c and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([c, s, e])
    return [tuple(x) for x in out]


def sample(seed, n=400, span=3000, longest=40):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.randrange(span)
        # one contig holds most rows, some intervals are very long
        rows.append((rng.choice(["a", "a", "a", "b"]), s, s + rng.randrange(0, longest if rng.random() < 0.98 else span // 4)))
    return rows


@pytest.mark.parametrize("seed,bins", [(1, 16), (2, 64), (3, 16384)])
def test_merge_and_complement(spark, seed, bins):
    rows = sample(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    merged = brute_merge(rows)
    got = sorted(map(tuple, I.merge_intervals(df, bin_size=bins).collect()))
    assert got == merged
    again = I.merge_intervals(spark.createDataFrame(got, SCHEMA), bin_size=bins)
    assert sorted(map(tuple, again.collect())) == merged
    contigs = spark.createDataFrame([("a", 2500, 0), ("b", 4000, 1), ("z", 10, 2)], "contig string, length bigint, ord int")
    holes = sorted(map(tuple, I.complement(df, contigs).collect()))
    size = {"a": 2500, "b": 4000, "z": 10}
    covered = {c: {p for k, s, e in merged if k == c for p in range(s, e)} for c in size}
    want = []
    for c in size:
        free = [p for p in range(size[c]) if p not in covered[c]]
        for p in free:
            if want and want[-1][0] == c and want[-1][2] == p:
                want[-1][2] = p + 1
            else:
                want.append([c, p, p + 1])
    assert holes == [tuple(w) for w in want]


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("bin_size", [None, 32])
def test_overlap_joins(spark, closed, bin_size):
    a = [(c, s, max(e, s + 1), i) for i, (c, s, e) in enumerate(sample(5, 150))]
    b = [(c, s, max(e, s + 1), i) for i, (c, s, e) in enumerate(sample(6, 150, longest=15))]
    left = spark.createDataFrame(a, SCHEMA + ", i int")
    right = spark.createDataFrame(b, SCHEMA + ", j int")
    x = 1 if closed else 0
    pairs = sorted((i, j) for c, s, e, i in a for d, t, f, j in b if c == d and s < f + x and t < e + x)
    got = I.overlap_join(left, right, closed=closed, bin_size=bin_size).select("i", "j").collect()
    assert sorted(map(tuple, got)) == pairs
    hit = sorted({i for i, _ in pairs})
    semi = I.overlap_join(left, right, how="left_semi", closed=closed).select("i").collect()
    assert sorted(r["i"] for r in semi) == hit
    anti = I.overlap_join(left, right, how="left_anti", closed=closed).select("i").collect()
    assert sorted(r["i"] for r in anti) == sorted(set(range(150)) - set(hit))
    outer = I.overlap_join(left, right, how="left", closed=closed, bin_size=bin_size)
    assert outer.count() == len(pairs) + 150 - len(hit)


def test_overlap_join_of_unlike_widths(spark):
    """Reads of 100 bases and intervals as long as the chromosome: few rows meet in vain, and none twice."""
    length = 3_000_000
    rng = random.Random(9)

    def mixed(n, whole):
        spots = [(s, s + rng.choice([1, 100, 100, 100, 5000])) for s in (rng.randrange(length) for _ in range(n))]
        return [("a", s, e, i) for i, (s, e) in enumerate([*spots, *[(k, length - k) for k in range(whole)], (5, 5), (9, 7)])]

    a, b = mixed(1500, 3), mixed(1200, 2)
    left, right = spark.createDataFrame(a, SCHEMA + ", i int"), spark.createDataFrame(b, SCHEMA + ", j int")
    want = sorted((i, j) for _, s, e, i in a for _, t, f, j in b if s < f and t < e)
    got = I.overlap_join(left, right)
    assert sorted(map(tuple, got.select("i", "j").collect())) == want
    met = I._meetings(left, right.withColumnsRenamed({"start": "t", "end": "f"}), ["contig"], "t", "f", 0, None)
    assert met.count() < 5 * len(want)
    nothing = spark.createDataFrame([("a", None, 7, 1), ("a", 3, None, 2)], SCHEMA + ", j int")
    assert I.overlap_join(left, nothing).count() == 0
    assert I.overlap_join(nothing.limit(0), left).count() == 0


def test_sweep_counts_depth(spark):
    rows = sample(7)
    df = spark.createDataFrame(rows, SCHEMA)
    frame = spark.createDataFrame([("a", 4000), ("b", 4000), ("z", 9)], "contig string, length bigint")
    segments = I.sweep(df, bin_size=64, frame=frame).collect()
    depth = {(c, p): 0 for c, n in (("a", 4000), ("b", 4000), ("z", 9)) for p in range(n)}
    for c, s, e in rows:
        for p in range(s, e):
            depth[c, p] += 1
    got = {(r["contig"], p): r["depth"] for r in segments for p in range(r["start"], r["end"])}
    assert got == depth
    ordered = sorted(segments)
    assert all(not (x["contig"] == y["contig"] and x["depth"] == y["depth"]) for x, y in zip(ordered, ordered[1:]))


def test_nearest_distance(spark):
    rng = random.Random(8)
    points = [("k", rng.randrange(100000)) for _ in range(200)] + [("none", 5)]
    marks = [("k", rng.randrange(100000)) for _ in range(20)]
    p, t = spark.createDataFrame(points, "k string, pos bigint"), spark.createDataFrame(marks, "k string, pos bigint")
    got = sorted((r["k"], r["pos"], r["distance"]) for r in I.nearest_distance(p, t, "k").filter("k = 'k'").collect())
    assert got == sorted((k, x, min(abs(x - y) for _, y in marks)) for k, x in points if k == "k")
    assert I.nearest_distance(p, t, "k").filter("k = 'none'").first()["distance"] is None


def test_best_block_matches_scan(spark):
    rng = random.Random(9)
    blocks = [("c", s := rng.randrange(70000), s + 1 + rng.randrange(20000), rng.randrange(5), i) for i in range(120)]
    spots = [("c", rng.randrange(90000)) for _ in range(300)]
    b = spark.createDataFrame(blocks, SCHEMA + ", score int, no int")
    rank = F.struct("score", (-F.col("no")).alias("n"))
    got = {r["pos0"]: r["no"] for r in I.best_block(spark.createDataFrame(spots, "contig string, pos0 bigint"), b, rank, ["no"]).collect()}
    for _, p in spots:
        over = [(sc, -no) for _, s, e, sc, no in blocks if s <= p < e]
        assert got[p] == (-max(over)[1] if over else None)


def test_block_cells_are_few_and_disjoint(spark):
    rng = random.Random(10)
    spans = [(0, 1), (255, 257), (256, 512), (-300, -1), (4095, 8193), (1, 70000)]
    spans += [(s := rng.randrange(10**6), s + 200 + rng.randrange(300)) for _ in range(50)]
    df = spark.createDataFrame(spans, "s bigint, e bigint").select("s", "e", I.block_cells(F.col("s"), F.col("e")).alias("cells"))
    for r in df.collect():
        parts = sorted((c["low"], c["high"]) for c in r["cells"])
        assert parts[0][0] == r["s"] and parts[-1][1] == r["e"] and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert all(lo >> 8 + 4 * c["level"] == c["cell"] == (hi - 1) >> 8 + 4 * c["level"] for c in r["cells"] for lo, hi in [(c["low"], c["high"])])
        # cells of single positions were some 22 a block of this length
        assert r["e"] - r["s"] >= 500 or len(parts) <= 3


def test_best_block_on_short_and_crowded_blocks(spark):
    rng = random.Random(11)
    blocks = [("c", s := rng.randrange(-300, 900), s + 1 + rng.randrange(600) * rng.randrange(2), rng.randrange(4), i) for i in range(400)] + [(None, 0, 900, 9, 400)]
    spots = [("c", p) for p in range(-310, 1500, 3)] + [("c", None), (None, 5), ("d", 5)]
    rank = F.struct("score", (-F.col("no")).alias("n"))
    found = I.best_block(spark.createDataFrame(spots, "contig string, pos0 bigint"), spark.createDataFrame(blocks, SCHEMA + ", score int, no int"), rank, ["no"])
    got = {(r["contig"], r["pos0"]): r["no"] for r in found.collect()}
    assert len(got) == len(spots)
    for c, p in spots:
        over = [(sc, -no) for k, s, e, sc, no in blocks if c == k == "c" and p is not None and s <= p < e]
        assert got[c, p] == (-max(over)[1] if over else None)


def test_region_text():
    assert I.parse_region("chr1:5-9") == ("chr1", 5, 9)
    assert I.parse_region("5,9") == (None, 5, 9)
    for bad in ("5-9", "chr1:0-4", "9,5", "", "a:b:1-2"):
        with pytest.raises(ValueError):
            I.parse_region(bad)


def test_coverage_gt_hot_position(spark):
    """One start holds most rows: it is one event, not thousands of rows in a window."""
    df = spark.range(5000).select(F.lit("a").alias("contig"), F.lit(10).cast("bigint").alias("start"), F.lit(20).cast("bigint").alias("end"))
    assert [tuple(r) for r in I.coverage_gt(df, 1).collect()] == [("a", 10, 20, 5000)]


def test_overlap_join_copies_narrow_rows_to_the_cells_they_touch_only(spark):
    """Widths from 1 to 150 are one level: what is shuffled does not grow with the levels they would have."""
    a = spark.range(2000).selectExpr("'a' AS contig", "id * 40 AS start", "id * 40 + 1 + id % 2 AS end", "id AS i")
    b = spark.range(2000).selectExpr("'a' AS contig", "id * 40 + 7 AS start", "id * 40 + 10 + id % 148 AS end", "id AS j")
    got = I.overlap_join(a, b)
    left, right = a.collect(), b.collect()
    want = sorted((x["i"], y["j"]) for x in left for y in right if x["start"] < y["end"] and y["start"] < x["end"])
    assert sorted(map(tuple, got.select("i", "j").collect())) == want
    # the rows of both sides below the join
    met = I._meetings(a, b.withColumnsRenamed({"start": "t", "end": "f"}), ["contig"], "t", "f", 0, None)
    copies = [side.count() for side in _sides(met)]
    assert copies[0] < 1.1 * 2000 and copies[1] < 1.5 * 2000


def _sides(joined):
    """Both inputs of the join below."""
    plan = joined._jdf.queryExecution().analyzed()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    of = joined.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    from pyspark.sql import DataFrame

    return [DataFrame(of(joined.sparkSession._jsparkSession, side), joined.sparkSession) for side in (plan.left(), plan.right())]


def test_overlap_join_in_bins_copies_rows_to_the_bins_they_touch_only(spark):
    """Rows of one bin are not copied at all, and a pair that shares many bins is met once."""
    a = spark.createDataFrame([("a", s, s + 60, s) for s in range(0, 6400, 64)] + [("a", 10, 6000, -1), ("a", 70, 70, -2)], SCHEMA + ", i int")
    b = spark.createDataFrame([("a", 0, 6400, 0), ("a", 128, 129, 1)], SCHEMA + ", j int").withColumnsRenamed({"start": "t", "end": "f"})
    met = I._meetings(a, b, ["contig"], "t", "f", 0, 64)
    pairs = sorted((r.i, r.j) for r in met.collect())
    assert pairs == sorted([(s, 0) for s in range(0, 6400, 64)] + [(-1, 0), (-2, 0), (128, 1), (-1, 1)])
    # no row goes to a bin as one that asks
    assert "_role" not in met._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("closed", [False, True])
def test_semi_and_anti_join_against_brute_force(spark, closed):
    """Blocks in the bin of the end, in far earlier bins and across many; negative, empty and unknown places; rows that repeat."""
    rng = random.Random(5)
    rows = [(rng.choice("aab"), s, s + rng.choice([0, 1, 5, 900, 5000])) for s in (rng.randrange(-3000, 60000) for _ in range(600))]
    rows += [*rows[:40], ("a", -5, 70000), ("a", 69000, 69001), ("z", 1, 9), ("a", None, 5), ("a", 5, None), (None, 1, 2)]
    blocks = [(rng.choice("ab"), s, s + rng.choice([0, 1, 3, 40])) for s in (rng.randrange(-3000, 60000) for _ in range(150))]
    blocks += [("a", 20000, 30000), ("b", 100, 50000), ("a", None, 9), (None, 0, 9)]
    a, b = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", i int"), spark.createDataFrame(blocks, SCHEMA)
    extra = 1 if closed else 0

    def meets(row, block):
        if None in row or None in block or row[0] != block[0] or block[2] + extra <= block[1]:
            return False
        return row[1] < block[2] + extra and block[1] < row[2] + extra

    want = {i for i, r in enumerate(rows) if any(meets(r, x) for x in blocks)}
    semi, anti = (I.overlap_join(a, b, how=how, closed=closed) for how in ("left_semi", "left_anti"))
    assert semi.columns == a.columns
    assert sorted(r.i for r in semi.collect()) == sorted(want)
    assert sorted(r.i for r in anti.collect()) == sorted(set(range(len(rows))) - want)


def test_semi_join_groups_bins_not_ends(spark, monkeypatch):
    """5 000 different ends and 300 blocks in ten bins are ten rows of the scan that carries blocks on."""
    sizes = []

    def counted(df, keys, order, runs, *more):
        sizes.append(df.count())
        return running(df, keys, order, runs, *more)

    running = I.running
    monkeypatch.setattr(I, "running", counted)
    a = spark.range(5000).select(F.lit("a").alias("contig"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + 1).alias("end"))
    b = spark.range(300).select(F.lit("a").alias("contig"), (F.col("id") * 30).alias("start"), (F.col("id") * 30 + 1).alias("end"))
    assert I.overlap_join(a, b, how="left_semi").count() == 300
    assert sizes == [10]
