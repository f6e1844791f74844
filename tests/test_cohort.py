import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplolake.operators import checks as H
from haplolake.operators import cohort as K
from haplolake.operators import reads as R
from haplolake.operators import samples as P
from haplolake.operators import tree as T


def soft_core_fixture(spark):
    text = list("A" * 200)
    text[119] = "A"
    rows = {"reference": {}, "s1": {20: "C"}, "s2": {}, "s3": {120: "G"}}
    rows = {"reference": {40: "C"}, "s1": {20: "C", 40: "C"}, "s2": {40: "A"}, "s3": {40: "C", 120: "G"}}
    data = [(s, "c", "".join(edits.get(p, "A") for p in range(1, 201))) for s, edits in rows.items()]
    ref = spark.createDataFrame([("c", 0, data[0][2])], "contig string, ord int, seq string")
    return spark.createDataFrame(data, "sample string, contig string, seq string"), ref


def test_soft_core_rows(spark):
    seqs, ref = soft_core_fixture(spark)
    msa = K.msa_sites(seqs, ref, size=64)
    core = K.soft_core(msa, 0.95)
    assert sorted(r["site"] for r in core.collect()) == [19, 39, 119]
    rows = {r["sample"]: r["seq"] for r in K.core_alignment(msa, core, block=50).collect()}
    assert rows == {"reference": "ACA", "s1": "CCA", "s2": "AAA", "s3": "ACG"}
    assert tuple(K.constant_sites(msa).first()) == (197, 0, 0, 0)


@pytest.mark.parametrize("tile", [2, 256])
def test_snp_distances(spark, tile):
    rng = random.Random(3)
    names = [f"s{i}" for i in range(7)]
    table = {n: "".join(rng.choice("ACGTacgtN-") for _ in range(150)) for n in names}
    cells = [(p, n, b) for n, t in table.items() for p, b in enumerate(t) if b != "-"]
    msa = spark.createDataFrame(cells, "site bigint, sample string, base string")
    got = {(r["a"], r["b"]): r["distance"] for r in K.snp_distances(msa, tile=tile, block=40).collect()}
    ok = "ACGT"
    want = {(a, b): sum(x in ok and y in ok and x != y for x, y in zip(table[a].upper(), table[b].upper())) for a in names for b in names if a < b}
    assert got == want


def test_snp_distances_add_up_in_one_task(spark):
    """Crowded and thin places, cells on both sides of 0, a cell twice, no sample; counts of pairs meet no shuffle."""
    rng = random.Random(8)
    cells = {(p, f"s{s}"): rng.choice("ACGTacgtN") for p in range(-60, 200) for s in range(90) if p % 10 == 0 or rng.random() < 0.03}
    rows = [(p, s, b) for (p, s), b in cells.items()]
    msa = spark.createDataFrame([*rows, *rows[:50], (3, None, "A"), (None, "s1", "C")], "site bigint, sample string, base string")
    want = {}
    for p in range(-60, 200):
        here = sorted((s, b.upper()) for (at, s), b in cells.items() if at == p and b in "ACGTacgt")
        for k, (a, x) in enumerate(here):
            for b, y in here[k + 1 :]:
                want[a, b] = want.get((a, b), 0) + (x != y)
    names = sorted({s for _, s, _ in rows})
    df = K.snp_distances(msa, tile=20, block=64)
    assert {(r["a"], r["b"]): r["distance"] for r in df.collect()} == {(a, b): want.get((a, b), 0) for a in names for b in names if a < b}
    some = {(r["a"], r["b"]): r["distance"] for r in K.snp_distances(msa, tile=20, block=64, least=5).collect()}
    assert some == {k: n for k, n in want.items() if n >= 5}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")
    assert K.snp_distances(msa.limit(0)).count() == 0


def test_sites_of_few_differences_send_their_pairs_and_no_copies(monkeypatch):
    """Cells of a thin site are not copied to all tiles: what leaves is 4 bytes a differing pair."""
    import pyarrow as pa

    # 64 tiles; 300 sites of ten members, of which one differs, and one site of 4 000 members half by half
    rows = [(0, place, (7 * place + 13 * k) % 64 << 16 | k, 65 + (k == place % 10)) for place in range(300) for k in range(10)]
    rows += [(0, 300, k % 64 << 16 | k, 65 + 2 * (k // 64 % 2)) for k in range(4000)]
    names = ("block", "place", "who", "base")
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=list(names))
    monkeypatch.setattr(K, "TOGETHER", 1000)
    out = [r for b in K._pack_cells(64, iter([batch])) for r in b.to_pylist()]
    pairs, crowded = [r for r in out if r["tile"] < 0], [r for r in out if r["tile"] >= 0]
    assert sum(len(r["cells"]) for r in pairs) == 300 * 9 * 4 and all(0 <= r["i"] <= r["j"] and r["block"] >= K.PAIRS for r in pairs)
    assert len(crowded) == 64 and sum(len(r["cells"]) for r in crowded) == 4000 * 5
    want = sorted(tuple(sorted((x, y))) for _, p, x, b in rows for _, q, y, c in rows[10 * p : 10 * p + 10] if p == q < 300 and b < c)
    got = []
    for r in pairs:
        at = np.frombuffer(r["cells"], "<u4").tolist()
        got += [tuple(sorted((r["i"] << 16 | a >> 16, r["j"] << 16 | a & 0xFFFF))) for a in at]
    assert sorted(got) == want


def test_small_cohort_uses_mad(spark):
    values = dict(zip("abcdef", (99.0, 85.0, 83.0, 80.0, 10.0, 35.0)))
    df = spark.createDataFrame([("reference", 100.0), *((f"sample_{k}", v) for k, v in values.items())], "sequence string, aligned double")
    rows = {r["sequence"]: r for r in K.filter_samples(df).collect()}
    r = rows["sample_e"]
    assert r["mad_median"] == 81.5 and abs(r["mad_scaled"] - 15.5673) < 1e-4 and abs(r["mad_cutoff"] - 27.0145) < 1e-3
    assert {k for k, x in rows.items() if x["removed"]} == {"sample_e"} and r["filter_reason"] == "removed_by_mad"
    assert rows["reference"]["filter_reason"] == "reference"


def test_low_spread_and_empty(spark):
    df = spark.createDataFrame([("reference", 100.0), *((f"s{i}", 90.0 + i % 5) for i in range(12))], "sequence string, aligned double")
    assert {r["filter_reason"] for r in K.filter_samples(df).collect()} == {"reference", "low_spread"}
    assert [r["filter_reason"] for r in K.filter_samples(df.filter("sequence = 'reference'")).collect()] == ["reference"]


def test_mixture_splits_clear_clusters(spark):
    rng = random.Random(5)
    rows = [(f"hi{i}", 92 + rng.random() * 4) for i in range(24)] + [(f"lo{i}", 30 + rng.random() * 4) for i in range(8)]
    df = spark.createDataFrame([("reference", 100.0), *rows], "sequence string, aligned double")
    got = K.filter_samples(df).collect()
    assert {r["sequence"] for r in got if r["removed"]} == {f"lo{i}" for i in range(8)}
    assert len(got[0]) == 25


@pytest.mark.parametrize(
    "bics,want", [({1: 100.0, 2: 95.0, 3: 94.5}, 1), ({1: 100.0, 2: 95.0, 3: 94.0}, 3), ({1: 100.0, 2: 90.0, 3: 88.0}, 2), ({1: 100.0, 2: 90.0, 3: 80.0}, 3), ({1: 100.0, 3: 80.0}, 3), ({1: 10.0}, 1)]
)
def test_component_choice(bics, want):
    assert K.choose_components(bics) == want


def test_cluster_check(spark):
    d = spark.createDataFrame([(f"s{i}", i % 2) for i in range(10)], "sequence string, assigned_component int")
    same = spark.createDataFrame([(f"s{i}", "short" if i % 2 else "long") for i in range(10)], "sample string, pipeline_type string")
    r = K.cluster_check(d, same).first()
    assert r["adjusted_mutual_information"] == pytest.approx(1.0) and r["strong_association"] and r["reason"] == ""
    one = same.withColumn("pipeline_type", F.lit("short"))
    assert K.cluster_check(d, one).first()["reason"] == "single_pipeline_type"
    assert K.cluster_check(d, same.filter("sample = 'x'")).first()["reason"] == "no_matched_samples"


def test_reference_name():
    assert K.reference_name(["a"]) == "reference" and K.reference_name(["reference", "reference_2"]) == "reference_3"


def edges(spark, newick):
    return T.newick_edges(spark.createDataFrame([(1, newick)], "tree_id int, newick string"))


def test_tree(spark):
    e = edges(spark, "(a:0.1,(b:0.2,c:0.3):0.4);")
    assert {r["name"]: r["len"] for r in T.scale_tree(e, 10).filter("name is not null").collect()} == {"a": 1.0, "b": 2.0, "c": 3.0}
    assert sorted(r["len"] for r in T.scale_tree(e, 4, "1,2,3,0").filter("len is not null").collect()) == [1.0, 2.0, 3.0, 4.0]
    far = {(r["a"], r["b"]): r["distance"] for r in T.tree_distances(edges(spark, "(a:1,(b:2,c:3):4);").drop("tree_id"), tile=1).collect()}
    assert far == {("b", "a"): 7.0, ("c", "a"): 8.0, ("c", "b"): 5.0}


def test_deep_tree(spark):
    text = "t0:1"
    for i in range(1, 40):
        text = f"({text},t{i}:1):1"
    e = edges(spark, text + ";")
    assert T.heavy_ways(e).agg(F.count("*"), F.max(F.size("way"))).first()[:] == (40, 2)
    far = {(r["a"], r["b"]): r["distance"] for r in T.tree_distances(e, tile=7).collect()}
    assert len(far) == 780 and far["t39", "t0"] == 40.0 and far["t1", "t0"] == 2.0


def test_random_trees_against_root_paths(spark):
    rng, rows = random.Random(7), []
    for tree in (1, 2):
        for node in range(1, 60):
            # one tree is bushy, the other has long chains; lengths may be negative or absent
            parent = rng.randrange(node) if tree == 1 else max(0, node - rng.choice((1, 1, 1, 2, 5)))
            rows.append((tree, node, parent, rng.choice((None, -1.0, 0.5, 2.0, 3.25))))
    far = {(r.tree_id, int(r.a), int(r.b)): r.distance for r in T.tree_distances(spark.createDataFrame(rows, "tree_id int, node int, parent int, len double"), tile=9).collect()}
    up = {(t, n): (p, size or 0.0) for t, n, p, size in rows}

    def path(t, n):
        return [] if n == 0 else [n, *path(t, up[t, n][0])]

    for tree in (1, 2):
        tips = sorted({n for t, n, _, _ in rows if t == tree} - {p for t, _, p, _ in rows if t == tree}, key=str)
        for x, a in enumerate(tips):
            for b in tips[:x]:
                apart = set(path(tree, a)) ^ set(path(tree, b))
                assert far.pop((tree, a, b)) == sum(up[tree, n][1] for n in apart)
    assert not far


def test_comb_of_5000_tips(spark):
    n = spark.range(1, 5000).select(F.col("id").cast("string").alias("k"), "id")
    inner = n.select(F.concat(F.lit("i"), "k").alias("node"), F.when(F.col("id") > 1, F.concat(F.lit("i"), (F.col("id") - 1).cast("string"))).alias("parent"), F.lit(1.0).alias("len"))
    tips = n.select("k", F.concat(F.lit("i"), "k"), F.lit(1.0)).union(spark.sql("SELECT '5000', 'i4999', 0.0D"))
    comb = inner.union(tips)
    # the last tip has no length of its own: as far from tip k as an inner node is
    x, y = F.col("a").cast("long"), F.col("b").cast("long")
    want = F.when((x == 5000) | (y == 5000), 5000 - F.least(x, y)).otherwise(F.abs(x - y) + 2)
    far = T.tree_distances(comb, tile=1024).select(F.sum(F.when(F.col("distance") != want, 1).otherwise(0)), F.count("*")).first()
    assert tuple(far) == (0, 5000 * 4999 // 2)


def test_cycles_are_refused(spark):
    loop = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "node string, parent string, len double")
    with pytest.raises(ValueError, match="cycle"):
        T.measured_nodes(loop)


def test_sampling_keeps_pairs_and_reaches_target(spark):
    reads = spark.range(4000).select(F.expr("cast(id div 2 as string)").alias("read_id"), (F.col("id") % 2 + 1).alias("mate"), F.repeat(F.lit("A"), (F.col("id") % 2 * 50 + 50).cast("int")).alias("seq"))
    kept = R.sample_to_coverage(reads, 3.0, 10000)
    assert kept.agg(F.sum(F.length("seq"))).first()[0] == 30000
    assert {r["count"] for r in kept.groupBy("read_id").count().collect()} == {2}
    assert R.sample_n(reads, 17).select("read_id").distinct().count() == 17
    assert R.sample_to_coverage(reads, 100.0, 10000).count() == 4000
    part = R.sample_fraction(reads, 0.3, key="read_id")
    assert 900 < part.count() < 1500 and {r["count"] for r in part.groupBy("read_id").count().collect()} == {2}


def test_clean_and_dedup(spark):
    rows = [("a", 1, "ACGTACGTACGTACGTAC", "I" * 18), ("a", 2, "TTTTTTTTTTTTTTTTTT", "I" * 18), ("b", 1, "ACGTACGTACGTACGTAC", "!" * 9 + "I" * 9), ("b", 2, "GGGGGGGGGGGGGGGGGG", "I" * 18), ("c", 1, "ACGT", "IIII")]
    reads = spark.createDataFrame(rows, "read_id string, mate int, seq string, qual string")
    assert sorted({r["read_id"] for r in R.clean_reads(reads, paired=True).collect()}) == ["a"]
    assert sorted((r["read_id"], r["mate"]) for r in R.clean_reads(reads).collect()) == [("a", 1), ("a", 2), ("b", 2)]
    twin = reads.filter("read_id = 'a'").withColumn("read_id", F.lit("z")).union(reads)
    assert sorted({r["read_id"] for r in R.dedup_reads(twin).collect()}) == ["a", "b", "c"]


def test_read_stats(spark):
    reads = spark.createDataFrame([("f", "A" * n, "I" * n) for n in (2, 3, 4, 5, 6)] + [("g", "GC-", "5?I")], "file string, seq string, qual string")
    r = {x["file"]: x for x in R.read_stats(reads, all_stats=True, n_stats=(90,)).collect()}
    f = r["f"]
    assert (f["num_seqs"], f["sum_len"], f["avg_len"], f["n50"], f["n90"], f["q1"], f["q2"], f["q3"]) == (5, 20, 4.0, 5, 3, 3.0, 4.0, 5.0)
    g = r["g"]
    assert g["sum_gap"] == 1 and g["q20_percent"] == 100.0 and g["q30_percent"] == pytest.approx(200 / 3) and g["gc_percent"] == pytest.approx(200 / 3)


def sheet(spark, *files):
    df = spark.createDataFrame(list(files), "path string, first_line string")
    return {r["sample"]: r for r in P.build_sample_sheet(P.resolve_sample_ids(P.pair_reads(P.with_sample_ids(P.classify_files(df))))).collect()}


def test_sample_sheet(spark):
    uuid = "@0a1b2c3d-0000-1111-2222-333344445555 runid=1"
    got = sheet(
        spark, ("/d/x_R1.fastq.gz", "@r"), ("/d/x_R2.fastq.gz", "@r"), ("/d/asm.fa", ">c"), ("/d/ont.fastq", uuid), ("/d/single_1.fq", "@r"), ("/d/notes.txt", "hello"),
    )
    assert set(got) == {"x", "asm", "ont", "single_1"}
    assert (got["x"]["left"], got["x"]["right"], got["x"]["type"]) == ("/d/x_R1.fastq.gz", "/d/x_R2.fastq.gz", "short")
    assert got["asm"]["assembly"] == "/d/asm.fa" and got["ont"]["reads"] == "/d/ont.fastq" and got["single_1"]["right"] is None


def test_same_names_in_several_folders(spark):
    got = sheet(spark, ("/d/run1/s.fa", ">c"), ("/d/run2/s.fa", ">c"), ("/d/run3/u.fa", ">c"), ("/d/run3/u.fasta", ">c"), ("/d/s2/s2.fa", ">c"), ("/d/t/s2.fa", ">c"))
    assert set(got) == {"run1-s", "run2-s", "u.fa", "u.fasta", "s2", "t-s2"}


def test_alignment_kind(spark):
    df = spark.createDataFrame(
        [("/a.bam", None, "@RG\tID:1\tPL:ILLUMINA\n", None), ("/b.bam", None, "@PG\tCL:minimap2 -x map-ont\n", 100), ("/c.sam.gz", None, "", 1500), ("/d.cram", None, "", 150), ("/e.bam", None, "", None)],
        "path string, first_line string, header string, median_length int",
    )
    assert {r["path"]: r["kind"] for r in P.classify_files(df).collect()} == {"/a.bam": "ILL", "/b.bam": "ONT", "/c.sam.gz": "ONT", "/d.cram": "ILL", "/e.bam": None}


def test_checks(spark):
    samples = spark.createDataFrame([("a", "short"), ("a", "asm"), ("b", ""), (" ", "long")], "sample string, type string")
    assert sorted((r["key"], r["detail"]) for r in H.check_samples(samples).collect()) == [("a", "2 rows"), ("sample", "missing sample"), ("type", "missing type")]
    msa = spark.createDataFrame([("a", "ACGT"), ("b", "ACG"), ("c", "")], "sample string, seq string")
    assert sorted(r["sample"] for r in H.check_alignment_lengths(msa).collect()) == ["b", "c"]
    contigs = spark.createDataFrame([("c1", 10), ("c2", 20)], "contig string, length bigint")
    sq = spark.createDataFrame([("c1", 10), ("c2", 21), ("c3", 5)], "contig string, length bigint")
    assert sorted((r["key"], r["detail"]) for r in H.check_alignment_reference(sq, contigs, sq.limit(0)).collect()) == [("c2", "length"), ("c3", "extra"), ("reads", "no mapped reads")]
    s = spark.createDataFrame([("a", "c1"), ("a", "c1"), ("b", "c1"), ("b", "c2"), ("b", "c9")], "sample string, contig string")
    assert sorted((r["sample"], r["key"], r["detail"]) for r in H.check_contigs(s, contigs).collect()) == [("a", "c1", "duplicate"), ("a", "c2", "missing"), ("b", "c9", "extra")]
    assert H.check_not_empty(s, "variants").count() == 0 and H.check_not_empty(s.limit(2), "tree", 3).count() == 1
    good, failed = H.split_failures(s, H.check_contigs(s, contigs))
    assert good.count() == 0 and {r["sample"] for r in failed.collect()} == {"a", "b"}
    q = spark.createDataFrame([("a", float("nan")), ("b", 101.0), ("c", 50.0)], "sequence string, aligned double")
    assert sorted(r["key"] for r in H.check_aligned_percent(q, msa.union(spark.createDataFrame([("zz", "A")]))).collect()) == ["a", "b", "zz"]
    cons = spark.createDataFrame([("a", "ACGT"), ("b", "AC"), ("b", "GT")], "sample string, seq string")
    assert [r["sample"] for r in H.check_consensus(cons, 4, 1).collect()] == ["b"]


def test_mutual_information_of_large_margins(spark):
    from pyspark.sql import functions as F

    n = 10**7
    rows = spark.range(n).select((F.col("id") % 2).alias("x"), F.expr("id div 2 % 2").alias("y"), (F.col("id") % 2 + 5).alias("z"))
    apart = K.adjusted_mutual_information(rows, "x", "y").first()
    assert apart.n == n and abs(apart.ami) < 1e-6
    assert abs(K.adjusted_mutual_information(rows, "x", "z").first().ami - 1) < 1e-9
