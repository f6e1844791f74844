import random
from collections import Counter

from pyspark.sql import functions as F

from haplolake.functions import alleles as A
from haplolake.functions import fields as X
from haplolake.operators import variants as V


def filters(df):
    return {r["pos"]: (";".join(r["filters"]), r["info"].get("CONTEXT_LOWQUAL_REASON")) for r in df.collect()}


def test_local_snp_cluster(variants):
    v = variants([(2, "C", "T"), (6, "C", "T"), (10, "C", "T")])
    got = filters(V.context_filter(v, max_local_snps=1, local_snp_window=5))
    assert got == {p: ("LowQual", "LOCAL_SNP_CLUSTER") for p in (2, 6, 10)}


def test_near_indel(variants):
    v = variants([(10, "A", "T"), (15, "AC", "A"), (50, "G", "C")])
    out = V.context_filter(v, min_snp_distance_to_indel=10)
    assert filters(out) == {10: ("LowQual", "NEAR_INDEL"), 15: ("PASS", None), 50: ("PASS", None)}
    assert {r["pos"]: r["info"].get("CONTEXT_INDEL_DIST") for r in out.collect()} == {10: "5", 15: None, 50: "35"}


def test_near_edge(variants):
    v = variants([(10, "A", "T", {"MUMMER_EDGE_DIST": "1"}), (50, "G", "C", {"MUMMER_EDGE_DIST": "25"})])
    got = filters(V.context_filter(v, min_snp_distance_to_breakpoint=10))
    assert got == {10: ("LowQual", "NEAR_ALIGNMENT_EDGE"), 50: ("PASS", None)}


def test_no_rule_leaves_records_alone(variants):
    v = variants([(10, "A", "T")])
    assert V.context_filter(v) is v


def test_density_across_bins_matches_brute_force(spark):
    points = [(p * 37 % 40000 + 1, 1 + p % 3) for p in range(900)]
    df = spark.createDataFrame([("k", p, n) for p, n in dict(points).items()], "k string, pos bigint, n_snp bigint")
    got = {r["pos"]: r["local_snps"] for r in V.local_snp_density(df, ["k"], 100).collect()}
    d = dict(points)
    assert got == {p: sum(n for q, n in d.items() if abs(q - p) <= 100) for p in d}


def test_info_round_trip(spark):
    rows = [("DP=3;ZERODEPTH;TYPE=SNP",), (".",), ("A=1;A=2;B",), ("",)]
    df = spark.createDataFrame(rows, "t string").select("t", X.parse_info(F.col("t")).alias("m"))
    got = {r["t"]: r["m"] for r in df.collect()}
    assert got == {"DP=3;ZERODEPTH;TYPE=SNP": {"DP": "3", "ZERODEPTH": "", "TYPE": "SNP"}, ".": {}, "A=1;A=2;B": {"A": "2", "B": ""}, "": {}}
    text = {r["t"]: r["s"] for r in df.select("t", X.format_info(F.col("m")).alias("s")).collect()}
    assert text["DP=3;ZERODEPTH;TYPE=SNP"] == "DP=3;ZERODEPTH;TYPE=SNP" and text["."] == "."


def test_labels_and_genotypes(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first()["x"]
    arr = lambda *a: F.array(*[F.lit(x) for x in a]).cast("array<string>")
    assert one(X.add_labels(arr("PASS"), arr("LowQual"))) == ["LowQual"]
    assert one(X.add_labels(arr("LowDepth"), arr("LowQual", "LowDepth"))) == ["LowDepth", "LowQual"]
    assert one(X.add_labels(arr("PASS"), arr())) == ["PASS"]
    for gt, has, folded in (("0/0", False, "0"), ("1/1", True, "1"), ("0|1", True, "."), (".", False, "."), ("./2", True, "./2"), ("1", True, "1")):
        assert one(X.has_alt(F.lit(gt))) == has
        assert one(X.collapse_genotype(F.lit(gt))) == folded
    assert one(X.edge_distance(F.create_map(F.lit("EDGE_DIST"), F.lit("7.9")))) == 7
    assert one(X.edge_distance(F.create_map(F.lit("EDGE_DIST"), F.lit("x"), F.lit("ASM_EDGE_DIST"), F.lit("3")))) is None


def test_trim_keeps_one_base(spark):
    cases = {("ACG", "ATG"): (1, "C", "T"), ("AC", "ACC"): (0, "A", "AC"), ("AT", "AG"): (1, "T", "G"), ("CAC", "C"): (0, "CAC", "C"), ("GT", "G"): (0, "GT", "G")}
    df = spark.createDataFrame(list(cases), "r string, a string")
    for r in df.select("r", "a", A.trimmed(F.col("r"), F.col("a")).alias("t")).collect():
        assert tuple(r["t"]) == cases[(r["r"], r["a"])], (r["r"], r["a"])


def test_split_multiallelic(spark, variants):
    v = variants([(5, "A", "C,G", {"TYPE": "SNP,SNP", "DP": "9"})]).withColumn(
        "fmt", F.create_map(F.lit("GT"), F.lit("1|2"), F.lit("AO"), F.lit("4,5"), F.lit("AD"), F.lit("0,4,5"))
    )
    got = sorted((r["alts"][0], r["fmt"]["GT"], r["fmt"]["AO"], r["fmt"]["AD"], r["info"]["TYPE"], r["info"]["DP"]) for r in V.split_multiallelic(v).collect())
    assert got == [("C", "1|0", "4", "0,4", "SNP", "9"), ("G", "0|1", "5", "0,5", "SNP", "9")]


def deletions(spark, v, bed, length=197394, seq=None):
    zero = spark.createDataFrame([("s", "chr1", a, b) for a, b in bed], "sample string, contig string, start bigint, end bigint")
    contigs = spark.createDataFrame([("chr1", length, 0)], "contig string, length bigint, ord int")
    seqs = spark.createDataFrame([("chr1", seq or "A" * length)], "contig string, seq string")
    out = V.add_deletions(v, zero, seqs, contigs)
    return out.filter(F.map_contains_key("info", "ZERODEPTH")).collect()


def test_symbolic_deletion(spark, variants):
    (d,) = deletions(spark, variants([(5, "A", "T")]), [(103379, 103380)])
    assert (d["pos"], d["ref"], d["alts"], d["info"]["END"], d["info"]["SVLEN"], d["fmt"]["GT"]) == (103379, "N", ["<DEL>"], "103380", "-1", "1/1")
    assert d["filters"] == ["PASS", "ZERODEPTH"] and d["id"] == "DEL_1"


def test_contig_start_and_whole_contig(spark, variants):
    v = variants([(50, "A", "T")])
    (d,) = deletions(spark, v, [(0, 20)], length=100, seq="acgt" * 25)
    assert (d["pos"], len(d["ref"]), d["alts"], d["info"]["END"], d["info"]["SVLEN"]) == (1, 21, ["-"], "20", "-20")
    assert d["ref"] == ("ACGT" * 6)[:21]
    none = variants([(50, "A", "T")], chrom="other")
    (w,) = deletions(spark, none, [(0, 100)], length=100, seq="acgt" * 25)
    assert (w["ref"], w["info"]["END"]) == ("ACGT" * 25, "100")


def test_leading_gap_over_blocks(spark, variants):
    text = "".join(random.Random(3).choices("acgt", k=70000))
    (d,) = deletions(spark, variants([(69990, "A", "T")]), [(0, 66000)], length=70000, seq=text)
    assert d["ref"] == text[:66001].upper() and d["info"]["SVLEN"] == "-66000"
    # what meets a record needs no text
    seqs, zero = spark.createDataFrame([], "contig string, seq string"), spark.createDataFrame([("s", "chr1", 0, 50)], "sample string, contig string, start bigint, end bigint")
    v = variants([(5, "A", "T")])
    assert V.add_deletions(v, zero, seqs, spark.createDataFrame([("chr1", 100, 0)], "contig string, length bigint, ord int")).count() == 1


def test_deletion_meets_existing_record(spark, variants):
    assert deletions(spark, variants([(103379, "GA", "G")]), [(103379, 103380)]) == []
    assert deletions(spark, variants([(565, "A", "G")]), [(560, 570)]) == []


def test_add_deletions_on_contigs_longer_than_a_text(spark, tmp_path):
    from haplolake.plans.catalog import QUERIES

    last = 54_000_000
    lines = [(k, 3, 1, n, 10.0, "A", "F") for k, n in ((1, 1), (2, 2), (last, 3))]
    lines = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(last,)], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(5).withColumnRenamed("id", "r_regionkey").write.parquet(str(tmp_path / "region.parquet"))
    length = last * 40 + 2000
    assert length > 1 << 31
    got = {(r["chrom"], r["pos"], r["end_"], r["svlen"], r["alt"]) for r in QUERIES["add_deletions"](spark, str(tmp_path)).collect()}
    whole = {(c, 1, length, -length, "-") for c in ("chr0", "chr2", "chr3", "chr9")}
    assert got - whole == {("chr1", last * 40 + 45, length, last * 40 + 45 - length, "<DEL>")}
    assert whole < got


def test_deletions_end_beyond_two_to_the_31(spark, variants):
    v = variants([(5, "A", "<DEL>", {"SVTYPE": "DEL", "END": "3000000000"})])
    assert [r["end"] for r in V.occupied(v).collect()] == [3000000000]
    assert [r["end"] for r in V.deletion_keys(v).collect()] == [3000000000]


def test_missing_reference_sequence_is_an_error(spark, variants):
    import pytest

    zero = spark.createDataFrame([("s", "zz", 0, 5)], "sample string, contig string, start bigint, end bigint")
    contigs = spark.createDataFrame([("chr1", 10, 0)], "contig string, length bigint, ord int")
    seqs = spark.createDataFrame([("chr1", "A" * 10)], "contig string, seq string")
    with pytest.raises(Exception, match="no reference sequence"):
        V.add_deletions(variants([(5, "A", "T")]), zero, seqs, contigs).collect()


def test_upset_top(spark):
    rows = [("a", 1), ("b", 1), ("a", 2), ("b", 3), ("c", 3), ("c", 4)]
    v = spark.createDataFrame([(s, "c", p, "A", ["T"]) for s, p in rows], "source string, chrom string, pos int, ref string, alts array<string>")
    assert [tuple(r) for r in V.upset(v, ["a", "b", "c"]).collect()] == [("001", 1), ("011", 1), ("100", 1), ("110", 1)]


def test_soft_filter_order(variants):
    v = variants([(1, "A", "T", None, "0/1", "."), (2, "A", "T", None, "1/1", ".")])
    v = v.withColumn("filters", F.array().cast("array<string>")).withColumn("fmt", F.map_concat("fmt", F.create_map(F.lit("DP"), F.lit("3"))))
    got = {r["pos"]: r["filters"] for r in V.short_read_filters(v).collect()}
    assert got == {1: ["LowQual", "LowDepth", "MixedSite"], 2: ["LowQual", "LowDepth"]}
    assert {r["pos"]: r["filters"] for r in V.assembly_filters(v).collect()} == {1: ["MixedSite"], 2: ["PASS"]}


def test_memberships_of_many_call_sets(spark):
    n, rng = 2000, random.Random(2)
    names = [f"set{i}" for i in range(n)]
    member = {k: sorted(rng.sample(range(n), rng.choice([1, 2, 62, 500]))) for k in range(60)}
    member[60] = member[0]
    rows = [(names[i], "c", k, "A", [".", "G"] if k % 2 else ["G", "*"], {"GT": "1/1"}, k) for k, m in member.items() for i in [*m, m[0]]] + [("unknown", "c", 99, "A", ["T"], {"GT": "0/1"}, 99)]
    df = spark.createDataFrame(rows, "source string, chrom string, pos long, ref string, alts array<string>, fmt map<string,string>, rec_no long")
    vector = lambda m: "".join("1" if i in m else "0" for i in range(n))
    want = Counter(vector(set(m)) for m in [*member.values(), []])
    assert {r.membership: r.n for r in V.upset(df, names, max_intersections=None).collect()} == want
    assert {r.membership: r.n for r in V.upset_from_genotypes(df.withColumnRenamed("source", "sample"), names, None).collect()} == want
    long = {r.pos: [tuple(g) for g in r.genotypes] for r in V.merged_genotypes(df).where("alt = 'G'").collect()}
    assert long == {k: sorted((names[i], "1/1") for i in m) for k, m in member.items()}


def test_truth_inside_regions(spark, variants):
    called = variants([(5, "A", "G"), (10, "CA", "CT"), (20, "G", "T")])
    truth = variants([(5, "A", "G"), (11, "A", "T"), (30, "C", "A"), (31, "C", "A")])
    regions = spark.createDataFrame([("chr1", 9, 11), ("chr1", 10, 12), ("chr1", 29, 30), ("chr2", 0, 99)], "contig string, start long, end long")
    (r,) = V.compare_truth(called, truth, regions=regions).collect()
    assert r.asDict() == {"sample": "s", "found": 1, "missed": 1, "extra": 0, "found_outside": 1, "missed_outside": 1, "extra_outside": 1}
    (r,) = V.compare_truth(called, truth).collect()
    assert r.asDict() == {"sample": "s", "found": 2, "missed": 2, "extra": 1}


def test_trimmed_looks_for_shared_bases_twice_a_record(spark):
    """One search for the tail and one for the head, however often the parts of the result are used; none where the ends differ."""
    pairs = [("A", "C"), ("AC", "GT"), ("ACGT", "ACT"), ("AAA", "AA"), ("GAC", "GTC"), ("ACA", "A"), ("", "A"), (None, "AC"), (None, None)]
    df = spark.createDataFrame(pairs, "ref string, alt string").withColumn("_t", A.trimmed(F.col("ref"), F.col("alt")))
    used = df.select(F.col("_t.skip").alias("skip"), F.col("_t.ref").alias("r"), F.col("_t.alt").alias("a"), F.length("_t.ref").alias("n"))
    assert used._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2
    assert [tuple(x)[:3] for x in used.collect()] == [
        (0, "A", "C"), (0, "AC", "GT"), (1, "CG", "C"), (0, "AA", "A"), (1, "A", "T"), (0, "ACA", "A"), (0, "", "A"), (0, None, None), (0, None, None)
    ]
