"""Operators with two samples, samples without calls, and contigs that don't fit."""

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from haplolake.operators import assembly as B
from haplolake.operators import cohort as K
from haplolake.operators import depth as D
from haplolake.operators import tree as T
from haplolake.plans import flows

TEXT = "ACGTTGCAAC" * 10


def _two(reads):
    """Five reads in s with the reference base at 31, three in u with another."""
    a = reads([(f"a{i}", 0, 11, "40M", TEXT[10:50]) for i in range(5)]).withColumn("sample", F.lit("s"))
    other = TEXT[10:30] + "C" + TEXT[31:50]
    return a.unionByName(reads([(f"b{i}", 16, 11, "40M", other) for i in range(3)]).withColumn("sample", F.lit("u")))


def test_reads_of_two_samples_stay_apart(spark, variants, reads):
    a = _two(reads)
    v = variants([(31, "A", "C")]).unionByName(variants([(31, "A", "C")], sample="u"))
    seen = D.pileup(a, v.select("sample", F.col("chrom").alias("contig"), "pos"), keys=("sample",))
    assert {(r.sample, r.base): r["count"] for r in seen.groupBy("sample", "base").count().collect()} == {("s", "A"): 5, ("u", "C"): 3}
    info = {r.sample: r.info for r in D.strand_bias(v, seen, keys=("sample",)).collect()}
    assert (info["s"]["SB_REF_FWD"], info["s"]["SB_ALT_REV"]) == ("5", "0") and (info["u"]["SB_REF_FWD"], info["u"]["SB_ALT_REV"]) == ("0", "3")
    ref = spark.createDataFrame([("chr1", 31, "A")], "contig string, pos bigint, ref string")
    assert [(r.sample, r.alt, r.ao, r.gt) for r in D.call_snps(seen, ref, keys=("sample",)).collect()] == [("u", "C", 3, "1/1")]


def test_copy_numbers_of_two_samples(spark, reads):
    contigs = spark.createDataFrame([("s", "chr1", 100, 0), ("u", "chr1", 100, 0)], "sample string, contig string, length bigint, ord int")
    a = _two(reads)
    segments = D.depth_segments(a, contigs, keys=("sample",))
    f = spark.createDataFrame([("f", "chr1", 10, 50), ("g", "chr1", 60, 80)], "feature_id string, contig string, start bigint, end bigint")
    f = f.withColumn("attributes", F.create_map(F.lit("ID"), F.col("feature_id")))
    base = D.baseline_from_region(segments, contigs.filter("sample = 's'"), ("chr1", 11, 50), keys=("sample",))
    assert {r.sample: r.baseline for r in base.collect()} == {"s": 5.0, "u": 3.0}
    got = {(r.sample, r.feature_id): r.copy_number for r in D.feature_cnv(f, segments, base, keys=("sample",)).collect()}
    assert got == {("s", "f"): 1, ("u", "f"): 1, ("s", "g"): 0, ("u", "g"): 0}
    with pytest.raises(PySparkException, match="above zero"):
        D.baseline_from_region(segments, contigs.filter("sample = 's'"), ("chr1", 61, 80), keys=("sample",)).collect()
    cover = D.contig_coverage(a, contigs, keys=("sample",)).join(contigs.select("sample", "contig", "ord"), ["sample", "contig"])
    assert {r.sample: r.copy_number for r in D.contig_cnv(cover, keys=("sample",)).collect()} == {"s": 1, "u": 1}


def test_blocks_of_two_samples(spark, variants):
    schema = "sample string, qname string, contig string, start bigint, end bigint, qstart int, qend int, mapq int, tags map<string,string>"
    paf = spark.createDataFrame([("s", "q1", "chr1", 0, 100, 0, 100, 60, {"tp": "P"}), ("u", "q2", "chr1", 50, 100, 0, 50, 10, {"tp": "P"})], schema)
    v = variants([(60, "A", "C")]).unionByName(variants([(60, "A", "C"), (20, "A", "G")], sample="u"))
    got = {(r.sample, r.pos): r.info.get("ASM_LOWQUAL_REASON") for r in B.annotate_paf(v, paf, ("sample",)).collect()}
    assert got == {("s", 60): None, ("u", 60): "LOW_MAPQ", ("u", 20): "NO_PAF_CONTEXT"}
    contigs = spark.createDataFrame([(n, "chr1", 100, 0) for n in "suv"], "sample string, contig string, length bigint, ord int")
    gaps = B.missing_regions(paf, contigs, keys=("sample",)).collect()
    assert sorted((r.sample, r.start, r.end) for r in gaps) == [("u", 0, 50), ("v", 0, 100)]


def _delta(spark, rows):
    return spark.createDataFrame(rows, "sample string, ref string, qry string, ref_start int, ref_end int, qry_start int, qry_end int, errors int, offsets array<int>")


def test_delta_of_two_samples_and_unknown_contigs(spark):
    ref = spark.createDataFrame([("r", "ACGTACGT")], "contig string, seq string")
    qry = spark.createDataFrame([("s", "q", "ACCTACGT"), ("u", "q", "ACGTACGA")], "sample string, contig string, seq string")
    free = {"min_identity": 0, "min_length": 0, "max_variants_per_kb": 0}
    blocks = _delta(spark, [("s", "r", "q", 1, 8, 1, 8, 1, []), ("u", "r", "q", 1, 8, 1, 8, 1, [])])
    got = B.delta_variants(blocks, ref, qry, **free).collect()
    assert sorted((r.sample, r.pos, r.ref, r.alts[0]) for r in got) == [("s", 3, "G", "C"), ("u", 8, "T", "A")]
    for bad in (("s", "r", "x", 1, 8, 1, 8, 1, []), ("s", "x", "q", 1, 8, 1, 8, 1, [])):
        with pytest.raises(PySparkException, match="unknown contig"):
            B.delta_variants(_delta(spark, [bad]), ref, qry, **free).collect()


def test_forest(spark):
    trees = spark.createDataFrame([(1, "(a:1,b:2);"), (2, "(a:10,(b:20,c:5):1);")], "tree_id int, newick string")
    got = {(r.tree_id, r.a, r.b): r.distance for r in T.tree_distances(T.newick_edges(trees), tile=2).collect()}
    assert got == {(1, "b", "a"): 3.0, (2, "b", "a"): 31.0, (2, "c", "a"): 16.0, (2, "c", "b"): 25.0}


def test_sequences_that_do_not_fit(spark):
    reference = spark.createDataFrame([("c1", 0, "AAAA"), ("c2", 1, "TTTT")], "contig string, ord int, seq string")
    schema = "sample string, contig string, seq string"
    whole = [("s", "c1", "AAAT"), ("s", "c2", "TTTT")]
    assert {r.sample: r.seq for r in K.build_msa(spark.createDataFrame(whole, schema), reference).collect()} == {"reference": "AAAATTTT", "s": "AAATTTTT"}
    for bad in ([("u", "c1", "AAAT")], [("u", "c1", "AAAT"), ("u", "c2", "TTTT"), ("u", "zz", "A")], [("u", "c1", "AAA"), ("u", "c2", "TTTT")]):
        seqs = spark.createDataFrame(whole + bad, schema)
        with pytest.raises(SparkRuntimeException, match="u does not fit"):
            K.build_msa(seqs, reference).collect()
        assert {r.sample for r in K.check_msa(seqs, reference).collect()} == {"u"}


def test_core_alignment_is_linear_in_the_gaps(spark):
    cells = [(1, "a", "A"), (1, "b", "C"), (5, "b", "G"), (5, "a", "G"), (9, "a", "T"), (9, "c", "A"), (12, "b", "T")]
    msa = spark.createDataFrame(cells, "site bigint, sample string, base string")
    sites = msa.select("site").distinct()
    for block in (65536, 4):
        assert {r.sample: r.seq for r in K.core_alignment(msa, sites, block).collect()} == {"a": "AGT-", "b": "CG-T", "c": "--A-"}


def test_a_sample_without_calls_is_kept(spark, variants, reads):
    seqs = spark.createDataFrame([("chr1", TEXT)], "contig string, seq string")
    contigs = spark.createDataFrame([("chr1", 100, 0)], "contig string, length bigint, ord int")
    calls = variants([(31, "A", "C")]).withColumn("fmt", F.map_concat("fmt", F.create_map(F.lit("DP"), F.lit("30")))).withColumn("qual", F.lit(200.0))
    a = reads([(f"r{i}", 0, 1 + (i % 2) * 50, "50M", TEXT[(i % 2) * 50 : (i % 2) * 50 + 50]) for i in range(8)])
    both = a.withColumn("sample", F.lit("s")).unionByName(a.withColumn("sample", F.lit("u")))
    out = flows.short_reads(calls.withColumn("filters", F.array().cast("array<string>")), both, seqs, contigs)
    assert {r["sample"]: r["seq"] for r in out.consensus.collect()} == {"s": TEXT[:30] + "c" + TEXT[31:], "u": TEXT}
    assert {r["sample"] for r in out.qc.collect()} == {"s", "u"}
    bad = out.consensus.unionByName(spark.createDataFrame([("w", "zz", "A")], "sample string, contig string, seq string"))
    c = flows.core(bad.select("sample", "contig", "seq"), seqs.withColumn("ord", F.lit(0)), 0.6)
    assert [r["sample"] for r in c.failed.collect()] == ["w"]
    assert {r["sample"] for r in c.alignment.collect()} == {"reference", "s", "u"}


def test_long_reads_and_cohort(spark, variants, reads):
    seqs = spark.createDataFrame([("chr1", TEXT)], "contig string, seq string")
    contigs = spark.createDataFrame([("chr1", 100, 0)], "contig string, length bigint, ord int")
    calls = variants([(31, "A", "C")]).withColumn("fmt", F.map_concat("fmt", F.create_map(F.lit("DP"), F.lit("30")))).withColumn("qual", F.lit(200.0))
    calls = calls.withColumn("filters", F.array().cast("array<string>"))
    a = reads([(f"r{i}", 0, 1 + (i % 2) * 50, "50M", TEXT[(i % 2) * 50 : (i % 2) * 50 + 50]) for i in range(8)])
    short = flows.short_reads(calls, a.withColumn("sample", F.lit("s")), seqs, contigs)
    long = flows.long_reads(calls.withColumn("sample", F.lit("l")), a.withColumn("sample", F.lit("l")), seqs, contigs)
    assert {r["sample"]: r["seq"][30] for r in long.consensus.collect()} == {"l": "c"}
    stray = flows.short_reads(calls.filter("false"), a.withColumn("sample", F.lit("w")), seqs.withColumn("contig", F.lit("zz")), contigs.withColumn("contig", F.lit("zz")))
    out = flows.cohort([short, long, stray], seqs.withColumn("ord", F.lit(0)), 0.6)
    assert {r["sample"]: r["pipeline_type"] for r in out.qc.collect()} == {"s": "short", "l": "long", "w": "short"}
    assert [r["sample"] for r in out.failed.collect()] == ["w"]
    assert {r["sample"] for r in out.breakdown.collect()} >= {"s", "l"}
    assert {(r["a"], r["b"]): r["distance"] for r in out.core.core_distances.collect()} == {("l", "reference"): 1, ("l", "s"): 0, ("reference", "s"): 1}
