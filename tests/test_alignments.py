import pytest
from pyspark.sql import functions as F

from haplolake.functions import cigar as C
from haplolake.functions.numbers import fisher_two_sided, half_up, phred
from haplolake.operators import alignments as L
from haplolake.operators import depth as D


@pytest.fixture()
def contigs(spark):
    return spark.createDataFrame([("chr1", 1000, 0)], "contig string, length bigint, ord int")


def test_clip_filter(reads, contigs):
    a = reads([("a", 0, 100, "100M", "A" * 100), ("b", 0, 200, "10S90M", "A" * 100), ("c", 0, 300, "5S95M", "A" * 100)])
    assert sorted(r["qname"] for r in L.clip_filter(a, contigs, 5).collect()) == ["a", "c"]
    assert [r["qname"] for r in L.clip_filter(a, contigs, 5, invert=True).collect()] == ["b"]


def test_clip_at_contig_end_and_fraction(reads, contigs):
    a = reads([("a", 0, 1, "20S80M", "A" * 100), ("b", 0, 905, "80M20S", "A" * 100), ("c", 0, 500, "10S80M10S", "A" * 100), ("d", 0, 500, "10H4S80M", "A" * 84)])
    assert sorted(r["qname"] for r in L.clip_filter(a, contigs, 10).collect()) == ["a", "b", "c"]
    assert sorted(r["qname"] for r in L.clip_filter(a, contigs, None, 0.15).collect()) == ["a", "b", "d"]


def test_mate_fix(reads, contigs):
    a = reads([("p", 99, 100, "50S50M", "A" * 100), ("p", 147, 300, "100M", "A" * 100), ("q", 99, 100, "100M", "A" * 100), ("q", 147, 300, "100M", "A" * 100)])
    got = sorted((r["qname"], r["flag"]) for r in L.clip_filter(a, contigs, 5).collect())
    assert got == [("p", 147 | 8), ("q", 99), ("q", 147)]


@pytest.mark.parametrize("keep,pos,cigar", [((120, 180), 121, "60M"), ((120, 220), 121, "80M"), ((80, 180), 101, "80M")])
def test_crop(spark, reads, keep, pos, cigar):
    bed = spark.createDataFrame([("chr1", *keep)], "contig string, start bigint, end bigint")
    (r,) = L.crop_reads(reads([("r", 0, 101, "100M", "ACGTT" * 20)]), bed).collect()
    assert (r["pos"], r["cigar"], len(r["seq"]), len(r["qual"])) == (pos, cigar, int(cigar[:-1]), int(cigar[:-1]))
    assert r["seq"] == ("ACGTT" * 20)[pos - 101 : pos - 101 + len(r["seq"])]


def test_crop_indels(spark, reads):
    bed = spark.createDataFrame([("chr1", 10, 15), ("chr1", 20, 30)], "contig string, start bigint, end bigint")
    #       ref 5..14 M, insertion at 15, 15..19 deleted, 20..29 M
    a = reads([("r", 0, 6, "2S10M2I5D10M3H", "SS" + "A" * 10 + "GG" + "C" * 10)])
    got = sorted((r["pos"], r["cigar"], r["seq"]) for r in L.crop_reads(a, bed).collect())
    assert got == [(11, "5M", "A" * 5), (21, "10M", "C" * 10)]
    wide = spark.createDataFrame([("chr1", 10, 22)], "contig string, start bigint, end bigint")
    (r,) = L.crop_reads(a, wide).collect()
    assert (r["pos"], r["cigar"], r["seq"]) == (11, "5M2I5D2M", "AAAAAGGCC")


def test_cigar_text_and_lengths(spark):
    df = spark.createDataFrame([("5H3S10M2I4D6M7S1H",), ("*",), ("10Q",)], "c string")
    left, right = C.end_clips(F.col("c"))
    rows = df.select("c", C.text(C.ops(F.col("c"))).alias("t"), C.reference_length(F.col("c")).alias("r"), C.query_length(F.col("c")).alias("q"), left.alias("l"), right.alias("e")).collect()
    assert tuple(rows[0]) == ("5H3S10M2I4D6M7S1H", "5H3S10M2I4D6M7S1H", 20, 34, 8, 8)
    assert rows[1]["r"] == 0 and rows[2]["t"] is None


def test_single_match_read_has_no_right_clip(spark):
    left, right = C.end_clips(F.col("c"))
    assert spark.createDataFrame([("100M",), ("90M10S",)], "c string").select(left.alias("l"), right.alias("r")).collect() == [(0, 0), (0, 10)]


def test_strand_counts_from_pileup_text(spark, variants):
    cases = [("A", "G", "..,,Gg", (2, 2, 1, 1)), ("A", "AT", ".+1T,+1t..,", (2, 1, 1, 1)), ("A", "G", "..,,GGg", (2, 2, 2, 1)), ("A", "G", "^].$,*#Nn", (1, 1, 0, 0)), ("AC", "A", ".-1C,-1c.,", (1, 1, 1, 1))]
    for ref, alt, bases, want in cases:
        p = spark.createDataFrame([("chr1", 7, bases)], "contig string, pos bigint, bases string")
        r = D.with_strand_test(D.strand_counts(variants([(7, ref, alt)]), D.pileup_from_text(p))).first()
        assert (r["ref_fwd"], r["ref_rev"], r["alt_fwd"], r["alt_rev"]) == want, bases
        assert 0 < r["pvalue"] <= 1
    assert abs(D.with_strand_test(D.strand_counts(variants([(7, "A", "G")]), D.pileup_from_text(spark.createDataFrame([("chr1", 7, "..,,GGg")], "contig string, pos bigint, bases string")))).first()["alt_fwd_frac"] - 2 / 3) < 1e-12


def test_position_without_reads_is_tested_as_one(spark, variants):
    empty = spark.createDataFrame([], "contig string, pos bigint, base string, strand string, ins string, del_len int")
    out = D.strand_bias(variants([(7, "A", "G"), (9, "A", "C,G"), (11, "AC", "GT")]), empty, 0.05)
    info = {r["pos"]: r["info"] for r in out.collect()}
    assert info[7]["SB_PVALUE"] == "1.0" and info[7]["SB_ALT_FWD_FRAC"] == "." and info[9] == {} and info[11] == {}


def test_fisher_and_phred(spark):
    df = spark.createDataFrame([(5, 5, 3, 3), (10, 0, 0, 10), (0, 10, 10, 0), (0, 0, 3, 4), (8, 2, 1, 5)], "a int, b int, c int, d int")
    rows = df.select("*", fisher_two_sided("a", "b", "c", "d").alias("p")).collect()
    p = [r["p"] for r in rows]
    assert p[0] == pytest.approx(1.0) and p[1] == pytest.approx(p[2]) and p[1] == pytest.approx(1.0825088224469026e-05) and p[3] == 1.0
    assert p[4] == pytest.approx(0.03496503496503495)
    assert spark.range(1).select(phred(F.lit(0.1)).alias("x"), half_up(F.lit(2.5)).alias("h"), half_up(F.lit(0.1)).alias("o"), half_up(F.lit(0.0)).alias("z")).first()[:] == (10.0, 3, 1, 0)


def test_depth_and_copy_number(spark, reads, contigs):
    a = reads([("a", 0, 1, "10M", "A" * 10), ("b", 0, 6, "5M2D5M", "A" * 10), ("c", 4, 6, "5M", "A" * 5)])
    segments = D.depth_segments(a, contigs)
    got = sorted((r["start"], r["end"], r["depth"]) for r in segments.collect())
    assert got == [(0, 5, 1), (5, 10, 2), (10, 12, 0), (12, 17, 1), (17, 1000, 0)]
    features = spark.createDataFrame([("f", "chr1", 5, 12), ("g", "chr1", 500, 510), ("h", "chr1", 3, 7)], "feature_id string, contig string, start bigint, end bigint")
    assert {r["feature_id"]: r["read_depth"] for r in D.feature_depth(features, segments).collect()} == {"f": 2.0, "g": 0.0, "h": 1.5}
    cover = D.contig_coverage(a, contigs).first()
    assert (cover["numreads"], cover["covbases"], cover["meandepth"]) == (2, 15, 0.02)


def test_genome_coverage_is_length_weighted(spark):
    c = spark.createDataFrame([("chr1", 100, 20.0, 90.0), ("chr2", 300, 10.0, 50.0)], "contig string, length bigint, meandepth double, coverage double")
    assert tuple(D.genome_coverage(c).first()) == (12.5, 60.0, 2)


def test_contig_cnv_longest_first(spark):
    c = spark.createDataFrame([("p", 100, 1, 45.0), ("chr", 900, 0, 10.0), ("tie", 900, 2, 99.0), ("low", 5, 3, 0.5), ("none", 5, 4, 0.0)], "contig string, length bigint, ord int, meandepth double")
    assert {r["contig"]: r["copy_number"] for r in D.contig_cnv(c).collect()} == {"p": 5, "chr": 1, "tie": 10, "low": 1, "none": 0}


def test_duplicates_keep_best(reads):
    a = reads([("x", 0, 10, "5S95M", "A" * 100), ("y", 0, 5, "100M", "A" * 100), ("z", 0, 6, "100M", "A" * 100)])
    assert sorted(r["qname"] for r in L.mark_duplicates(a).collect()) == ["x", "z"]
    flags = {r["qname"]: r["flag"] for r in L.mark_duplicates(a, remove=False).collect()}
    assert flags == {"x": 0, "y": 1024, "z": 0}


def test_call_snps(spark, reads):
    a = reads([(f"r{i}", 16 * (i % 2), 1, "10M", "AAAAGAAAAA" if i < 9 else "AAAAAAAAAA") for i in range(10)])
    ref = spark.createDataFrame([("chr1", p, "A") for p in range(1, 11)], "contig string, pos bigint, ref string")
    (r,) = D.call_snps(D.pileup(a, ref), ref).collect()
    assert (r["pos"], r["alt"], r["ao"], r["dp"], r["gt"]) == (5, "G", 9, 10, "1/1")


def test_base_quality_along_cigars(spark):
    # phred 0 is !, 40 is I: clipped and inserted bases do not count, nor reads without qualities
    rows = [("a", "2S3M1I2M1D1M", "!!III!II5"), ("b", "4M", "IIII"), ("c", "3M", "*"), ("d", "2H2M", "5I")]
    a = spark.createDataFrame([(n, 0, "c", 5, 60, g, "A" * (3 if q == "*" else len(q)), q) for n, g, q in rows], "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string")
    contigs = spark.createDataFrame([("c", 50, 0), ("empty", 9, 1)], "contig string, length bigint, ord int")
    got = {r.contig: (r.numreads, r.meanbaseq) for r in D.contig_coverage(a, contigs).collect()}
    assert got == {"c": (4, (5 * 40 + 20 + 4 * 40 + 20 + 40) / 12), "empty": (0, 0.0)}
    assert {r.meanbaseq for r in D.contig_coverage(a.drop("qual"), contigs).collect()} == {0.0}
    assert L.alignment_stats(a).first()["average_quality"] == (5 * 40 + 20 + 4 * 40 + 20 + 40) / 15


def test_crop_reads_moves_texts_once(spark, reads):
    """Spans are copied to bins, texts are not; repeated reads and reads over several intervals stay as they are."""
    bed = spark.createDataFrame([("chr1", 5, 20), ("chr1", 700, 710), ("chr1", 900, 2000)], "contig string, start long, end long")
    a = reads([("x", 0, 1, "1000M", "ACGT" * 250), ("x", 0, 1, "1000M", "ACGT" * 250), ("y", 0, 701, "30M", "T" * 30), ("z", 0, 30, "10M", "A" * 10)])
    out = L.crop_reads(a, bed)
    got = sorted((r["qname"], r["pos"], len(r["seq"])) for r in out.collect())
    assert got == sorted([("x", 6, 15), ("x", 701, 10), ("x", 901, 100)] * 2 + [("y", 701, 10)])

    def copied(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        own = [node.children().apply(0).output().mkString(",")] if node.nodeName() == "Generate" else []
        return own + [c for child in below for c in copied(child)]

    plan = out._jdf.queryExecution().optimizedPlan()
    assert copied(plan) and not any("seq#" in c for c in copied(plan))
