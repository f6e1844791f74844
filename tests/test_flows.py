from pyspark.sql import functions as F

from haplolake.plans import flows


def test_short_reads_then_core(spark, variants, reads):
    text = "ACGTTGCAAC" * 10
    seqs = spark.createDataFrame([("chr1", text)], "contig string, seq string")
    contigs = spark.createDataFrame([("chr1", 100, 0)], "contig string, length bigint, ord int")
    calls = variants([(15, "T", "A"), (31, "A", "C"), (41, "A", "G", None, "0/1")])
    calls = calls.withColumn("fmt", F.map_concat("fmt", F.create_map(F.lit("DP"), F.lit("30")))).withColumn("qual", F.lit(200.0))
    calls = calls.withColumn("filters", F.array().cast("array<string>"))
    both = calls.unionByName(calls.filter("pos = 15").withColumn("sample", F.lit("t")))
    a = reads([(f"r{i}", 0, 1 + (i % 3) * 30, "30M", text[(i % 3) * 30 : (i % 3) * 30 + 30]) for i in range(9)])
    a = a.withColumn("sample", F.lit("s")).unionByName(a.withColumn("sample", F.lit("t")))
    out = flows.short_reads(both, a, seqs, contigs, min_depth=2)
    got = {r["sample"]: r["seq"] for r in out.consensus.collect()}
    want = list(text)
    want[90:100] = "-" * 10
    want[14] = "a"
    assert got["t"] == "".join(want)
    want[30], want[40] = "c", "n"
    assert got["s"] == "".join(want)
    summary = {r["sample"]: r for r in out.summary.collect()}
    assert (summary["s"]["total"], summary["s"]["pass"], summary["s"]["filtered"]) == (4, 2, 2)
    assert {r["final_gap"] for r in out.qc.collect()} == {10}
    reference = seqs.withColumn("ord", F.lit(0))
    c = flows.core(out.consensus, reference, 0.6)
    rows = {r["sample"]: r["seq"].upper() for r in c.core.collect()}
    assert rows == {"reference": "TA", "s": "AC", "t": "AA"}
    assert {(r["a"], r["b"]): r["distance"] for r in c.core_distances.collect()} == {("reference", "s"): 2, ("reference", "t"): 1, ("s", "t"): 1}
