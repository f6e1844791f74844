import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from haplolake import sources as IO
from haplolake.operators import report as RP
from haplolake.operators.alignments import clip_filter
from haplolake.streaming import follow_clip_filter


def put(path, text, gz=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if gz else text.encode())
    return str(path)


def lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


VCF = """##fileformat=VCFv4.2
##contig=<ID=c1,length=100>
##contig=<ID=c2,length=50>
##contig=<ID=c1,length=7>
##contig=<ID=zero,length=0>
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, with a comma and \\"quotes\\"">
##INFO=<ID=ZERODEPTH,Number=0,Type=Flag,Description="none">
##INFO=<ID=AF,Number=A,Type=Float,Description="list">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="d">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
c2\t5\t.\tA\tT,C\t50.5\tPASS\tDP=7;AF=0.1,0.2\tGT:DP\t1/1:7\t0/1
c1\t9\trs1\tAC\tA\t.\t.\tZERODEPTH;BCSQ=@3,missense|g|t\tGT\t0/0\t.
short\tline
c1\t3\t.\tG\tC\t60\tLowQual;LowDepth\t.\tGT:DP\t1/1:x\t1/1:4
"""


@pytest.mark.parametrize("gz", [False, True])
def test_vcf(spark, tmp_path, gz):
    path = put(tmp_path / ("a.vcf.gz" if gz else "a.vcf"), VCF, gz)
    v = IO.read_vcf(spark, path)
    rows = {(r["chrom"], r["pos"], r["sample"]): r for r in v.collect()}
    assert len(rows) == 6
    r = rows["c2", 5, "s1"]
    assert (r["alts"], r["qual"], r["filters"], r["info"]["AF"], r["fmt"]) == (["T", "C"], 50.5, ["PASS"], "0.1,0.2", {"GT": "1/1", "DP": "7"})
    assert rows["c2", 5, "s2"]["fmt"] == {"GT": "0/1"} and rows["c1", 9, "s2"]["fmt"] == {} and rows["c1", 9, "s1"]["filters"] == []
    header = {(h["kind"], h["id"]): h for h in IO.read_vcf_header(spark, path).collect()}
    assert header["contig", "c1"]["length"] == 100 and ("contig", "zero") not in header
    assert header["INFO", "DP"]["description"] == 'Depth, with a comma and "quotes"' and header["INFO", "DP"]["type"] == "Integer"
    table = RP.report_table(v, IO.read_vcf_header(spark, path)).filter("sample = 's1'")
    assert dict(table.dtypes)["info_DP"] == "bigint" and dict(table.dtypes)["info_AF"] == "string" and dict(table.dtypes)["info_ZERODEPTH"] == "boolean"
    got = {r["pos"]: r for r in table.collect()}
    assert got[9]["info_ZERODEPTH"] is True and got[9]["consequence"] == "missense" and got[9]["transcript"] == "t" and got[3]["fmt_DP"] is None
    contigs = spark.createDataFrame([("c1", 100, 0), ("c2", 50, 1)], "contig string, length bigint, ord int")
    IO.write_vcf(v, str(tmp_path / "out"), contigs, ["s1", "s2"], ['##INFO=<ID=END,Number=1,Type=Integer,Description="mine">'])
    text = lines(tmp_path / "out")
    assert text[0] == "##fileformat=VCFv4.2" and sum(x.startswith("##INFO=<ID=END") for x in text) == 1
    body = [x for x in text if not x.startswith("#")]
    assert [x.split("\t")[:2] for x in body] == [["c1", "3"], ["c1", "9"], ["c2", "5"]]
    assert body[2].split("\t")[3:] == ["A", "T,C", "50.5", "PASS", "DP=7;AF=0.1,0.2", "GT:DP", "1/1:7", "0/1:."]
    back = IO.read_vcf(spark, str(tmp_path / "out"))
    assert back.count() == 6


def test_vcf_without_samples_uses_file_name(spark, tmp_path):
    path = put(tmp_path / "iso.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nc\t1\t.\tA\tT\t.\t.\t.\n")
    assert [r["sample"] for r in IO.read_vcf(spark, path).collect()] == ["iso"]
    assert IO.read_vcf(spark, path, sample="x").first()["sample"] == "x"


def test_sam(spark, tmp_path):
    path = put(tmp_path / "a.sam", "@HD\tVN:1.6\tSO:queryname\n@SQ\tSN:c1\tLN:99\n@RG\tID:a\tPL:ILLUMINA\nr1\t0\tc1\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tSA:Z:a:b\n@r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\nbad\t1\n")
    rows = {r["qname"]: r for r in IO.read_sam(spark, path).collect()}
    assert set(rows) == {"r1", "@r2"} and rows["r1"]["tags"] == {"NM": "1", "SA": "a:b"} and rows["r1"]["pos"] == 5
    head = {r["kind"]: r["tags"] for r in IO.read_sam_header(spark, path).collect()}
    assert head["SQ"] == {"SN": "c1", "LN": "99"} and head["HD"]["SO"] == "queryname" and head["RG"]["PL"] == "ILLUMINA"


def test_bed_gff_paf_tables(spark, tmp_path):
    bed = put(tmp_path / "a.bed", "#x\nc\t5\t9\tn\n\nc\t3\t3\n")
    assert [tuple(r) for r in IO.read_bed(spark, bed).collect()] == [("c", 5, 9, "n")]
    broken = put(tmp_path / "b.bed", "c\t9\t5\nc\tx\t5\nc\t1\t2\n")
    with pytest.raises(Exception, match="invalid BED row"):
        IO.read_bed(spark, broken).collect()
    assert IO.read_bed(spark, broken, strict=False).count() == 1
    gff = put(tmp_path / "a.gff", "##gff\nc\tx\tCDS\t1\t9\t.\t+\t0\tID=a;gene=g=h\nc\tx\tgene\t1\t9\t.\t+\t.\tName=n\nc\tx\tCDS\t20\t30\t.\t-\t0\tnote\n")
    rows = IO.read_gff(spark, gff).collect()
    assert {r["feature_id"] for r in rows} == {"a", "c:20-30"} and rows[0]["type"] == "CDS"
    assert [r["feature_id"] for r in IO.read_gff(spark, gff, "gene").collect()] == ["n"]
    assert {r["attributes"].get("gene") for r in rows} == {"g=h", None}
    paf = put(tmp_path / "a.paf", "q\t100\t0\t90\t+\tc\t500\t10\t100\t80\t90\t60\ttp:A:P\tcm:i:5\tde:f:0.01\nshort\t1\n")
    (p,) = IO.read_paf(spark, paf).collect()
    assert (p["contig"], p["start"], p["end"], p["mapq"], p["tags"]) == ("c", 10, 100, 60, {"tp": "P", "cm": "5", "de": "0.01"})
    coords = put(tmp_path / "a.coords", "\t".join(["9", "3", *"abcdefghi", "ref", "qry"]) + "\nshort\t1\n")
    assert [tuple(r) for r in IO.read_coords(spark, coords).collect()] == [("ref", 9, 3)]


def test_delta(spark, tmp_path):
    text = "/r.fa /q.fa\nNUCMER\n>c1 q1 8 9\n1 8 1 8 0 0 0\n0\n2 7 7 2 1 1 0\n4\n1\n-3\n0\n>c2 q2 8 8\n1 8 1 8 3 3 0\n-7\n0\n"
    rows = sorted((r["ref"], r["qry"], r["qry_start"], r["errors"], r["offsets"]) for r in IO.read_delta(spark, put(tmp_path / "a.delta", text)).collect())
    assert rows == [("c1", "q1", 1, 0, []), ("c1", "q1", 7, 1, [4, 1, -3]), ("c2", "q2", 1, 3, [-7])]


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "a.fa", ">c1 some text\nACG\nTa\n>c2\nGG>\n\n>c3\n")
    rows = [(r["contig"], r["seq"]) for r in IO.read_fasta(spark, path).orderBy("ord").collect()]
    assert rows == [("c1", "ACGTa"), ("c2", "GG>"), ("c3", "")]
    assert IO.read_fasta(spark, path, upper=True).filter("contig = 'c1'").first()["seq"] == "ACGTA"
    IO.write_fasta(spark.createDataFrame([("a", "AC"), ("b", "")], "sample string, seq string"), str(tmp_path / "o"), order="sample")
    assert lines(tmp_path / "o") == [">a", "AC", ">b", ""]


def test_fastq_framing_over_splits(spark, tmp_path):
    rng = random.Random(2)
    want, text = {}, []
    for i in range(3000):
        n = rng.randrange(1, 400)
        seq, qual = "".join(rng.choice("ACGT") for _ in range(n)), "@" + "".join(rng.choice("@+I") for _ in range(n - 1))
        want[f"r{i}"] = (seq, qual)
        text.append(f"@r{i}/1 extra\n{seq}\n+\n{qual}\n")
    one = put(tmp_path / "x_R1.fastq", "".join(text))
    two = put(tmp_path / "x_R2.fastq.gz", "@r0/2\nAC\n+\nII\n", gz=True)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 17))
    try:
        reads = IO.read_fastq(spark, one, two).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert {r["read_id"]: (r["seq"], r["qual"]) for r in reads if r["mate"] == 1} == want
    assert [(r["read_id"], r["seq"]) for r in reads if r["mate"] == 2] == [("r0", "AC")]


def test_tool_tables(spark, tmp_path):
    flag = put(tmp_path / "f.txt", "20 + 0 in total (QC-passed reads + QC-failed reads)\n18 + 0 primary\n1 + 0 secondary\n1 + 0 supplementary\n2 + 0 duplicates\n2 + 0 primary duplicates\n19 + 0 mapped (95.00% : N/A)\n17 + 0 primary mapped (94.44% : N/A)\n16 + 0 properly paired (88.89% : N/A)\n")
    r = IO.read_flagstat(spark, flag).first()
    assert (r["total"], r["primary"], r["duplicates"], r["mapped"], r["mapped_percent"], r["properly_paired_percent"]) == (20, 18, 2, 19, 95.0, 88.89)
    stats = put(tmp_path / "s.txt", "# x\nSN\treads mapped:\t19\nSN\terror rate:\t1.5e-03\t# note\nSN\tother:\t1\n")
    s = IO.read_samstats(spark, stats).first()
    assert (s["reads_mapped"], s["error_rate"], s["average_length"]) == (19.0, 0.0015, None)
    named = put(tmp_path / "c.tsv", "#rname\tstartpos\tendpos\tmeandepth\tcoverage\nchr1\t1\t100\t20\t90\nchr2\t1\t300\t10\t50\n")
    bare = put(tmp_path / "d.tsv", "chr1\t1\t100\t5\t90\t90\t20\t30\t60\n")
    assert [(r["contig"], r["length"], r["meandepth"], r["coverage"]) for r in IO.read_coverage(spark, named).orderBy("ord").collect()] == [("chr1", 100, 20.0, 90.0), ("chr2", 300, 10.0, 50.0)]
    assert (lambda r: (r["length"], r["meandepth"], r["meanmapq"]))(IO.read_coverage(spark, bare).first()) == (100, 20.0, 60.0)
    assert [tuple(r) for r in IO.read_depth(spark, put(tmp_path / "x.depth", "c\t1\t5\n")).collect()] == [("c", 1, 5)]
    assert IO.read_mpileup(spark, put(tmp_path / "p", "c\t7\tA\t3\t..,\tIII\n")).first()["bases"] == "..,"
    assert [(r["contig"], r["length"]) for r in IO.read_fai(spark, put(tmp_path / "r.fai", "w\t197394\t10\t60\t61\nbad\tx\n")).collect()] == [("w", 197394)]


def test_sample_tables_and_lists(spark, tmp_path):
    csv = put(tmp_path / "s.csv", "sample,type,left\na,short, x \nb,asm,\n")
    assert [tuple(r) for r in IO.read_samples(spark, csv).orderBy("sample").collect()] == [("a", "short", "x"), ("b", "asm", None)]
    js = put(tmp_path / "s.json", '{"reference": "r", "samples": {"a": {"type": "short", "left": "x"}, "b": {"type": "asm"}}}')
    assert [tuple(r) for r in IO.read_samples(spark, js).orderBy("sample").collect()] == [("a", "x", "short"), ("b", None, "asm")]
    assert IO.read_metadata(spark, put(tmp_path / "m.tsv", "id\tx\na\t1\n")).first()["x"] == "1"
    assert IO.read_file_list(spark, put(tmp_path / "l.txt", "# c\n/a.vcf\n\n /b.vcf\n")) == ["/a.vcf", "/b.vcf"]


def test_scan_and_manifest(spark, tmp_path):
    put(tmp_path / "in" / "a_R1.fastq.gz", "@r1\nA\n+\nI\n", gz=True)
    put(tmp_path / "in" / "x" / "b.fa", ">c\nA\n")
    put(tmp_path / "in" / "x" / "y" / "z" / "deep.fa", ">c\n")
    put(tmp_path / "in" / "empty.fa", "")
    root = str(tmp_path / "in")
    name = lambda df: {r["path"].rsplit("/", 1)[1]: r["first_line"] for r in df.collect()}
    assert name(IO.scan_files(spark, root)) == {"a_R1.fastq.gz": "@r1", "b.fa": ">c", "deep.fa": ">c"}
    assert set(name(IO.scan_files(spark, root, max_depth=1))) == {"a_R1.fastq.gz", "b.fa"}
    assert set(name(IO.scan_files(spark, root, exclude="*.fa"))) == {"a_R1.fastq.gz"}
    assert set(name(IO.scan_files(spark, root, exclude=r"^b"))) == {"a_R1.fastq.gz", "deep.fa"}
    m = {r["path"].rsplit("/", 1)[1]: r for r in IO.file_manifest(spark, root, {".fa": "sequence"}).collect()}
    assert m["b.fa"]["size"] == "5 B" and m["b.fa"]["description"] == "sequence" and len(m["b.fa"]["md5"]) == 32


def test_phylip_cells_are_dealt_out_once(spark):
    """A cell goes to its line at once, also without broadcasts by size; of repeated pairs the largest counts."""
    d = spark.createDataFrame([("a", "b", 3), ("b", "a", 10), ("a", "b", 9), ("a", "c", 4), ("x", "a", 7)], "a string, b string, distance bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = IO.phylip_lines(d, ["a", "b", "c"])
        plan = lines._jdf.queryExecution().sparkPlan().toString() + lines._jdf.queryExecution().executedPlan().toString()
        assert [r["value"] for r in lines.orderBy("at").collect()] == ["3", "a\t0\t10\t4", "b\t10\t0\t0", "c\t4\t0\t0"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = plan.split("AdaptiveSparkPlan")[-1].count("Exchange hashpartitioning")
    assert dealt <= 2, plan


def test_writers(spark, tmp_path):
    bed = spark.createDataFrame([("b", 5, 9), ("a", 3, 5), ("a", 5, 7)], "contig string, start bigint, end bigint")
    IO.write_bed(bed, str(tmp_path / "bed"))
    assert lines(tmp_path / "bed") == ["a\t3\t7", "b\t5\t9"]
    t = spark.createDataFrame([("x", 1.5, None), (None, None, 2)], "a string, b double, c int")
    IO.write_tsv(t.coalesce(1), str(tmp_path / "tsv"), {"b": "two"})
    assert lines(tmp_path / "tsv") == ["a\tb\tc", "x\t1.50\t", "\t\t2"]
    d = spark.createDataFrame([("a", "b", 3), ("a", "c", 0), ("b", "c", 4)], "a string, b string, distance bigint")
    IO.write_phylip(d, ["a", "b", "c"], str(tmp_path / "phy"))
    assert lines(tmp_path / "phy") == ["3", "a\t0\t3\t0", "b\t3\t0\t4", "c\t0\t4\t0"]
    IO.write_phylip(d.filter("b <> 'c'"), ["c", "b", "x", "a"], str(tmp_path / "gaps"))
    assert lines(tmp_path / "gaps") == ["4", "c\t0\t0\t0\t0", "b\t0\t0\t0\t3", "x\t0\t0\t0\t0", "a\t0\t3\t0\t0"]
    half = spark.createDataFrame([(0.125, 2.5), (0.375, None), (-1.5, 1e-9)], "a double, b double")
    IO.write_tsv(half.coalesce(1), str(tmp_path / "half"), {"a": "two", "b": "six"})
    assert lines(tmp_path / "half") == ["a\tb", "0.12\t2.500000", "0.38\t", "-1.50\t0.000000"]


@pytest.mark.parametrize("rows", [[], [("c", 1, "x")], [("c", 2, 'say "x",'), (None, 5, None), ("c", 1, "x"), ("c", 1, "x"), ("b", None, ""), ("c", 2, ",y")] * 3])
def test_report_is_one_document(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "chrom string, pos bigint, note string").repartition(3)
    IO.report_json(table, ["GT"], ["DP", "AO"], str(tmp_path / "rep"))
    text = "\n".join(lines(tmp_path / "rep"))
    got = json.loads(text)
    assert (got["sampleFields"], got["infoFields"]) == (["GT"], ["DP", "AO"])
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)
    found = [tuple(v.values()) for v in got["variants"]]
    assert [key(r) for r in found] == sorted(key(r) for r in rows)
    assert sorted(found, key=str) == sorted(rows, key=str)


def test_manifest_of_a_file_over_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)  # sparse: no disk is used
    digest = hashlib.md5()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size & ((1 << 20) - 1)))
    row = IO.file_manifest(spark, str(tmp_path)).first()
    assert (row["bytes"], row["size"], row["md5"]) == (size, "2.0 GB", digest.hexdigest())


def test_following_a_folder(spark, tmp_path, reads):
    contigs = spark.createDataFrame([("chr1", 1000, 0)], "contig string, length bigint, ord int")
    a = reads([("a", 0, 100, "100M", "A" * 100), ("b", 0, 200, "30S70M", "A" * 100)])
    folder = str(tmp_path / "in")
    a.write.parquet(folder)
    for _ in range(2):
        follow_clip_filter(spark, folder, a.schema, contigs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        a.withColumn("qname", F.concat("qname", F.lit("2"))).write.mode("append").parquet(folder)
    got = sorted(r["qname"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["a", "a2"]
    assert clip_filter(a, contigs, 10, fix_mate=False).count() == 1
