"""Queries of the text formats: lines are built from the tables, parsed, and held against the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions import alleles as A
from haplolake.functions import fields as X
from haplolake.functions import names as N
from haplolake.functions.numbers import human_size, phred
from haplolake.operators import cohort as K
from haplolake.operators import depth as D
from haplolake.plans.interval_queries import _SPANS
from haplolake.plans.registry import intervals, query
from haplolake.plans.views import table, view
from haplolake.sources import readers as R
from haplolake.sources import writers as W


def _tabs(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cells])


def _lines(df: DataFrame, value: Column, file: Column | None = None, order: Column | None = None) -> DataFrame:
    return df.select(value.alias("value"), (F.lit("f") if file is None else file).alias("file"), (F.lit(0).cast("long") if order is None else order.cast("long")).alias("rec_no"))


def _one(spark, text: str) -> DataFrame:
    """One line that is not a constant of the plan, as lines of a file are not."""
    return _lines(spark.range(1), F.concat(F.lit(text), F.substring(F.col("id").cast("string"), 2, 1)))


def _text(c: str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


@query(
    "parse_vcf",
    """SELECT sample, chrom, pos, ref, alt, qual, 'LowQual,PASS' AS filters, CAST(dp AS STRING) AS info_dp, 'true' AS flag, gt, CAST(dp AS STRING) AS fmt_dp FROM v_variants""",
    ("v_variants",),
)
def parse_vcf(spark, d):
    v = view(spark, d, "v_variants")
    rows = _tabs("chrom", "pos", F.lit("."), "ref", "alt", "qual", F.lit("PASS;LowQual"), F.concat(F.lit("ZERODEPTH;DP="), F.col("dp").cast("string")), F.lit("GT:DP"), F.concat_ws(":", "gt", F.col("dp").cast("string")))
    head = _lines(v.select("sample").distinct(), _tabs(*[F.lit(c) for c in "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split(" ")], "sample"), F.col("sample"))
    out = R.parse_vcf(_lines(v, rows, F.col("sample")).unionByName(head))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return out.select(
        "sample", "chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), "qual", F.array_join(F.array_sort("filters"), ",").alias("filters"), get("info", "DP").alias("info_dp"),
        F.map_contains_key("info", "ZERODEPTH").cast("string").alias("flag"), get("fmt", "GT").alias("gt"), get("fmt", "DP").alias("fmt_dp"),
    )


@query(
    "parse_vcf_header",
    """SELECT 'INFO' AS kind, 'P' || p_partkey AS id, '1' AS number, 'String' AS type, p_name || ' of "size" ' || p_size AS description, CAST(NULL AS BIGINT) AS length FROM part
       UNION ALL SELECT 'contig', 'c' || s_suppkey, NULL, NULL, NULL, s_suppkey * 100 FROM supplier WHERE s_suppkey > 0""",
)
def parse_vcf_header(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    quoted = F.concat("p_name", F.lit(' of \\"size\\" '), F.col("p_size").cast("string"))
    info = F.concat(_text("p_partkey", "##INFO=<ID=P"), F.lit(",Number=1,Type=String,Description=\""), quoted, F.lit("\">"))
    contig = F.concat(_text("s_suppkey", "##contig=<ID=c"), F.lit(",length="), (F.col("s_suppkey") * 100).cast("string"), F.lit(">"))
    lines = _lines(p, info, None, F.col("p_partkey")).unionByName(_lines(p, info, None, F.col("p_partkey") + 1_000_000_000)).unionByName(_lines(s, contig, None, F.col("s_suppkey")))
    return R.parse_vcf_header(lines).select("kind", "id", "number", "type", "description", "length")


@query(
    "parse_sam",
    "SELECT qname, flag, rname, pos, mapq, cigar, seq_len, CAST(mapq % 5 AS STRING) AS nm FROM v_alignments",
    ("v_alignments",),
)
def parse_sam(spark, d):
    a = view(spark, d, "v_alignments")
    text = _tabs("qname", "flag", "rname", "pos", "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.repeat(F.lit("A"), F.col("seq_len")), F.repeat(F.lit("I"), F.col("seq_len")), F.concat(F.lit("NM:i:"), (F.col("mapq") % 5).cast("string")))
    head = _one(spark, "@HD\tVN:1.6")
    out = R.parse_sam(_lines(a, text).unionByName(head))
    return out.select("qname", "flag", "rname", "pos", "mapq", "cigar", F.length("seq").alias("seq_len"), F.try_element_at("tags", F.lit("NM")).alias("nm"))


@query("parse_sam_header", "SELECT 'SQ' AS kind, contig, CAST(length AS STRING) AS length FROM v_contigs", ("v_contigs",))
def parse_sam_header(spark, d):
    c = view(spark, d, "v_contigs")
    out = R.parse_sam_header(_lines(c, F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.col("length").cast("string"))))
    return out.select("kind", F.col("tags")["SN"].alias("contig"), F.col("tags")["LN"].alias("length"))


@query("parse_bed", "SELECT contig, start_, end_ FROM v_intervals", ("v_intervals",))
def parse_bed(spark, d):
    i = view(spark, d, "v_intervals")
    more = _one(spark, "# comment").unionByName(_one(spark, "chr0\t5\t5"))
    return R.parse_bed(_lines(i, _tabs("contig", "start_", "end_", F.lit("n"))).unionByName(more)).select("contig", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query("parse_gff", "SELECT contig, feature_id, gff_start, gff_end, gff_start - 1 AS start_, 'a b' AS note FROM v_features", ("v_features",))
def parse_gff(spark, d):
    f = view(spark, d, "v_features")
    text = lambda kind: _tabs("contig", F.lit("s"), F.lit(kind), "gff_start", "gff_end", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), "feature_id", F.lit(";Note=a b")))
    out = R.parse_gff(_lines(f, text("CDS")).unionByName(_lines(f, text("gene"))), "CDS")
    return out.select("contig", "feature_id", "gff_start", "gff_end", F.col("start").alias("start_"), F.col("attributes")["Note"].alias("note"))


@query("parse_paf", "SELECT qname, tname AS contig, tstart AS start_, tend AS end_, mapq, tp, CAST(s1 AS STRING) AS s1 FROM v_paf", ("v_paf",))
def parse_paf(spark, d):
    p = view(spark, d, "v_paf")
    zero = F.lit("0")
    text = _tabs("qname", "qlen_aligned", zero, "qlen_aligned", F.lit("+"), "tname", F.lit("99"), "tstart", "tend", zero, zero, "mapq", F.concat(F.lit("tp:A:"), "tp"), F.concat(F.lit("s1:i:"), F.col("s1").cast("string")))
    out = R.parse_paf(_lines(p, text))
    return out.select("qname", "contig", F.col("start").alias("start_"), F.col("end").alias("end_"), "mapq", F.col("tags")["tp"].alias("tp"), F.col("tags")["s1"].alias("s1"))


@query("parse_coords", "SELECT contig, end_ AS s1, start_ AS e1 FROM v_intervals", ("v_intervals",))
def parse_coords(spark, d):
    i = view(spark, d, "v_intervals")
    text = _tabs("end_", "start_", *[F.lit(str(k)) for k in range(9)], "contig", F.lit("query"))
    return R.parse_coords(_lines(i, text).unionByName(_one(spark, "NUCMER")))


@query(
    "parse_delta",
    """SELECT 'r' || o_orderkey AS ref, 'q' || o_custkey AS qry, 1 AS ref_start, CAST(o_orderkey % 900 + 100 AS INTEGER) AS ref_end, CAST(o_custkey % 90 + 9 AS INTEGER) AS qry_start, 1 AS qry_end,
       CAST(o_orderkey % 12 AS INTEGER) AS errors, CASE WHEN o_orderkey % 2 = 0 THEN '4,-1' ELSE '' END AS offsets FROM orders""",
)
def parse_delta(spark, d):
    o = table(spark, d, "orders")
    n = lambda c: c.cast("string")
    head = F.concat_ws(" ", _text("o_orderkey", "r"), _text("o_custkey", "q"), F.lit("1000"), F.lit("99"))
    block = F.concat_ws(" ", F.lit("1"), n(F.col("o_orderkey") % 900 + 100), n(F.col("o_custkey") % 90 + 9), F.lit("1"), n(F.col("o_orderkey") % 12), F.lit("0"), F.lit("0"))
    runs = F.when(F.col("o_orderkey") % 2 == 0, F.lit("4\n-1\n0")).otherwise("0")
    text = o.select(F.concat_ws("\n", head, block, runs).alias("value"))
    first = spark.range(1).select(F.lit("/a/ref.fa /a/qry.fa\nNUCMER").alias("value"))
    return R.parse_delta(text.unionByName(first)).withColumn("offsets", F.array_join("offsets", ","))


@query("parse_fasta", "SELECT contig, contig || ' of ' || sample AS description, seq FROM v_sequences", ("v_sequences",))
def parse_fasta(spark, d):
    s = view(spark, d, "v_sequences")
    folded = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    text = s.select(F.concat("contig", F.lit(" of "), "sample", F.lit("\n"), folded).alias("value"), F.lit("f").alias("file"), F.col("ord"))
    return R.parse_fasta(text, upper=True).select("contig", "description", "seq")


@query("parse_fastq", "SELECT 'r' || contig AS read_id, 1 AS mate, seq, repeat('@', CAST(n AS INTEGER)) AS qual FROM v_sequences", ("v_sequences",))
def parse_fastq(spark, d):
    s = view(spark, d, "v_sequences").filter("n >= 0")
    parts = F.array(F.concat(F.lit("@r"), "contig", F.lit("/1 x")), F.col("seq"), F.lit("+"), F.repeat(F.lit("@"), F.col("n").cast("int")))
    lines = s.select(F.lit("f").alias("file"), F.col("ord"), F.posexplode(parts).alias("i", "value")).select("file", (F.col("ord") * 4 + F.col("i")).alias("line"), "value")
    return R.parse_fastq(lines).select("read_id", "mate", "seq", "qual")


@query("parse_fai", "SELECT contig, length FROM v_contigs", ("v_contigs",))
def parse_fai(spark, d):
    c = view(spark, d, "v_contigs")
    return R.parse_fai(_lines(c, _tabs("contig", "length", F.lit("9"))).unionByName(_one(spark, "bad\tx"))).select("contig", "length")


@query(
    "parse_mpileup",
    """SELECT chrom AS contig, pos, strand, base, coalesce(ins, '') AS ins, coalesce(del_len, 0) AS del_len, count(*) AS n FROM (
         SELECT chrom, pos, '+' AS strand, '.' AS base, CAST(NULL AS STRING) AS ins, NULL AS del_len FROM v_variants UNION ALL SELECT chrom, pos, '-', 'T', 'AC', NULL FROM v_variants
         UNION ALL SELECT chrom, pos, '+', 'G', NULL, 2 FROM v_variants) GROUP BY ALL""",
    ("v_variants",),
)
def parse_mpileup(spark, d):
    v = view(spark, d, "v_variants")
    rows = R.parse_mpileup(_lines(v, _tabs("chrom", "pos", F.lit("N"), F.lit("3"), F.lit("^I.t+2acG-2NN$"), F.lit("III"))))
    seen = D.pileup_from_text(rows).withColumn("ins", F.coalesce("ins", F.lit(""))).withColumn("del_len", F.coalesce("del_len", F.lit(0)))
    return seen.groupBy("contig", "pos", "strand", "base", "ins", "del_len").agg(F.count("*").alias("n"))


@query(
    "parse_coverage",
    "SELECT 's' || s_suppkey AS contig, CAST(s_suppkey * 10 AS BIGINT) AS length, CAST(s_nationkey AS DOUBLE) AS numreads, s_acctbal AS meandepth, CAST(NULL AS DOUBLE) AS meanmapq FROM supplier",
)
def parse_coverage(spark, d):
    s = table(spark, d, "supplier")
    head = _one(spark, "#rname\tstartpos\tendpos\tmeandepth\tnumreads")
    text = _tabs(_text("s_suppkey", "s"), F.lit("1"), F.col("s_suppkey") * 10, F.col("s_acctbal").cast("double"), "s_nationkey")
    return R.parse_coverage(_lines(s, text).unionByName(head)).select("contig", "length", "numreads", "meandepth", "meanmapq")


@query(
    "parse_flagstat",
    """SELECT 'o' || o_orderkey AS file, o_orderkey + 100 AS total, o_custkey + 50 AS "primary", o_orderkey % 7 AS duplicates, o_custkey AS mapped, (o_orderkey % 10000) / 100.0e0 AS mapped_percent FROM orders""",
)
def parse_flagstat(spark, d):
    """One report for each order."""
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def line(count: Column, text: str, share: Column | None = None) -> Column:
        tail = [] if share is None else [F.lit(" ("), F.format_string("%.2f", share), F.lit("% : N/A)")]
        return F.concat(count.cast("string"), F.lit(f" + 0 {text}"), *tail)

    share = k % 10000 / F.lit(100.0)
    texts = F.array(
        line(k + 100, "in total (QC-passed reads + QC-failed reads)"), line(c + 50, "primary"), line(k % 7, "duplicates"), line(c, "mapped", share), line(k + 3, "primary mapped", share / 2)
    )
    lines = o.select("o_orderkey", F.explode(texts).alias("v"))
    return R.parse_flagstat(_lines(lines, F.col("v"), _text("o_orderkey", "o"))).select("file", "total", "primary", "duplicates", "mapped", "mapped_percent")


@query(
    "parse_samstats",
    """SELECT 'o' || o_orderkey AS file, CAST(o_custkey AS DOUBLE) AS reads_mapped, CAST(o_orderkey % 97 AS DOUBLE) / 64 AS error_rate,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS average_quality FROM orders""",
)
def parse_samstats(spark, d):
    """One report for each order; some lack the average quality."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    texts = F.array(
        _tabs(F.lit("SN"), F.lit("reads mapped:"), "o_custkey", F.lit("# note")), _tabs(F.lit("SN"), F.lit("error rate:"), k % 97 / F.lit(64.0)),
        F.when(k % 3 == 0, _tabs(F.lit("SN"), F.lit("average quality:"), k % 40)), F.lit("FFQ\t1"),
    )
    lines = o.select("o_orderkey", F.explode(texts).alias("v")).where("v IS NOT NULL")
    return R.parse_samstats(_lines(lines, F.col("v"), _text("o_orderkey", "o"))).select("file", "reads_mapped", "error_rate", "average_quality")


_SAMPLES = ["AF", "AO", "NF", "NO", "RF", "RO"]
_TAB = " || chr(9) || "
_HEAD = ["##fileformat=VCFv4.2", *W.DEFINITIONS.values()]


@query(
    "vcf_text",
    f"""SELECT chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || CAST(qual AS BIGINT) || chr(9) || 'PASS' || chr(9) || 'DP=' || dp || chr(9) || 'GT' || chr(9) ||
       {_TAB.join(f"coalesce(max(gt) FILTER (WHERE sample = '{n}'), '.')" for n in _SAMPLES)} AS value
       FROM v_variants GROUP BY chrom, pos, ref, alt, qual, dp
       UNION ALL SELECT '##contig=<ID=' || contig || ',length=' || length || '>' FROM v_contigs
       UNION ALL SELECT unnest([{", ".join("'" + h.replace("'", "''") + "'" for h in _HEAD)}])
       UNION ALL SELECT concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', {", ".join(f"'{n}'" for n in _SAMPLES)})""",
    ("v_variants", "v_contigs"),
)
def vcf_text(spark, d):
    """All samples' records and the header."""
    rows = view(spark, d, "v_variants").select(
        "sample", "chrom", "pos", F.lit(".").alias("id"), "ref", F.array("alt").alias("alts"), "qual", F.array(F.lit("PASS")).alias("filters"),
        F.create_map(F.lit("DP"), F.col("dp").cast("string")).alias("info"), F.create_map(F.lit("GT"), F.col("gt")).alias("fmt"), F.lit(0).cast("long").alias("rec_no"),
    )
    return W.vcf_lines(rows, view(spark, d, "v_contigs"), list(_SAMPLES)).select("value")


@query("bed_text", "SELECT g || chr(9) || s || chr(9) || e AS value FROM merged", ("v_intervals",), _SPANS)
def bed_text(spark, d):
    return W.bed_lines(intervals(spark, d)).select("value")


@query("fasta_text", "SELECT '>' || contig || chr(10) || seq AS value FROM v_sequences", ("v_sequences",))
def fasta_text(spark, d):
    return W.fasta_lines(view(spark, d, "v_sequences"), "contig").select("value")


@query(
    "tsv_cells",
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, printf('%.2f', l_quantity / 8.0e0) AS two, printf('%.4f', l_partkey / 32.0e0) AS four,
       CASE WHEN l_partkey % 7 <> 0 THEN printf('%.6f', l_suppkey / 128.0e0) END AS six, l_returnflag FROM lineitem""",
)
def tsv_cells(spark, d):
    """Many of the values lie halfway between two numbers of the format."""
    t = table(spark, d, "lineitem")
    six = F.when(F.col("l_partkey") % 7 != 0, F.col("l_suppkey") / 128.0)
    rows = t.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 8.0).alias("two"), (F.col("l_partkey") / 32.0).alias("four"), six.alias("six"), "l_returnflag"
    )
    return W.tsv_cells(rows, {"two": "two", "four": "four", "six": "six"})


@query(
    "phylip_text",
    """SELECT CAST((SELECT count(*) FROM names) AS VARCHAR) AS value UNION ALL
       SELECT x.sample || chr(9) || string_agg(CAST(coalesce(d.n, 0) AS VARCHAR), chr(9) ORDER BY y.sample) FROM names x CROSS JOIN names y LEFT JOIN differ d ON d.a = x.sample AND d.b = y.sample GROUP BY x.sample""",
    ("v_msa_sites",),
    """names AS (SELECT DISTINCT sample FROM v_msa_sites), known AS (SELECT * FROM v_msa_sites WHERE base IN ('A', 'C', 'G', 'T')),
    differ AS (SELECT x.sample AS a, y.sample AS b, count(*) AS n FROM known x JOIN known y ON x.site = y.site AND x.base <> y.base GROUP BY 1, 2)""",
)
def phylip_text(spark, d):
    """Only pairs that differ are given: the writer fills in the zeros."""
    sites = view(spark, d, "v_msa_sites")
    names = sorted(r["sample"] for r in sites.select("sample").distinct().collect())
    return W.phylip_lines(K.snp_distances(sites, tile=128, least=1).filter("distance > 0"), names).select("value")


@query(
    "report_document",
    """SELECT part, value FROM (SELECT 1 AS part, CASE WHEN row_number() OVER (ORDER BY chrom, pos, text) = 1 THEN '' ELSE ',' END || text AS value
         FROM (SELECT chrom, pos, CAST(to_json(struct_pack(sample := sample, chrom := chrom, pos := pos, ref := ref, alt := alt, dp := dp, gt := CASE WHEN dp % 5 > 0 THEN gt END)) AS VARCHAR) AS text FROM v_variants))
       UNION ALL SELECT 0, '{"variants": [' UNION ALL SELECT 2, '], "sampleFields": ["GT","DP"], "infoFields": ["BCSQ"]}'""",
    ("v_variants",),
)
def report_document(spark, d):
    v = view(spark, d, "v_variants").select("sample", "chrom", "pos", "ref", "alt", "dp", F.when(F.col("dp") % 5 > 0, F.col("gt")).alias("gt"))
    return W.report_lines(v, ["GT", "DP"], ["BCSQ"], ["chrom", "pos"]).select("part", "value")


# --- column helpers ------------------------------------------------------------------------


@query(
    "info_round_trip",
    "SELECT o_orderkey, 'A=' || o_custkey || ';FLAG;B=' || o_orderpriority AS info, CAST(o_custkey AS STRING) AS a FROM orders",
)
def info_round_trip(spark, d):
    o = table(spark, d, "orders")
    parsed = X.parse_info(F.concat(_text("o_custkey", "A="), F.lit(";FLAG;B="), "o_orderpriority"))
    return o.select("o_orderkey", parsed.alias("m")).select("o_orderkey", X.format_info(F.col("m")).alias("info"), F.col("m")["A"].alias("a"))


@query(
    "format_zip",
    "SELECT o_orderkey, '0/1' AS gt, CAST(o_custkey AS STRING) AS dp FROM orders",
)
def format_zip(spark, d):
    o = table(spark, d, "orders")
    m = X.parse_format(F.lit("GT:DP"), F.concat(F.lit("0/1:"), F.col("o_custkey").cast("string")))
    return o.select("o_orderkey", m["GT"].alias("gt"), m["DP"].alias("dp"))


@query(
    "human_sizes",
    """SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0e0) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0e0)
       ELSE printf('%.1f GB', b / 1073741824.0e0) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey * o_custkey * (o_orderkey % 7 + 1) * 101 AS BIGINT) AS b FROM orders)""",
)
def human_sizes(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", human_size((k * F.col("o_custkey") * (k % 7 + 1) * 101).cast("long")).alias("size"))


@query(
    "phred_scores",
    "SELECT l_orderkey, l_linenumber, -10.0e0 * log10(1.0e0 / (l_partkey + 1)) AS phred FROM lineitem",
)
def phred_scores(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", phred(F.lit(1.0) / (F.col("l_partkey") + 1)).alias("phred"))


@query(
    "ambiguity_codes",
    """SELECT sample, chrom, pos, ref, alt, CASE least(r, a) || greatest(r, a) WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' ELSE r END AS code
       FROM (SELECT *, substr(ref, 1, 1) AS r, substr(alt, 1, 1) AS a FROM v_variants)""",
    ("v_variants",),
)
def ambiguity_codes(spark, d):
    v = view(spark, d, "v_variants")
    return v.select("sample", "chrom", "pos", "ref", "alt", A.ambiguity_code(F.substring("ref", 1, 1), F.substring("alt", 1, 1)).alias("code"))


@query(
    "accession_kinds",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'assembly' WHEN 1 THEN 'sample' END AS kind FROM orders""",
)
def accession_kinds(spark, d):
    k = F.col("o_orderkey")
    nine = F.lpad(k.cast("string"), 9, "0")
    text = F.when(k % 3 == 0, F.concat(F.lit("GCF_"), nine, F.lit(".1"))).when(k % 3 == 1, F.concat(F.lit("SAMN"), nine)).otherwise(F.concat(F.lit("x"), nine))
    return table(spark, d, "orders").select("o_orderkey", N.accession_kind(text).alias("kind"))


@query(
    "reference_formats",
    """SELECT path, CASE WHEN lang = 'en' THEN 'genbank' WHEN lang = 'de' THEN 'fasta' WHEN lang = 'fr' THEN 'embl' END AS kind
       FROM (SELECT 'd' || doc_id AS path, lang FROM documents)""",
)
def reference_formats(spark, d):
    docs = table(spark, d, "documents")
    first = F.when(F.col("lang") == "en", "LOCUS x").when(F.col("lang") == "de", ">c1").when(F.col("lang") == "fr", "ID x").otherwise("other")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), N.reference_format(first, path).alias("kind"))
