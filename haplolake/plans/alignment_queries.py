"""Queries over read alignments, depth, copy number and pileups."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplolake.operators import alignments as L
from haplolake.operators import depth as D
from haplolake.plans.registry import alignments, contigs, query, strings
from haplolake.functions import fields as X
from haplolake.plans.views import view
from haplolake.session import stage

_V = ("v_alignments",)
_KEY = "qname, flag, rname, pos, mapq, cigar"


def _short(a, *more):
    return a.select("qname", "flag", "rname", "pos", "mapq", "cigar", *more)


@query("aln_filter", f"SELECT {_KEY} FROM v_alignments WHERE (flag & 1796) = 0 AND mapq >= 40", _V)
def aln_filter(spark, d):
    return _short(L.filter_alignments(alignments(spark, d), 40))


@query("proper_pairs", f"SELECT {_KEY} FROM v_alignments WHERE (flag & 1796) = 0 AND (flag & 2) = 2 AND mapq >= 30", _V)
def proper_pairs(spark, d):
    return _short(L.proper_pairs(alignments(spark, d), 30))


@query(
    "region_reads",
    f"""SELECT {_KEY} FROM v_alignments a WHERE (flag & 1796) = 0 AND mapq >= 30 AND EXISTS (SELECT 1 FROM v_features f WHERE f.contig = a.rname
        AND a.pos - 1 < f.gff_end AND f.gff_start - 1 < a.pos - 1 + (CASE cigar WHEN '100M' THEN 100 WHEN '40M2D60M' THEN 102 WHEN '50M3I47M' THEN 97
        WHEN '5H80M15S' THEN 80 ELSE 100 - CAST(split_part(cigar, 'S', 1) AS INT) END))""",
    ("v_alignments", "v_features"),
)
def region_reads(spark, d):
    bed = _features(spark, d).select("contig", "start", "end")
    return _short(L.filter_alignments(alignments(spark, d), 30, regions=bed))


_CLIP = """clips AS (SELECT a.*, c.length AS clen, CASE WHEN cigar LIKE '%S%M' THEN CAST(split_part(cigar, 'S', 1) AS INT) WHEN cigar = '5H80M15S' THEN 5 ELSE 0 END AS l0,
      CASE WHEN cigar = '5H80M15S' THEN 15 ELSE 0 END AS r0 FROM v_alignments a JOIN v_contigs c ON c.contig = a.rname),
    ends AS (SELECT *, CASE WHEN pos <= 1 + l0 THEN 0 ELSE l0 END AS l, CASE WHEN pos + seq_len - 1 >= clen - r0 THEN 0 ELSE r0 END AS r FROM clips),
    tested AS (SELECT *, greatest(l, r) > 10 OR (l + r) * 1.0e0 / (CASE cigar WHEN '5H80M15S' THEN 100 ELSE seq_len END) > 0.15e0 AS bad FROM ends)"""


@query("clip_filter", f"SELECT {_KEY} FROM tested WHERE NOT bad", ("v_alignments", "v_contigs"), _CLIP)
def clip_filter(spark, d):
    return _short(L.clip_filter(alignments(spark, d), contigs(spark, d), 10, 0.15, fix_mate=False))


@query("clip_filter_inverted", f"SELECT {_KEY} FROM tested WHERE bad", ("v_alignments", "v_contigs"), _CLIP)
def clip_filter_inverted(spark, d):
    return _short(L.clip_filter(alignments(spark, d), contigs(spark, d), 10, 0.15, invert=True))


@query(
    "mate_fix",
    """SELECT qname, CASE WHEN (flag & 1) = 1 AND bool_or(bad) OVER (PARTITION BY qname) THEN flag | 8 ELSE flag END AS flag, rname, pos, mapq, cigar
       FROM tested QUALIFY NOT bad""",
    ("v_alignments", "v_contigs"),
    _CLIP,
)
def mate_fix(spark, d):
    return _short(L.clip_filter(alignments(spark, d), contigs(spark, d), 10, 0.15))


_PLACED = """reflen AS (SELECT *, CASE cigar WHEN '100M' THEN 100 WHEN '40M2D60M' THEN 102 WHEN '50M3I47M' THEN 97 WHEN '5H80M15S' THEN 80
      ELSE 100 - CAST(split_part(cigar, 'S', 1) AS INT) END AS n,
      CASE WHEN cigar LIKE '%S%M' THEN CAST(split_part(cigar, 'S', 1) AS INT) WHEN cigar = '5H80M15S' THEN 5 ELSE 0 END AS cl,
      CASE WHEN cigar = '5H80M15S' THEN 15 ELSE 0 END AS cr FROM v_alignments)"""


@query(
    "mark_duplicates",
    f"""SELECT {_KEY} FROM reflen a WHERE (flag & 2308) <> 0 OR qname IN (SELECT qname FROM (SELECT qname, row_number() OVER (PARTITION BY a, b ORDER BY score DESC, qname) AS r
        FROM (SELECT qname, min(e) AS a, max(e) AS b, sum(mapq) AS score FROM (SELECT qname, mapq,
          lpad(rname, 8, '0') || lpad(CAST(1000 + CASE WHEN (flag & 16) <> 0 THEN pos - 1 + n - 1 + cr ELSE pos - 1 - cl END AS STRING), 12, '0') || (CASE WHEN (flag & 16) <> 0 THEN '1' ELSE '0' END) AS e
          FROM reflen WHERE (flag & 2308) = 0) GROUP BY qname)) WHERE r = 1)""",
    _V,
    _PLACED,
)
def mark_duplicates(spark, d):
    return _short(L.mark_duplicates(alignments(spark, d), score=F.col("mapq")))


@query(
    "fixmate",
    """SELECT a.qname, a.rname, a.pos, a.cigar, a.mapq,
       CASE WHEN m.m IS NULL THEN a.flag ELSE (a.flag & ~40) | (CASE WHEN (m.m.flag & 16) <> 0 THEN 32 ELSE 0 END) | (CASE WHEN (m.m.flag & 4) <> 0 THEN 8 ELSE 0 END) END AS flag,
       CASE WHEN m.m IS NULL THEN '*' WHEN m.m.rname = a.rname THEN '=' ELSE m.m.rname END AS rnext,
       CASE WHEN m.m IS NULL THEN 0 ELSE m.m.pos END AS pnext,
       CASE WHEN m.m IS NULL OR m.m.rname <> a.rname THEN 0
            WHEN a.pos < m.m.pos OR (a.pos = m.m.pos AND (a.flag & 64) <> 0) THEN greatest(a.pos - 1 + a.n, m.m.e) - least(a.pos, m.m.pos) + 1
            ELSE -(greatest(a.pos - 1 + a.n, m.m.e) - least(a.pos, m.m.pos) + 1) END AS tlen
       FROM reflen a LEFT JOIN (SELECT qname, (flag & 64) <> 0 AS one, min(struct_pack(rname := rname, pos := pos, e := pos - 1 + n, flag := flag, cigar := cigar)) AS m
         FROM reflen WHERE (flag & 1) <> 0 AND (flag & 2304) = 0 GROUP BY 1, 2) m
       ON m.qname = a.qname AND (a.flag & 1) <> 0 AND (a.flag & 2304) = 0 AND m.one = ((a.flag & 64) = 0)""",
    _V,
    _PLACED,
)
def fixmate(spark, d):
    return _short(L.fixmate(alignments(spark, d)), "rnext", "pnext", "tlen")


_PHRED = "20 * (length(q) - length(replace(q, '5', ''))) + 30 * (length(q) - length(replace(q, '?', ''))) + 40 * (length(q) - length(replace(q, 'I', ''))) + 37 * (length(q) - length(replace(q, 'F', '')))"


@query(
    "flagstat",
    """SELECT count(*) AS total, count(*) FILTER (WHERE (flag & 2304) = 0) AS "primary", count(*) FILTER (WHERE (flag & 256) <> 0) AS secondary,
       count(*) FILTER (WHERE (flag & 2048) <> 0) AS supplementary, count(*) FILTER (WHERE (flag & 1024) <> 0) AS duplicates,
       count(*) FILTER (WHERE (flag & 4) = 0) AS mapped, count(*) FILTER (WHERE (flag & 4) = 0) * 100.0e0 / count(*) AS mapped_percent,
       count(*) FILTER (WHERE (flag & 2307) = 3 AND (flag & 4) = 0) AS properly_paired,
       count(*) FILTER (WHERE (flag & 2307) = 3 AND (flag & 4) = 0) * 100.0e0 / count(*) FILTER (WHERE (flag & 2305) = 1) AS properly_paired_percent FROM v_alignments""",
    _V,
)
def flagstat(spark, d):
    return L.flagstat(alignments(spark, d))


@query(
    "alignment_stats",
    f"""SELECT rname, count(*) FILTER (WHERE (flag & 4) = 0) AS reads_mapped, count(*) FILTER (WHERE (flag & 4) <> 0) AS reads_unmapped,
       sum(CASE WHEN (flag & 4) = 0 THEN a END) AS bases_mapped, CAST(sum(CASE WHEN (flag & 4) = 0 THEN mapq % 5 END) AS DOUBLE) / sum(CASE WHEN (flag & 4) = 0 THEN a END) AS error_rate,
       CAST(sum(seq_len) AS DOUBLE) / count(*) AS average_length, CAST(sum({_PHRED}) AS DOUBLE) / sum(length(q)) AS average_quality,
       avg(abs(tlen)) FILTER (WHERE (flag & 2) <> 0 AND tlen <> 0) AS insert_size_average
       FROM (SELECT *, substr(repeat('5?IF', 26), shift + 1, seq_len) AS q, CASE WHEN mapq % 9 = 0 THEN 0 ELSE pos % 700 - 300 END AS tlen, CASE cigar WHEN '100M' THEN 100 WHEN '40M2D60M' THEN 100 WHEN '50M3I47M' THEN 100 WHEN '5H80M15S' THEN 80 ELSE n END AS a FROM reflen)
       WHERE (flag & 2304) = 0 GROUP BY rname""",
    _V,
    _PLACED,
)
def alignment_stats(spark, d):
    tlen = F.when(F.col("mapq") % 9 == 0, 0).otherwise(F.col("pos") % 700 - 300)
    return L.alignment_stats(alignments(spark, d).withColumn("tlen", tlen), ("rname",))


_COVER = _PLACED + """, blocks AS (SELECT rname AS contig, pos - 1 AS s, CASE WHEN cigar = '40M2D60M' THEN pos - 1 + 40 ELSE pos - 1 + n END AS e FROM reflen WHERE (flag & 1796) = 0
      UNION ALL SELECT rname, pos - 1 + 42, pos - 1 + 102 FROM reflen WHERE (flag & 1796) = 0 AND cigar = '40M2D60M'),
    steps AS (SELECT contig, s AS p, 1 AS step, 0 AS edge FROM blocks UNION ALL SELECT contig, e, -1, 0 FROM blocks
      UNION ALL SELECT contig, 0, 0, 1 FROM v_contigs UNION ALL SELECT contig, length, 0, 1 FROM v_contigs),
    turns AS (SELECT contig, p, sum(step) AS step FROM steps GROUP BY 1, 2 HAVING sum(step) <> 0 OR max(edge) = 1),
    segments AS (SELECT contig, p AS start_, lead(p) OVER w AS end_, CAST(sum(step) OVER w AS BIGINT) AS depth FROM turns WINDOW w AS (PARTITION BY contig ORDER BY p))"""
_VC = ("v_alignments", "v_contigs")


@query("depth_segments", "SELECT * FROM segments WHERE end_ IS NOT NULL", _VC, _COVER)
def depth_segments(spark, d):
    out = D.depth_segments(alignments(spark, d), contigs(spark, d))
    return out.withColumnsRenamed({"start": "start_", "end": "end_"})


for _name, _pick, _where in (("zero_depth_blocks", 0, "depth = 0"), ("low_depth_blocks", 1, "depth > 0 AND depth < 3")):

    @query(
        _name,
        "SELECT g AS contig, s AS start_, e AS end_ FROM merged",
        _VC,
        _COVER
        + f""", spans AS (SELECT contig AS g, start_ AS s, end_ AS e FROM segments WHERE end_ IS NOT NULL AND {_where}),
        runs AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
        marks AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM runs),
        merged AS (SELECT g, min(s) AS s, max(e) AS e FROM marks GROUP BY g, island)""",
    )
    def depth_blocks(spark, d, pick=_pick):
        segments = D.depth_segments(alignments(spark, d), contigs(spark, d))
        return D.depth_blocks(segments, 3)[pick].withColumnsRenamed({"start": "start_", "end": "end_"})


_COVERAGE = _COVER + """, coverage AS (SELECT c.contig, c.length, c.ord, coalesce(r.numreads, 0) AS numreads, b.covbases, b.covbases * 100.0e0 / c.length AS coverage,
      CAST(b.bases AS DOUBLE) / c.length AS meandepth, coalesce(r.meanmapq, 0.0e0) AS meanmapq FROM v_contigs c
      LEFT JOIN (SELECT contig, sum(CASE WHEN depth > 0 THEN end_ - start_ ELSE 0 END) AS covbases, sum((end_ - start_) * depth) AS bases FROM segments WHERE end_ IS NOT NULL GROUP BY 1) b ON b.contig = c.contig
      LEFT JOIN (SELECT rname AS contig, count(*) AS numreads, avg(mapq) AS meanmapq FROM reflen WHERE (flag & 1796) = 0 GROUP BY 1) r ON r.contig = c.contig)"""


@query(
    "contig_coverage",
    """SELECT c.contig, length, numreads, covbases, coverage, meandepth, coalesce(meanbaseq, 0.0e0) AS meanbaseq, meanmapq
       FROM coverage c LEFT JOIN quals ON quals.contig = c.contig""",
    _VC,
    _COVERAGE
    + f""", texts AS (SELECT rname, cigar, n, substr(repeat('5?IF', 26), shift + 1, seq_len) AS t FROM reflen WHERE (flag & 1796) = 0),
      cuts AS (SELECT rname, CASE WHEN cigar = '50M3I47M' THEN substr(t, 1, 50) || substr(t, 54) WHEN cigar = '5H80M15S' THEN substr(t, 1, 80)
        WHEN cigar IN ('100M', '40M2D60M') THEN t ELSE right(t, n) END AS q FROM texts),
      quals AS (SELECT rname AS contig, CAST(sum({_PHRED}) AS DOUBLE) / sum(length(q)) AS meanbaseq FROM cuts GROUP BY 1)""",
)
def contig_coverage(spark, d):
    return D.contig_coverage(alignments(spark, d), contigs(spark, d))


@query(
    "genome_coverage",
    "SELECT sum(meandepth * length) / sum(length) AS mean_depth, sum(coverage * length) / sum(length) AS mean_breadth, count(*) AS contigs FROM coverage",
    _VC,
    _COVERAGE,
)
def genome_coverage(spark, d):
    return D.genome_coverage(D.contig_coverage(alignments(spark, d), contigs(spark, d)))


@query(
    "contig_cnv",
    """SELECT contig, meandepth AS read_depth, CASE WHEN meandepth / base <= 0 THEN 0 ELSE greatest(1, floor(meandepth / base + 0.5e0)) END AS copy_number
       FROM (SELECT *, (SELECT meandepth FROM coverage ORDER BY length DESC, ord LIMIT 1) AS base FROM coverage)""",
    _VC,
    _COVERAGE,
)
def contig_cnv(spark, d):
    c = contigs(spark, d)
    cover = D.contig_coverage(alignments(spark, d), c).join(c.select("contig", "ord"), "contig")
    return D.contig_cnv(cover)


def _features(spark, d):
    f = view(spark, d, "v_features")
    return f.select("contig", "feature_id", (F.col("gff_start") - 1).alias("start"), F.col("gff_end").alias("end"), F.create_map(F.lit("ID"), F.col("feature_id")).alias("attributes"))


_FEATURE = _COVER + """, feats AS (SELECT contig, feature_id, gff_start - 1 AS s, gff_end AS e FROM v_features),
    cut AS (SELECT f.contig, f.feature_id, f.s, f.e, g.depth, sum(least(f.e, g.end_) - greatest(f.s, g.start_)) AS n FROM feats f
      JOIN segments g ON g.contig = f.contig AND g.end_ IS NOT NULL AND g.depth > 0 AND g.start_ < f.e AND f.s < g.end_ GROUP BY ALL),
    every AS (SELECT * FROM cut UNION ALL SELECT f.contig, f.feature_id, f.s, f.e, 0, f.e - f.s - coalesce((SELECT sum(n) FROM cut c WHERE c.feature_id = f.feature_id), 0) FROM feats f),
    ranks AS (SELECT *, sum(n) OVER (PARTITION BY feature_id ORDER BY depth) AS hi, e - s AS total FROM every WHERE n > 0),
    medians AS (SELECT contig, feature_id, s, e, (min(depth) FILTER (WHERE hi >= (total + 1) // 2) + min(depth) FILTER (WHERE hi >= total // 2 + 1)) / 2.0e0 AS read_depth
      FROM ranks GROUP BY ALL)"""


@query(
    "feature_cnv",
    """SELECT contig, feature_id, s AS start_, e AS end_, read_depth, CASE WHEN read_depth <= 0 THEN 0 ELSE greatest(1, floor(read_depth / 2.0e0 + 0.5e0)) END AS copy_number
       FROM medians""",
    ("v_alignments", "v_contigs", "v_features"),
    _FEATURE,
)
def feature_cnv(spark, d):
    segments = D.depth_segments(alignments(spark, d), contigs(spark, d))
    out = D.feature_cnv(_features(spark, d), segments, 2.0)
    return out.withColumnsRenamed({"start": "start_", "end": "end_"})


# the first covered feature of all, and of the longest contig
_PICKED = _FEATURE + """, picked AS (SELECT min(feature_id) FILTER (WHERE read_depth > 0) AS any_,
      min(feature_id) FILTER (WHERE read_depth > 0 AND contig = (SELECT contig FROM v_contigs ORDER BY length DESC, ord LIMIT 1)) AS long_ FROM medians)"""


@query(
    "baselines",
    """SELECT 'feature' AS kind, read_depth AS baseline FROM medians WHERE feature_id = (SELECT any_ FROM picked)
       UNION ALL SELECT 'region', read_depth FROM medians WHERE feature_id = (SELECT long_ FROM picked)""",
    ("v_alignments", "v_contigs", "v_features"),
    _PICKED,
)
def baselines(spark, d):
    segments, features = D.depth_segments(alignments(spark, d), contigs(spark, d)), _features(spark, d)
    longest = contigs(spark, d).orderBy(F.desc("length"), "ord").first().contig
    covered = D.feature_depth(features, segments).where("read_depth > 0")
    own = F.when(F.col("contig") == longest, F.struct("feature_id", "start", "end"))
    picked = covered.agg(F.min("feature_id").alias("any"), F.min(own).alias("long")).first()
    a = D.baseline_from_feature(segments, features, picked.any).select(F.lit("feature").alias("kind"), "baseline")
    region = (None, picked.long.start + 1, picked.long.end)
    return a.union(D.baseline_from_region(segments, contigs(spark, d), region).select(F.lit("region").alias("kind"), "baseline"))


@query(
    "uncovered_features",
    "SELECT contig, feature_id, s AS start_, e AS end_ FROM medians WHERE read_depth = 0",
    ("v_alignments", "v_contigs", "v_features"),
    _FEATURE,
)
def uncovered_features(spark, d):
    segments = D.depth_segments(alignments(spark, d), contigs(spark, d))
    bare = D.feature_depth(_features(spark, d), segments).where("read_depth = 0")
    return bare.select("contig", "feature_id", F.col("start").alias("start_"), F.col("end").alias("end_"))


# bases of a read at each aligned reference position, straight from the five CIGAR shapes
_BASES = _PLACED + """, reads AS (SELECT *, substr(repeat('ACGT', 26), shift + 1, seq_len) AS seq FROM reflen WHERE (flag & 1796) = 0),
    walk AS (SELECT rname AS contig, pos - 1 + k AS p, flag, seq, cigar, cl, k, mapq FROM (SELECT *, unnest(range(n)) AS k FROM reads)),
    seen AS (SELECT contig, p + 1 AS pos, mapq, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand,
      CASE WHEN cigar = '40M2D60M' AND k IN (40, 41) THEN '*' WHEN cigar = '40M2D60M' AND k > 41 THEN substr(seq, k - 1, 1)
           WHEN cigar = '50M3I47M' AND k >= 50 THEN substr(seq, k + 4, 1) WHEN cigar = '5H80M15S' THEN substr(seq, k + 1, 1)
           WHEN cl > 0 THEN substr(seq, k + cl + 1, 1) ELSE substr(seq, k + 1, 1) END AS base,
      CASE WHEN cigar = '50M3I47M' AND k = 49 THEN substr(seq, 51, 3) END AS ins, CASE WHEN cigar = '40M2D60M' AND k = 39 THEN 2 END AS del_len FROM walk),
    spots AS (SELECT DISTINCT chrom, pos FROM v_variants)"""
_AV = ("v_alignments", "v_variants")


def _positions(spark, d):
    return view(spark, d, "v_variants").select(F.col("chrom").alias("contig"), "pos").distinct()


@query(
    "pileup",
    "SELECT s.contig, s.pos, s.base, s.strand, coalesce(s.ins, '') AS ins, coalesce(s.del_len, 0) AS del_len, count(*) AS n FROM seen s JOIN spots v ON v.chrom = s.contig AND v.pos = s.pos GROUP BY ALL",
    _AV,
    _BASES,
)
def pileup(spark, d):
    seen = D.pileup(alignments(spark, d), _positions(spark, d))
    return seen.groupBy("contig", "pos", "base", "strand", F.coalesce("ins", F.lit("")).alias("ins"), F.coalesce("del_len", F.lit(0)).alias("del_len")).agg(F.count("*").alias("n"))


_COUNTS = _BASES + """, sites AS (SELECT DISTINCT chrom, pos, ref, alt FROM v_variants WHERE (length(ref) = 1 AND length(alt) = 1) OR (length(ref) <> length(alt) AND (starts_with(ref, alt) OR starts_with(alt, ref)))),
    judged AS (SELECT t.*, s.strand, CASE WHEN s.base IS NULL THEN NULL WHEN length(t.ref) = length(t.alt) THEN s.base = t.alt WHEN length(t.alt) > length(t.ref) THEN coalesce(s.ins = substr(t.alt, length(t.ref) + 1), false)
        ELSE coalesce(s.del_len = length(t.ref) - length(t.alt), false) END AS is_alt, s.base = substr(t.ref, 1, 1) AS base_ref
      FROM sites t LEFT JOIN seen s ON s.contig = t.chrom AND s.pos = t.pos),
    counts AS (SELECT chrom, pos, ref, alt, count(*) FILTER (WHERE base_ref AND strand = '+' AND (length(ref) = length(alt) OR NOT is_alt)) AS ref_fwd,
        count(*) FILTER (WHERE base_ref AND strand = '-' AND (length(ref) = length(alt) OR NOT is_alt)) AS ref_rev,
        count(*) FILTER (WHERE is_alt AND strand = '+') AS alt_fwd, count(*) FILTER (WHERE is_alt AND strand = '-') AS alt_rev FROM judged GROUP BY ALL),
    tables AS (SELECT DISTINCT ref_fwd AS a, ref_rev AS b, alt_fwd AS c, alt_rev AS d FROM counts),
    terms AS (SELECT a, b, c, d, x, exp(lgamma(a + c + 1) - lgamma(x + 1) - lgamma(a + c - x + 1) + lgamma(b + d + 1) - lgamma(a + b - x + 1) - lgamma(d - a + x + 1)
        - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1)) AS w FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM tables
          WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0)),
    obs AS (SELECT a, b, c, d, w AS o FROM terms WHERE x = a),
    fisher AS (SELECT t.a, t.b, t.c, t.d, least(1.0e0, sum(CASE WHEN t.w <= o.o + greatest(o.o * 1e-12, 1e-15) THEN t.w ELSE 0 END)) AS p FROM terms t
        JOIN obs o ON o.a = t.a AND o.b = t.b AND o.c = t.c AND o.d = t.d GROUP BY 1, 2, 3, 4)"""


@query(
    "strand_bias",
    """SELECT chrom, pos, ref, alt, ref_fwd, ref_rev, alt_fwd, alt_rev, round(coalesce(f.p, 1.0e0), 7) AS pvalue
       FROM counts c LEFT JOIN fisher f ON f.a = ref_fwd AND f.b = ref_rev AND f.c = alt_fwd AND f.d = alt_rev""",
    _AV,
    _COUNTS,
)
def strand_bias(spark, d):
    sites = stage(view(spark, d, "v_variants").select("chrom", "pos", "ref", F.array("alt").alias("alts")))
    counts = D.strand_counts(sites, D.pileup(alignments(spark, d), sites.withColumnRenamed("chrom", "contig")))
    return D.with_strand_test(counts).select("chrom", "pos", "ref", "alt", "ref_fwd", "ref_rev", "alt_fwd", "alt_rev", F.round("pvalue", 7).alias("pvalue"))


@query(
    "call_snps",
    """SELECT c.contig, c.pos, r.ref, c.base AS alt, dp, ao, CASE WHEN ao * 1.0e0 / dp >= 0.9e0 THEN '1/1' ELSE '0/1' END AS gt
       FROM (SELECT contig, pos, base, count(*) AS ao, sum(count(*)) OVER (PARTITION BY contig, pos) AS dp FROM seen WHERE mapq >= 30 AND base <> '*' GROUP BY 1, 2, 3) c
       JOIN (SELECT chrom AS contig, pos, min(substr(ref, 1, 1)) AS ref FROM v_variants GROUP BY 1, 2) r ON r.contig = c.contig AND r.pos = c.pos
       WHERE c.base <> r.ref AND ao >= 2 AND ao * 1.0e0 / dp >= 0.05e0""",
    _AV,
    _BASES,
)
def call_snps(spark, d):
    ref = view(spark, d, "v_variants").groupBy(F.col("chrom").alias("contig"), "pos").agg(F.min(F.substring("ref", 1, 1)).alias("ref"))
    return D.call_snps(D.pileup(alignments(spark, d), ref), ref)


@query(
    "crop_reads",
    """SELECT rname, min(p) + 1 AS pos, max(p) + 1 AS last_pos, string_agg(base, '' ORDER BY p, o) AS seq FROM (
         SELECT w.*, m.s, m.e FROM letters w JOIN merged m ON m.g = w.rname AND m.s <= w.p AND w.p < m.e) GROUP BY id, rname, s, e
       HAVING count(*) FILTER (WHERE o = 0) > 0""",
    ("v_alignments", "v_features"),
    _PLACED
    + """, ids AS (SELECT *, row_number() OVER (ORDER BY qname, flag, rname, pos, mapq, cigar, shift) AS id, substr(repeat('ACGT', 26), shift + 1, seq_len) AS seq FROM reflen WHERE (flag & 4) = 0),
      letters AS (SELECT id, rname, pos - 1 + k AS p, 0 AS o, CASE WHEN cigar = '40M2D60M' AND k > 41 THEN substr(seq, k - 1, 1)
           WHEN cigar = '50M3I47M' AND k >= 50 THEN substr(seq, k + 4, 1) WHEN cigar = '5H80M15S' THEN substr(seq, k + 1, 1)
           WHEN cl > 0 THEN substr(seq, k + cl + 1, 1) ELSE substr(seq, k + 1, 1) END AS base
         FROM (SELECT *, unnest(range(n)) AS k FROM ids) WHERE NOT (cigar = '40M2D60M' AND k IN (40, 41))
         UNION ALL SELECT id, rname, pos - 1 + 50, -1, substr(seq, 51, 3) FROM ids WHERE cigar = '50M3I47M'),
      spans AS (SELECT contig AS g, gff_start - 1 AS s, gff_end AS e FROM v_features),
      runs AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
      marks AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM runs),
      merged AS (SELECT g, min(s) AS s, max(e) AS e FROM marks GROUP BY g, island)""",
)
def crop_reads(spark, d):
    from haplolake.functions import cigar as C

    out = L.crop_reads(alignments(spark, d), _features(spark, d).select("contig", "start", "end"))
    end = F.col("pos") - 1 + C.reference_length(F.col("cigar"))
    return out.select("rname", "pos", end.alias("last_pos"), "seq")


@query("sorted_alignments", f"SELECT {_KEY} FROM v_alignments", _V)
def sorted_alignments(spark, d):
    return _short(L.sort_alignments(alignments(spark, d), contigs(spark, d)))


@query(
    "find_feature",
    "SELECT contig, feature_id FROM v_features WHERE feature_id = 'f7'",
    ("v_features",),
)
def find_feature(spark, d):
    return D.find_feature(_features(spark, d), "f7").select("contig", "feature_id")


@query(
    "strand_filter",
    """SELECT v.sample, v.chrom, v.pos, v.ref, v.alt, CASE WHEN coalesce(f.p, 1.0e0) < 0.123e0 AND c.chrom IS NOT NULL THEN 'StrandBias' ELSE '.' END AS filter FROM v_variants v
       LEFT JOIN counts c ON c.chrom = v.chrom AND c.pos = v.pos AND c.ref = v.ref AND c.alt = v.alt
       LEFT JOIN fisher f ON f.a = ref_fwd AND f.b = ref_rev AND f.c = alt_fwd AND f.d = alt_rev""",
    _AV,
    _COUNTS,
)
def strand_filter(spark, d):
    v = view(spark, d, "v_variants").select(
        "sample", "chrom", "pos", "ref", F.array("alt").alias("alts"), strings().alias("filters"), X.empty_map().alias("info"), F.create_map(F.lit("GT"), F.col("gt")).alias("fmt")
    )
    v = stage(v)
    out = D.strand_bias(v, D.pileup(alignments(spark, d), v.withColumnRenamed("chrom", "contig")), 0.123)
    return out.select("sample", "chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), X.format_filters(F.col("filters")).alias("filter"))
