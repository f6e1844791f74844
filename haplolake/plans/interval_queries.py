"""Queries over intervals, PAF blocks and assembly alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplolake.operators import assembly as B
from haplolake.operators import intervals as I
from haplolake.operators.alignments import with_contig_length
from haplolake.plans.registry import contigs, intervals, keys_of, query, variants
from haplolake.plans.variant_queries import _ISLANDS
from haplolake.plans.views import view

_SPANS = "spans AS (SELECT contig AS g, start_ AS s, end_ AS e FROM v_intervals), " + _ISLANDS


def _plain(df):
    return df.withColumnsRenamed({"start": "start_", "end": "end_"})


@query("merge_intervals", "SELECT g AS contig, s AS start_, e AS end_ FROM merged", ("v_intervals",), _SPANS)
def merge_intervals(spark, d):
    return _plain(I.merge_intervals(intervals(spark, d)))


_HOLES = """holes AS (SELECT m.g AS contig, coalesce(lag(m.e) OVER (PARTITION BY m.g ORDER BY m.s), 0) AS s, m.s AS e FROM merged m
    UNION ALL SELECT c.contig, coalesce(max(m.e), 0), c.length FROM v_contigs c LEFT JOIN merged m ON m.g = c.contig GROUP BY c.contig, c.length)"""


@query("complement", "SELECT contig, s AS start_, e AS end_ FROM holes WHERE e > s", ("v_intervals", "v_contigs"), _SPANS + ", " + _HOLES)
def complement(spark, d):
    return _plain(I.complement(intervals(spark, d), contigs(spark, d)))


_POINTS = "points AS (SELECT sample, chrom AS contig, pos, ref, alt, pos - 1 AS s, pos - 1 + length(ref) AS e FROM v_variants)"


def _spots(spark, d):
    v = variants(spark, d)
    return keys_of(v).select(
        "sample", F.col("chrom").alias("contig"), "pos", "ref", "alt", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end")
    )


@query(
    "overlap_join",
    "SELECT p.sample, p.contig, p.pos, p.ref, p.alt, i.start_, i.end_ FROM points p JOIN v_intervals i ON i.contig = p.contig AND p.s < i.end_ AND i.start_ < p.e",
    ("v_variants", "v_intervals"),
    _POINTS,
)
def overlap_join(spark, d):
    out = I.overlap_join(_spots(spark, d), intervals(spark, d))
    return out.drop("start", "end").withColumnsRenamed({"start_b": "start_", "end_b": "end_"})


for _how, _word in (("left_semi", ""), ("left_anti", "NOT ")):

    @query(
        f"overlap_{_how[5:]}",
        f"""SELECT sample, contig, pos, ref, alt FROM points p WHERE {_word}EXISTS (SELECT 1 FROM v_intervals i WHERE i.contig = p.contig
            AND p.s < i.end_ AND i.start_ < p.e)""",
        ("v_variants", "v_intervals"),
        _POINTS,
    )
    def overlap_filter(spark, d, how=_how):
        return I.overlap_join(_spots(spark, d), intervals(spark, d), how=how).drop("start", "end")


@query(
    "intersect_intervals",
    """SELECT a.contig, greatest(a.start_, b.tstart) AS start_, least(a.end_, b.tend) AS end_, b.qname FROM v_intervals a
       JOIN v_paf b ON b.tname = a.contig AND a.start_ < b.tend AND b.tstart < a.end_""",
    ("v_intervals", "v_paf"),
)
def intersect_intervals(spark, d):
    return _plain(I.intersect_intervals(intervals(spark, d), _paf(spark, d).select("contig", "start", "end", "qname")))


_SWEEP = """events AS (SELECT contig, start_ AS p, 1 AS step FROM v_intervals UNION ALL SELECT contig, end_, -1 FROM v_intervals),
    points AS (SELECT contig, p, sum(step) AS step FROM events GROUP BY 1, 2),
    depths AS (SELECT contig, p AS start_, lead(p) OVER w AS end_, CAST(sum(step) OVER w AS BIGINT) AS depth FROM points WINDOW w AS (PARTITION BY contig ORDER BY p))"""


@query("coverage_gt1", "SELECT * FROM depths WHERE depth > 1 AND end_ IS NOT NULL", ("v_intervals",), _SWEEP)
def coverage_gt1(spark, d):
    return _plain(I.coverage_gt(intervals(spark, d), 1))


@query(
    "sort_by_genome",
    "SELECT i.contig, start_, end_ FROM v_intervals i",
    ("v_intervals",),
)
def sort_by_genome(spark, d):
    return _plain(I.sort_by_genome(intervals(spark, d), contigs(spark, d)))


@query(
    "with_contig_length",
    "SELECT i.contig, start_, end_, c.length AS contig_length FROM v_intervals i LEFT JOIN v_contigs c ON c.contig = i.contig",
    ("v_intervals", "v_contigs"),
)
def contig_length(spark, d):
    return _plain(with_contig_length(intervals(spark, d), contigs(spark, d), on="contig"))


@query(
    "contig_diff",
    """SELECT coalesce(a.contig, b.contig) AS contig, CASE WHEN a.contig IS NULL THEN 'missing' WHEN b.contig IS NULL THEN 'extra' ELSE 'length' END AS problem
       FROM (SELECT contig, max(end_) AS length FROM v_intervals GROUP BY 1) a FULL JOIN v_contigs b ON a.contig = b.contig
       WHERE a.contig IS NULL OR b.contig IS NULL OR a.length <> b.length""",
    ("v_intervals", "v_contigs"),
)
def contig_diff(spark, d):
    from haplolake.operators.checks import contig_diff as diff

    seen = intervals(spark, d).groupBy("contig").agg(F.max("end").alias("length"))
    return diff(seen, contigs(spark, d)).select("contig", "problem")


# --- assembly ---------------------------------------------------------------------------


def _paf(spark, d):
    p = view(spark, d, "v_paf")
    tags = F.create_map(
        *[x for k, c in (("tp", F.col("tp")), ("s1", F.col("s1")), ("s2", F.col("s2")), ("de", F.col("de"))) for x in (F.lit(k), c.cast("string"))]
    )
    return p.select(
        "qname", F.col("tname").alias("contig"), F.col("tstart").alias("start"), F.col("tend").alias("end"), F.lit(0).alias("qstart"),
        F.col("qlen_aligned").alias("qend"), "mapq", tags.alias("tags"),
    )


_BEST = """best AS (SELECT p.*, b.qname, b.mapq, b.tp, b.s1, b.s2, b.de, b.tstart, b.tend FROM points p LEFT JOIN (
      SELECT q.contig, q.pos, arg_max(f, struct_pack(m := f.mapq, s := f.s1, w := f.tend - f.tstart, t := -f.tstart, n := f.qname)) AS b
      FROM (SELECT DISTINCT contig, pos FROM points) q JOIN v_paf f ON f.tname = q.contig AND f.tstart <= q.pos - 1 AND q.pos - 1 < f.tend
      GROUP BY 1, 2) x ON x.contig = p.contig AND x.pos = p.pos, LATERAL (SELECT unnest(x.b)))"""

_BEST = """ranked AS (SELECT q.contig, q.pos, f.qname, f.mapq, f.tp, f.s1, f.s2, f.de, f.tstart, f.tend,
      row_number() OVER (PARTITION BY q.contig, q.pos ORDER BY f.mapq DESC, f.s1 DESC, f.tend - f.tstart DESC, f.tstart, f.qname) AS rn
      FROM (SELECT DISTINCT contig, pos FROM points) q JOIN v_paf f ON f.tname = q.contig AND f.tstart <= q.pos - 1 AND q.pos - 1 < f.tend),
    best AS (SELECT p.*, r.qname, r.mapq, r.tp, r.s1, r.s2, r.de, r.tstart, r.tend FROM points p
      LEFT JOIN ranked r ON r.contig = p.contig AND r.pos = p.pos AND r.rn = 1)"""


@query(
    "best_block",
    "SELECT sample, contig, pos, ref, alt, qname FROM best",
    ("v_variants", "v_paf"),
    _POINTS + ", " + _BEST,
)
def best_block(spark, d):
    p = B.paf_fields(_paf(spark, d))
    points = _spots(spark, d).withColumn("pos0", F.col("start")).drop("start", "end")
    return I.best_block(points, p, B.paf_rank(), ["qname"]).drop("pos0")


@query(
    "paf_reasons",
    """SELECT sample, contig AS chrom, pos, ref, alt, CASE WHEN qname IS NULL THEN 'NO_PAF_CONTEXT' ELSE concat_ws(',',
       CASE WHEN mapq < 30 THEN 'LOW_MAPQ' END, CASE WHEN tp NOT IN ('P', 'I') THEN 'NON_PRIMARY' END,
       CASE WHEN s2 * 1.0e0 / s1 >= 0.8e0 THEN 'REPETITIVE_CHAIN' END, CASE WHEN de > 0.05e0 THEN 'HIGH_DE' END) END AS reasons,
       least(pos - 1 - tstart, tend - pos) AS edge_dist FROM best""",
    ("v_variants", "v_paf"),
    _POINTS + ", " + _BEST,
)
def paf_reasons(spark, d):
    out = B.annotate_paf(variants(spark, d), _paf(spark, d))
    return keys_of(
        out,
        F.coalesce(F.try_element_at("info", F.lit("ASM_LOWQUAL_REASON")), F.lit("")).alias("reasons"),
        F.try_element_at("info", F.lit("ASM_EDGE_DIST")).cast("long").alias("edge_dist"),
    )


@query("paf_primary", "SELECT qname FROM v_paf WHERE tp IN ('P', 'I')", ("v_paf",))
def paf_primary(spark, d):
    return B.paf_primary(_paf(spark, d)).select("qname")


@query(
    "missing_regions",
    "SELECT contig, s AS start_, e AS end_ FROM holes WHERE e > s",
    ("v_paf", "v_contigs"),
    "spans AS (SELECT tname AS g, tstart AS s, tend AS e FROM v_paf WHERE tp IN ('P', 'I')), " + _ISLANDS + ", " + _HOLES,
)
def missing_regions(spark, d):
    return _plain(B.missing_regions(_paf(spark, d), contigs(spark, d)))


_BLOCKS = """blocks AS (SELECT o_orderkey AS block_id, 'chr' || CAST(o_custkey % 4 AS STRING) AS contig, o_orderkey * 40 + 1 AS ref_start,
    o_orderkey * 40 + 50 + o_custkey % 300 AS ref_end, 1 AS qry_start, 50 + o_custkey % 301 AS qry_end, o_orderkey % 12 AS errors, o_orderkey % 5 AS n FROM orders),
    metrics AS (SELECT *, greatest(abs(ref_end - ref_start) + 1, abs(qry_end - qry_start) + 1) AS block_len FROM blocks)"""


def _blocks(spark, d):
    from haplolake.plans.views import table

    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("block_id"), F.concat(F.lit("chr"), (F.col("o_custkey") % 4).cast("string")).alias("contig"),
        (F.col("o_orderkey") * 40 + 1).alias("ref_start"), (F.col("o_orderkey") * 40 + 50 + F.col("o_custkey") % 300).alias("ref_end"),
        F.lit(1).alias("qry_start"), (F.lit(50) + F.col("o_custkey") % 301).alias("qry_end"), (F.col("o_orderkey") % 12).alias("errors"),
        (F.col("o_orderkey") % 5).alias("n_variants"),
    )


@query(
    "block_metrics",
    """SELECT block_id, block_len, 100.0e0 * (1.0e0 - errors * 1.0e0 / block_len) AS identity, n * 1000.0e0 / block_len AS variants_per_kb FROM metrics""",
    (),
    _BLOCKS,
)
def block_metrics(spark, d):
    return B.block_metrics(_blocks(spark, d)).select("block_id", "block_len", "identity", "variants_per_kb")


@query(
    "filter_blocks",
    """SELECT block_id FROM metrics WHERE 100.0e0 * (1.0e0 - errors * 1.0e0 / block_len) >= 96.05e0 AND block_len >= 100 AND n * 1000.0e0 / block_len <= 15""",
    (),
    _BLOCKS,
)
def filter_blocks(spark, d):
    return B.filter_blocks(B.block_metrics(_blocks(spark, d)), 96.05, 100, 15.0).select("block_id")


@query(
    "drop_ambiguous",
    """SELECT v.sample, v.chrom, v.pos, v.ref, v.alt FROM v_variants v WHERE (SELECT count(*) FROM blocks b WHERE b.contig = v.chrom
       AND b.ref_start <= v.pos AND v.pos <= b.ref_end) <= 1""",
    ("v_variants",),
    _BLOCKS,
)
def drop_ambiguous(spark, d):
    return keys_of(B.drop_ambiguous(variants(spark, d), _blocks(spark, d)))


_DELTA = """seqs AS (SELECT contig, seq, substr(replace(seq, 'ACG', 'ATG'), 1, length(seq) // 2) || substr(replace(seq, 'ACG', 'ATG'), length(seq) // 2 + 2) AS qry,
      length(seq) // 2 + 1 AS cut, length(seq) AS n FROM v_sequences WHERE length(seq) >= 8),
    walk AS (SELECT *, unnest(range(1, n + 1)) AS p FROM seqs),
    calls AS (SELECT contig AS chrom, p AS pos, substr(seq, p, 1) AS ref, substr(qry, CASE WHEN p < cut THEN p ELSE p - 1 END, 1) AS alt FROM walk
        WHERE p <> cut AND substr(seq, p, 1) <> substr(qry, CASE WHEN p < cut THEN p ELSE p - 1 END, 1)
      UNION ALL SELECT contig, cut - 1, substr(seq, cut - 1, 2), substr(qry, cut - 1, 1) FROM seqs)"""


@query("delta_variants", "SELECT chrom, pos, ref, alt FROM calls", ("v_sequences",), _DELTA)
def delta_variants(spark, d):
    seqs = view(spark, d, "v_sequences").filter(F.length("seq") >= 8)
    half = F.expr("length(seq) div 2").cast("int")
    changed = F.replace(F.col("seq"), F.lit("ACG"), F.lit("ATG"))
    qry = F.concat(F.substr(changed, F.lit(1), half), F.substr(changed, half + 2, F.length("seq")))
    pairs = seqs.select("contig", "seq", qry.alias("qry"), half.alias("half"))
    blocks = pairs.select(
        F.col("contig").alias("ref"), F.col("contig").alias("qry"), F.lit(1).alias("ref_start"), F.length("seq").alias("ref_end"), F.lit(1).alias("qry_start"),
        F.length("qry").alias("qry_end"), F.lit(1).alias("errors"), F.array(F.col("half") + 1).alias("offsets"),
    )
    ref = pairs.select("contig", "seq")
    out = B.delta_variants(blocks, ref, pairs.select("contig", F.col("qry").alias("seq")), min_identity=0, min_length=0, max_variants_per_kb=0)
    return out.select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))
