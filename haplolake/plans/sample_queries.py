"""Queries of the read and assembly operators with a sample key.

The checks put the sample in front of every contig name and then run the SQL of
one sample, so they know nothing of keys. Samples follow from the order key;
one sample of the variants has no reads and no blocks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from haplolake.operators import assembly as B
from haplolake.operators import checks as H
from haplolake.operators import cohort as K
from haplolake.operators import depth as D
from haplolake.operators import intervals as I
from haplolake.operators import ordering as O
from haplolake.operators import samples as P
from haplolake.operators import tree as T
from haplolake.plans import alignment_queries as AQ
from haplolake.plans import interval_queries as IQ
from haplolake.plans.registry import alignments, contigs, keys_of, query, variants
from haplolake.plans.views import VIEWS, table, view
from haplolake.session import stage

SAMPLES = ("AF", "NO", "RF")
KEYS = ("sample",)


def _sample(number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, SAMPLES)), (number % 3 + 1).cast("int"))


def _reads(spark, d):
    a = alignments(spark, d)
    return a.withColumn("sample", _sample(F.substr(F.col("qname"), F.lit(2)).cast("long")))


def _frame(spark, d):
    return contigs(spark, d).withColumn("sample", F.explode(F.array(*map(F.lit, SAMPLES))))


def _paf(spark, d):
    p = IQ._paf(spark, d)
    return p.withColumn("sample", _sample(F.substr(F.col("qname"), F.lit(2)).cast("long")))


_PICK = "CASE {} % 3 WHEN 0 THEN 'AF' WHEN 1 THEN 'NO' ELSE 'RF' END"
_OWNER = _PICK.format("CAST(substr(qname, 2) AS BIGINT)")
_NAMES = "names AS (SELECT unnest(['AF', 'NO', 'RF']) AS sample)"
_OWNED = ", ".join(
    [
        _NAMES,
        f"raw_a AS ({VIEWS['v_alignments']})",
        f"v_alignments AS (SELECT qname, flag, {_OWNER} || ':' || rname AS rname, pos, mapq, cigar, seq_len, shift FROM raw_a)",
        f"raw_c AS ({VIEWS['v_contigs']})",
        "v_contigs AS (SELECT sample || ':' || contig AS contig, length, ord FROM raw_c, names)",
        f"raw_f AS ({VIEWS['v_features']})",
        "v_features AS (SELECT sample || ':' || contig AS contig, sample || ':' || feature_id AS feature_id, gff_start, gff_end FROM raw_f, names)",
        f"raw_v AS ({VIEWS['v_variants']})",
        "v_variants AS (SELECT sample, sample || ':' || chrom AS chrom, pos, ref, alt FROM raw_v)",
        f"raw_p AS ({VIEWS['v_paf']})",
        f"v_paf AS (SELECT qname, {_OWNER} || ':' || tname AS tname, tstart, tend, qlen_aligned, mapq, s1, s2, de, tp FROM raw_p)",
    ]
)


def _split(column: str, name: str) -> str:
    return f"split_part({column}, ':', 1) AS sample, split_part({column}, ':', 2) AS {name}"


@query(
    "pileup_by_sample",
    f"""SELECT {_split('s.contig', 'contig')}, s.pos, s.base, s.strand, coalesce(s.ins, '') AS ins, coalesce(s.del_len, 0) AS del_len, count(*) AS n
        FROM seen s JOIN spots v ON v.chrom = s.contig AND v.pos = s.pos GROUP BY ALL""",
    (),
    _OWNED + ", " + AQ._BASES,
)
def pileup_by_sample(spark, d):
    spots = view(spark, d, "v_variants").select("sample", F.col("chrom").alias("contig"), "pos")
    seen = D.pileup(_reads(spark, d), spots, keys=KEYS)
    what = ["base", "strand", F.coalesce("ins", F.lit("")).alias("ins"), F.coalesce("del_len", F.lit(0)).alias("del_len")]
    return seen.groupBy("sample", "contig", "pos", *what).agg(F.count("*").alias("n"))


@query(
    "strand_bias_by_sample",
    f"""SELECT {_split('chrom', 'chrom')}, pos, ref, alt, ref_fwd, ref_rev, alt_fwd, alt_rev, coalesce(f.p, 1.0e0) < 0.123e0 AS biased
        FROM counts c LEFT JOIN fisher f ON f.a = ref_fwd AND f.b = ref_rev AND f.c = alt_fwd AND f.d = alt_rev""",
    (),
    _OWNED + ", " + AQ._COUNTS,
)
def strand_bias_by_sample(spark, d):
    v = view(spark, d, "v_variants")
    v = stage(v.select("sample", "chrom", "pos", "ref", F.array("alt").alias("alts")))
    seen = D.pileup(_reads(spark, d), v.withColumnRenamed("chrom", "contig"), keys=KEYS)
    out = D.with_strand_test(D.strand_counts(v, seen, KEYS))
    return out.select("sample", "chrom", "pos", "ref", "alt", "ref_fwd", "ref_rev", "alt_fwd", "alt_rev", (F.col("pvalue") < 0.123).alias("biased"))


@query(
    "call_snps_by_sample",
    f"""SELECT {_split('c.contig', 'contig')}, c.pos, r.ref, c.base AS alt, dp, ao, CASE WHEN ao * 1.0e0 / dp >= 0.9e0 THEN '1/1' ELSE '0/1' END AS gt
        FROM (SELECT contig, pos, base, count(*) AS ao, sum(count(*)) OVER (PARTITION BY contig, pos) AS dp FROM seen WHERE mapq >= 30 AND base <> '*' GROUP BY 1, 2, 3) c
        JOIN (SELECT chrom AS contig, pos, min(substr(ref, 1, 1)) AS ref FROM raw_v GROUP BY 1, 2) r ON r.contig = split_part(c.contig, ':', 2) AND r.pos = c.pos
        WHERE c.base <> r.ref AND ao >= 2 AND ao * 1.0e0 / dp >= 0.05e0""",
    (),
    _OWNED + ", " + AQ._BASES,
)
def call_snps_by_sample(spark, d):
    ref = view(spark, d, "v_variants").groupBy(F.col("chrom").alias("contig"), "pos").agg(F.min(F.substring("ref", 1, 1)).alias("ref"))
    return D.call_snps(D.pileup(_reads(spark, d), ref, keys=KEYS), ref, keys=KEYS)


def _segments(spark, d):
    return D.depth_segments(_reads(spark, d), _frame(spark, d), keys=KEYS)


@query(
    "feature_cnv_by_sample",
    f"""SELECT {_split('contig', 'contig')}, split_part(feature_id, ':', 2) AS feature_id, s AS start_, e AS end_, read_depth,
        CASE WHEN read_depth <= 0 THEN 0 ELSE greatest(1, floor(read_depth / 2.0e0 + 0.5e0)) END AS copy_number FROM medians""",
    (),
    _OWNED + ", " + AQ._FEATURE,
)
def feature_cnv_by_sample(spark, d):
    out = D.feature_cnv(AQ._features(spark, d), _segments(spark, d), 2.0, keys=KEYS)
    return out.withColumnsRenamed({"start": "start_", "end": "end_"})


@query(
    "contig_cnv_by_sample",
    f"""SELECT {_split('contig', 'contig')}, meandepth AS read_depth, CASE WHEN meandepth / base <= 0 THEN 0 ELSE greatest(1, floor(meandepth / base + 0.5e0)) END AS copy_number
        FROM (SELECT *, arg_max(meandepth, length * 10 - ord) OVER (PARTITION BY split_part(contig, ':', 1)) AS base FROM coverage)""",
    (),
    _OWNED + ", " + AQ._COVERAGE,
)
def contig_cnv_by_sample(spark, d):
    cover = D.contig_coverage(_reads(spark, d), _frame(spark, d), keys=KEYS).join(contigs(spark, d).select("contig", "ord"), "contig")
    return D.contig_cnv(cover, keys=KEYS)


_POINTS = "points AS (SELECT DISTINCT sample, chrom AS contig, pos, ref, alt FROM v_variants)"


@query(
    "paf_reasons_by_sample",
    """SELECT sample, split_part(contig, ':', 2) AS chrom, pos, ref, alt, coalesce(qname, '') AS qname, CASE WHEN qname IS NULL THEN 'NO_PAF_CONTEXT' ELSE concat_ws(',',
       CASE WHEN mapq < 30 THEN 'LOW_MAPQ' END, CASE WHEN tp NOT IN ('P', 'I') THEN 'NON_PRIMARY' END,
       CASE WHEN s2 * 1.0e0 / s1 >= 0.8e0 THEN 'REPETITIVE_CHAIN' END, CASE WHEN de > 0.05e0 THEN 'HIGH_DE' END) END AS reasons FROM best""",
    (),
    _OWNED + ", " + _POINTS + ", " + IQ._BEST,
)
def paf_reasons_by_sample(spark, d):
    paf = _paf(spark, d)
    v = B.annotate_paf(variants(spark, d), paf, KEYS)
    points = v.withColumn("contig", F.col("chrom")).withColumn("pos0", (F.col("pos") - 1).cast("long"))
    best = I.best_block(points, B.paf_fields(paf), B.paf_rank(), ["qname"], ["sample", "contig"])
    return keys_of(best, F.coalesce("qname", F.lit("")).alias("qname"), F.coalesce(F.try_element_at("info", F.lit("ASM_LOWQUAL_REASON")), F.lit("")).alias("reasons"))


@query(
    "missing_regions_by_sample",
    f"SELECT {_split('contig', 'contig')}, s AS start_, e AS end_ FROM holes WHERE e > s",
    (),
    _OWNED + ", spans AS (SELECT tname AS g, tstart AS s, tend AS e FROM v_paf WHERE tp IN ('P', 'I')), " + IQ._ISLANDS + ", " + IQ._HOLES,
)
def missing_regions_by_sample(spark, d):
    out = B.missing_regions(_paf(spark, d), _frame(spark, d), keys=KEYS)
    return out.withColumnsRenamed({"start": "start_", "end": "end_"})


@query(
    "delta_variants_by_sample",
    "SELECT s.sample, chrom, pos, ref, alt FROM calls JOIN v_sequences s ON s.contig = chrom",
    ("v_sequences",),
    IQ._DELTA,
)
def delta_variants_by_sample(spark, d):
    # every contig is a block of the sample it belongs to; all query contigs have the same name
    seqs = view(spark, d, "v_sequences").filter(F.length("seq") >= 8)
    half = F.expr("length(seq) div 2").cast("int")
    changed = F.replace(F.col("seq"), F.lit("ACG"), F.lit("ATG"))
    qry = F.concat(F.substr(changed, F.lit(1), half), F.substr(changed, half + 2, F.length("seq")))
    pairs = seqs.select("sample", "contig", "seq", qry.alias("qry"), half.alias("half"))
    blocks = pairs.select(
        "sample", F.col("contig").alias("ref"), F.col("contig").alias("qry"), F.lit(1).alias("ref_start"), F.length("seq").alias("ref_end"), F.lit(1).alias("qry_start"),
        F.length("qry").alias("qry_end"), F.lit(1).alias("errors"), F.array(F.col("half") + 1).alias("offsets"),
    )
    queries = pairs.select("sample", "contig", F.col("qry").alias("seq"))
    out = B.delta_variants(blocks, pairs.select("contig", "seq"), queries, min_identity=0, min_length=0, max_variants_per_kb=0)
    return out.select("sample", "chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))


# --- forests, orders and data checks ------------------------------------------------------

_FOREST = f"""raw_e AS ({VIEWS['v_tree_edges']}), v_tree_edges AS (SELECT CAST(t AS INT) AS tree_id, node, parent, len * t AS len FROM raw_e, (SELECT unnest([1, 2]) AS t)),
    tips AS (SELECT s.tree_id, s.node, s.parent AS n, n.parent AS r, n.len + r.len AS dn, r.len AS dr, s.len + n.len + r.len AS depth
       FROM v_tree_edges s JOIN v_tree_edges n ON n.tree_id = s.tree_id AND n.node = s.parent JOIN v_tree_edges r ON r.tree_id = s.tree_id AND r.node = n.parent WHERE s.node LIKE 'S%'
       UNION ALL SELECT n.tree_id, n.node, n.node, n.parent, n.len + r.len, r.len, n.len + r.len FROM v_tree_edges n JOIN v_tree_edges r ON r.tree_id = n.tree_id AND r.node = n.parent
         WHERE n.node LIKE 'N%' AND n.node NOT IN (SELECT parent FROM v_tree_edges))"""


@query(
    "forest_distances",
    """SELECT x.tree_id, x.node AS a, y.node AS b, x.depth + y.depth - 2 * CASE WHEN x.n = y.n THEN x.dn WHEN x.r = y.r THEN x.dr ELSE 0 END AS distance
       FROM tips x JOIN tips y ON x.tree_id = y.tree_id AND x.node > y.node""",
    (),
    _FOREST,
)
def forest_distances(spark, d):
    e = view(spark, d, "v_tree_edges")
    e = e.withColumn("tree_id", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("len", F.col("len") * F.col("tree_id"))
    return T.tree_distances(e)


@query(
    "sorted_paf",
    """SELECT tname AS contig, tstart AS start_, qname, row_number() OVER (PARTITION BY tname ORDER BY tstart, qname) AS place FROM v_paf ORDER BY tname, tstart""",
    ("v_paf",),
)
def sorted_paf(spark, d):
    # the place shows the order, which a set of rows does not
    p = IQ._paf(spark, d)
    starts = p.groupBy("contig", "start").agg(F.sort_array(F.collect_list("qname")).alias("q"))
    points = starts.select("contig", "start", F.size("q").alias("n"), "q")
    before = I.running(points, ["contig"], "start", [I.Run("_before", "sum", F.col("n"), inclusive=False)])
    rows = before.select("contig", "start", "_before", F.posexplode("q").alias("i", "qname"))
    placed = rows.select("contig", "start", "qname", (F.coalesce("_before", F.lit(0)) + F.col("i") + 1).alias("place"))
    return O.sort_paf(placed).withColumnRenamed("start", "start_")


@query(
    "longest_block",
    """SELECT contig, qname, span FROM (SELECT tname AS contig, qname, tend - tstart AS span, row_number() OVER (PARTITION BY tname ORDER BY tend - tstart DESC, qname DESC) AS r FROM v_paf)
       WHERE r = 1""",
    ("v_paf",),
)
def longest_block(spark, d):
    p = IQ._paf(spark, d).select("contig", "qname", (F.col("end") - F.col("start")).alias("span"))
    return O.argmax(p, ["contig"], F.struct("span", "qname"))


def _cells(spark, d):
    """Sequences by source and language; contigs of a language are expected once in every source."""
    s = view(spark, d, "v_sequences")
    from haplolake.plans.views import table

    lang = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("contig"), "lang")
    return s.join(lang, "contig").select("sample", F.col("lang").alias("contig"), "seq", "n")


@query(
    "check_contigs",
    """SELECT coalesce(s.source, e.source) AS sample, coalesce(s.lang, e.lang) AS key, CASE WHEN s.n IS NULL THEN 'missing' WHEN e.lang IS NULL THEN 'extra' ELSE 'duplicate' END AS detail
       FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) s
       FULL JOIN (SELECT source, lang FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['en', 'de', 'xx']) AS lang)) e ON e.source = s.source AND e.lang = s.lang
       WHERE s.n IS NULL OR e.lang IS NULL OR s.n > 1""",
)
def check_contigs(spark, d):
    expected = spark.createDataFrame([("en",), ("de",), ("xx",)], "contig string")
    return H.check_contigs(_cells(spark, d), expected).select("sample", "key", "detail")


@query(
    "check_alignment_lengths",
    "SELECT contig AS sample, CAST(n AS STRING) AS detail FROM v_sequences WHERE n <> (SELECT max(n) FROM v_sequences) OR n = 0",
    ("v_sequences",),
)
def check_alignment_lengths(spark, d):
    return H.check_alignment_lengths(view(spark, d, "v_sequences").select(F.col("contig").alias("sample"), "seq")).select("sample", "detail")


@query(
    "check_consensus",
    "SELECT sample, sum(n) || ' bases in ' || count(*) || ' contigs' AS detail FROM v_sequences GROUP BY sample HAVING sum(n) <> 5000 OR count(*) <> 40",
    ("v_sequences",),
)
def check_consensus(spark, d):
    return H.check_consensus(view(spark, d, "v_sequences"), 5000, 40).select("sample", "detail")


@query(
    "check_samples",
    """SELECT NULL AS sample, 'missing sample' AS detail FROM orders WHERE o_custkey % 7 = 0
       UNION ALL SELECT CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'c' || o_custkey END, 'missing type' FROM orders WHERE o_orderkey % 5 = 0
       UNION ALL SELECT NULL, count(*) || ' rows' FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey HAVING count(*) > 1""",
)
def check_samples(spark, d):
    from haplolake.plans.views import table

    o = table(spark, d, "orders")
    name = F.when(F.col("o_custkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    sheet = o.select(name.alias("sample"), F.when(F.col("o_orderkey") % 5 != 0, F.lit("short")).alias("type"))
    return H.check_samples(sheet).select("sample", "detail")


@query(
    "check_alignment_reference",
    """SELECT coalesce(a.contig, b.contig) AS key, CASE WHEN a.contig IS NULL THEN 'missing' WHEN b.contig IS NULL THEN 'extra' ELSE 'length' END AS detail
       FROM (SELECT rname AS contig, max(pos) AS length FROM v_alignments GROUP BY 1) a FULL JOIN v_contigs b ON a.contig = b.contig
       WHERE a.contig IS NULL OR b.contig IS NULL OR a.length <> b.length
       UNION ALL SELECT 'reads', 'no mapped reads' WHERE NOT EXISTS (SELECT 1 FROM v_alignments WHERE (flag & 4) = 0)""",
    ("v_alignments", "v_contigs"),
)
def check_alignment_reference(spark, d):
    a = alignments(spark, d)
    header = a.groupBy(F.col("rname").alias("contig")).agg(F.max("pos").alias("length"))
    return H.check_alignment_reference(header, contigs(spark, d), a.filter(F.col("flag").bitwiseAND(4) == 0)).select("key", "detail")


@query(
    "check_not_empty",
    "SELECT 'tips' AS \"check\", CAST(count(*) AS STRING) AS detail FROM supplier HAVING count(*) < 100000000 UNION ALL SELECT 'calls', CAST(count(*) AS STRING) FROM lineitem HAVING count(*) < 1",
)
def check_not_empty(spark, d):
    from haplolake.plans.views import table

    few = H.check_not_empty(table(spark, d, "supplier"), "tips", 100_000_000)
    return few.union(H.check_not_empty(table(spark, d, "lineitem"), "calls")).select("check", "detail")


@query(
    "split_msa",
    """SELECT source AS sample, count(DISTINCT lang) AS contigs FROM documents WHERE lang <> 'es' OR source < 'src5' GROUP BY 1
       HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM documents)""",
)
def split_msa(spark, d):
    """Samples that have every contig once."""
    from haplolake.plans.views import table

    some = table(spark, d, "documents").filter("lang <> 'es' OR source < 'src5'")
    cells = some.select(F.col("source").alias("sample"), F.col("lang").alias("contig")).distinct()
    expected = table(spark, d, "documents").select(F.col("lang").alias("contig")).distinct()
    kept, _ = H.split_failures(cells, H.check_contigs(cells, expected))
    return kept.groupBy("sample").agg(F.count("*").alias("contigs"))


@query(
    "core_alignment_whole",
    """SELECT n.sample, string_agg(coalesce(m.base, '-'), '' ORDER BY s.site) AS seq FROM (SELECT DISTINCT sample FROM v_msa_sites WHERE base <> '-') n,
       (SELECT site FROM v_msa_sites WHERE base IN ('A', 'C', 'G', 'T') GROUP BY site HAVING count(*) >= 0.03e0 * (SELECT count(DISTINCT sample) FROM v_msa_sites WHERE base <> '-') AND count(DISTINCT base) > 1) s
       LEFT JOIN v_msa_sites m ON m.sample = n.sample AND m.site = s.site AND m.base <> '-' GROUP BY n.sample""",
    ("v_msa_sites",),
)
def core_alignment_whole(spark, d):
    msa = view(spark, d, "v_msa_sites").filter(F.col("base") != "-")
    return K.core_alignment(msa, K.soft_core(msa, 0.03))




_MODELS = """long_ AS (SELECT contig, seq, n, n // 3 AS third, ord FROM v_sequences WHERE n > 120),
    parts AS (SELECT contig, 6 AS s, third AS e, CASE WHEN ord % 2 = 0 THEN '+' ELSE '-' END AS strand, ord % 3 = 2 AS bare, CASE WHEN ord % 2 = 0 THEN 0 ELSE n - third - 36 END AS before, n - 42 AS total FROM long_
      UNION ALL SELECT contig, third + 30, n - 6, CASE WHEN ord % 2 = 0 THEN '+' ELSE '-' END, ord % 3 = 2, CASE WHEN ord % 2 = 0 THEN third - 6 ELSE 0 END, n - 42 FROM long_),
    hits AS (SELECT a.sample, a.contig, a.pos, a.ref, a.alt, p.*, length(a.alt) - length(a.ref) AS grow,
      CASE WHEN strand = '+' THEN before + greatest(a.pos - 1, s) - s ELSE before + e - least(a.pos - 1 + length(a.ref), e) END AS c0, least(a.pos - 1 + length(a.ref), e) - greatest(a.pos - 1, s) AS w
      FROM v_alleles a JOIN parts p ON p.contig = a.contig AND a.pos - 1 < p.e AND p.s < a.pos - 1 + length(a.ref) WHERE length(a.ref) <> length(a.alt)),
    told AS (SELECT DISTINCT sample, contig, pos, ref, alt, CASE WHEN bare THEN concat_ws('|', 'non_coding', 'g' || contig, 't' || contig, 'tRNA') ELSE concat_ws('|',
      CASE WHEN c0 < 3 THEN 'start_lost' WHEN c0 + w > total - 3 AND grow < 0 THEN 'stop_lost' WHEN grow % 3 <> 0 THEN 'frameshift' WHEN grow > 0 THEN 'inframe_insertion' ELSE 'inframe_deletion' END,
      'g' || contig, 't' || contig, 'protein_coding', strand) END AS csq FROM hits)"""


@query(
    "consequences_of_indels",
    """SELECT a.sample, a.contig AS chrom, a.pos, a.ref, a.alt, coalesce(t.csq, '') AS csq FROM (SELECT * FROM v_alleles WHERE length(ref) <> length(alt)) a
       LEFT JOIN (SELECT sample, contig, pos, ref, alt, string_agg(csq, ',' ORDER BY csq) AS csq FROM told GROUP BY ALL) t
         ON t.sample = a.sample AND t.contig = a.contig AND t.pos = a.pos AND t.ref = a.ref AND t.alt = a.alt""",
    ("v_alleles",),
    _MODELS,
)
def consequences_of_indels(spark, d):
    """Insertions and deletions over coding sequences of two parts, a third of them non-coding."""
    from haplolake.operators.sequences import annotate_consequences
    from haplolake.plans.sequence_queries import _edits

    seqs = view(spark, d, "v_sequences").filter("n > 120").withColumn("third", F.expr("n div 3"))
    span = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    ends = F.array(span(F.lit(6), F.col("third")), span(F.col("third") + 30, F.col("n") - 6))
    cds = seqs.select(
        "contig", F.when(F.col("ord") % 2 == 0, "+").otherwise("-").alias("strand"), F.concat(F.lit("g"), "contig").alias("gene"), F.concat(F.lit("t"), "contig").alias("transcript"),
        F.when(F.col("ord") % 3 == 2, "tRNA").otherwise("protein_coding").alias("biotype"), F.explode(ends).alias("p"),
    ).select("contig", "strand", "gene", "transcript", "biotype", "p.*")
    v = _edits(spark, d).filter(F.length("ref") != F.length(F.get("alts", F.lit(0))))
    out = annotate_consequences(v, cds, view(spark, d, "v_sequences"))
    return keys_of(out, F.coalesce(F.try_element_at("info", F.lit("BCSQ")), F.lit("")).alias("csq"))


@query(
    "sample_defaults",
    """SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 50 END, 10) AS min_depth,
         CASE WHEN o_custkey % 4 = 1 THEN 'short' WHEN o_custkey % 4 = 2 THEN '' ELSE 'long' END AS type, 0.5e0 AS min_frac FROM orders""",
)
def sample_defaults(spark, d):
    """Options that are NULL or absent are filled, empty text is kept."""
    c = F.col("o_custkey")
    given = table(spark, d, "orders").select(
        "o_orderkey", F.when(c % 3 != 0, c % 50).alias("min_depth"), F.when(c % 4 == 1, "short").when(c % 4 == 2, "").alias("type")
    )
    return P.apply_defaults(given, {"min_depth": 10, "type": "long", "min_frac": 0.5})
