"""Queries over variant records and call sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplolake.functions import alleles as A
from haplolake.functions import fields as X
from haplolake.operators import stats as S
from haplolake.operators import variants as V
from haplolake.operators.intervals import complement, nearest_distance, variant_windows
from haplolake.operators.sequences import CHUNK
from haplolake.plans.registry import contigs, intervals, keys_of, query, strings, variants
from haplolake.plans.views import table, view
from haplolake.session import stage

_LABELS = """soft AS (SELECT *, concat_ws(';', CASE WHEN qual < 100 THEN 'LowQual' END, CASE WHEN dp < 10 THEN 'LowDepth' END,
    CASE WHEN gt IN ('0/1', '1/0', '0|1', '1|0') THEN 'MixedSite' END) AS labels FROM v_variants),
    filtered AS (SELECT *, CASE WHEN labels = '' THEN 'PASS' ELSE labels END AS filter FROM soft)"""


@query("soft_filters", "SELECT sample, chrom, pos, ref, alt, filter FROM filtered", ("v_variants",), _LABELS)
def soft_filters(spark, d):
    return keys_of(V.short_read_filters(variants(spark, d)), F.array_join("filters", ";").alias("filter"))


@query(
    "pass_subset",
    "SELECT sample, chrom, pos, ref, alt FROM filtered WHERE filter = 'PASS' AND length(alt) <= length(ref)",
    ("v_variants",),
    _LABELS,
)
def pass_subset(spark, d):
    return keys_of(V.pass_only(V.short_read_filters(variants(spark, d)), no_insertions=True))


@query("alt_genotype", "SELECT sample, chrom, pos, ref, alt FROM v_variants WHERE gt <> '0/0'", ("v_variants",))
def alt_genotype(spark, d):
    return keys_of(V.has_alt_gt(variants(spark, d)))


_MULTI = """multi AS (SELECT sample, chrom, pos, ref, string_agg(alt, ',' ORDER BY alt) AS alt, count(*) AS n,
    string_agg(CAST(dp AS STRING), ',' ORDER BY alt) AS ao FROM v_variants GROUP BY ALL)"""


def _multi(spark, d):
    """Records with every ALT seen at (sample, chrom, pos, ref)."""
    pair = F.struct("alt", F.col("dp").cast("string").alias("dp"))
    rows = view(spark, d, "v_variants").groupBy("sample", "chrom", "pos", "ref").agg(F.array_sort(F.collect_list(pair)).alias("a"))
    genotype = F.when(F.size("a") > 1, F.concat(F.lit("1/"), F.size("a").cast("string"))).otherwise("1/1")
    return rows.select(
        "sample", "chrom", "pos", "ref", F.transform("a", lambda x: x["alt"]).alias("alts"), X.empty_map().alias("info"),
        F.create_map(F.lit("GT"), genotype, F.lit("AO"), F.array_join(F.transform("a", lambda x: x["dp"]), ",")).alias("fmt"),
    )


@query(
    "split_multiallelic",
    """SELECT sample, chrom, pos, ref, alt, CAST(dp AS STRING) AS ao,
       CASE WHEN n = 1 THEN '1/1' ELSE (CASE WHEN i = 1 THEN '1' ELSE '0' END) || '/' || (CASE WHEN i = n THEN '1' ELSE '0' END) END AS gt
       FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY sample, chrom, pos, ref ORDER BY alt) AS i
             FROM v_variants WINDOW w AS (PARTITION BY sample, chrom, pos, ref))""",
    ("v_variants",),
)
def split_multiallelic(spark, d):
    v = V.split_multiallelic(_multi(spark, d))
    return keys_of(v, F.element_at("fmt", "AO").alias("ao"), F.element_at("fmt", "GT").alias("gt"))


@query(
    "infer_type",
    """SELECT sample, chrom, pos, ref, alt, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP'
       WHEN length(ref) = length(alt) THEN 'MNP' WHEN length(ref) < length(alt) THEN 'INS' ELSE 'DEL' END AS type FROM v_variants""",
    ("v_variants",),
)
def infer_type(spark, d):
    return keys_of(variants(spark, d), A.infer_type(F.col("ref"), F.get("alts", F.lit(0))).alias("type"))


@query(
    "drop_unobserved",
    "SELECT sample, chrom, pos, ref, alt FROM v_variants WHERE abs(length(alt) - length(ref)) <= 1",
    ("v_variants",),
)
def drop_unobserved(spark, d):
    return keys_of(V.drop_unobserved(variants(spark, d), max_indel=1))


_CONTEXT = """snp AS (SELECT sample, chrom, pos, length(ref) = 1 AND length(alt) = 1 AS is_snp, length(ref) <> length(alt) AS is_indel,
    ref, alt FROM v_variants),
  density AS (SELECT *, count(*) FILTER (WHERE is_snp) OVER (PARTITION BY sample, chrom ORDER BY pos RANGE BETWEEN 150 PRECEDING AND 150 FOLLOWING) AS n
    FROM snp),
  indels AS (SELECT DISTINCT sample, chrom, pos FROM snp WHERE is_indel),
  near AS (SELECT d.*, least(d.pos - p.pos, q.pos - d.pos) AS dist FROM density d
    ASOF LEFT JOIN indels p ON d.sample = p.sample AND d.chrom = p.chrom AND d.pos >= p.pos
    ASOF LEFT JOIN indels q ON d.sample = q.sample AND d.chrom = q.chrom AND d.pos <= q.pos)"""


@query("context_snp_density", "SELECT sample, chrom, pos, max(n) AS local_snps FROM density GROUP BY 1, 2, 3", ("v_variants",), _CONTEXT)
def context_snp_density(spark, d):
    points = V.position_summary(variants(spark, d), ["sample", "chrom"])
    return V.local_snp_density(points, ["sample", "chrom"], 150).select("sample", "chrom", "pos", "local_snps")


@query("context_indel_distance", "SELECT sample, chrom, pos, ref, alt, dist AS indel_dist FROM near WHERE is_snp", ("v_variants",), _CONTEXT)
def context_indel_distance(spark, d):
    v = variants(spark, d)
    snp = A.is_snp(F.col("ref"), F.col("alts"))
    near = nearest_distance(v.filter(snp), v.filter(~snp & A.is_indel(F.col("ref"), F.col("alts"))), ["sample", "chrom"], name="indel_dist")
    return keys_of(near, "indel_dist")


@query(
    "context_filter",
    """SELECT sample, chrom, pos, ref, alt,
       CASE WHEN is_snp AND (dist < 30 OR n > 3) THEN 'LowQual' ELSE '.' END AS filter,
       CASE WHEN is_snp THEN concat_ws(',', CASE WHEN dist < 30 THEN 'NEAR_INDEL' END, CASE WHEN n > 3 THEN 'LOCAL_SNP_CLUSTER' END) ELSE '' END AS reasons
       FROM near""",
    ("v_variants",),
    _CONTEXT,
)
def context_filter(spark, d):
    out = V.context_filter(variants(spark, d), 3, 150, 30, 20)
    reasons = F.coalesce(F.try_element_at("info", F.lit("CONTEXT_LOWQUAL_REASON")), F.lit(""))
    return keys_of(out, X.format_filters(F.col("filters")).alias("filter"), reasons.alias("reasons"))


# The keys of edge distances in lookup order, as the query spreads them over the records.
_EDGES = """edges AS (SELECT *, CASE pos % 6 WHEN 0 THEN (dp % 40) || '.9' WHEN 1 THEN CAST(dp % 40 AS VARCHAR) WHEN 2 THEN 'x' WHEN 3 THEN CAST(dp % 40 AS VARCHAR) WHEN 4 THEN CAST(dp % 40 AS VARCHAR) END AS edge FROM v_variants)"""


@query(
    "edge_filter",
    """SELECT sample, chrom, pos, ref, alt, TRY_CAST(trunc(TRY_CAST(edge AS DOUBLE)) AS INT) AS distance, CASE WHEN near THEN 'LowQual' ELSE '.' END AS filter, CASE WHEN near THEN 'NEAR_ALIGNMENT_EDGE' ELSE '' END AS reasons
       FROM (SELECT *, coalesce(length(ref) = 1 AND length(alt) = 1 AND trunc(TRY_CAST(edge AS DOUBLE)) < 20, false) AS near FROM edges)""",
    ("v_variants",),
    _EDGES,
)
def edge_filter(spark, d):
    """Each key in turn; where two are there the first one counts, even if it is no number."""
    near, kind = (F.col("fmt")["DP"].cast("int") % 40).cast("string"), F.col("pos") % 6
    decoy = F.map_from_arrays(F.array(F.lit("EDGE_DIST"), F.lit("ASM_EDGE_DIST")), F.array(F.lit("x"), F.lit("3")))
    info = (
        F.when(kind == 0, F.create_map(F.lit("MUMMER_EDGE_DIST"), F.concat(near, F.lit(".9")))).when(kind == 1, F.create_map(F.lit("ASM_EDGE_DIST"), near, F.lit("MUMMER_EDGE_DIST"), F.lit("1")))
        .when(kind == 2, decoy).when(kind == 3, F.create_map(F.lit("CONTEXT_EDGE_DIST"), near, F.lit("EDGE_DIST"), F.lit("x"))).when(kind == 4, F.create_map(F.lit("EDGE_DIST"), near))
        .otherwise(X.empty_map())
    )
    out = V.context_filter(variants(spark, d).withColumn("info", info), min_snp_distance_to_breakpoint=20)
    reasons = F.coalesce(F.try_element_at("info", F.lit("CONTEXT_LOWQUAL_REASON")), F.lit(""))
    return keys_of(out, X.edge_distance(F.col("info")).alias("distance"), X.format_filters(F.col("filters")).alias("filter"), reasons.alias("reasons"))


@query("rename_sample", "SELECT 'new' AS sample, chrom, pos, ref, alt, gt FROM v_variants", ("v_variants",))
def rename_sample(spark, d):
    return keys_of(V.with_sample(variants(spark, d), "new"), F.element_at("fmt", "GT").alias("gt"))


@query(
    "collapse_gt",
    """SELECT sample, chrom, pos, ref, alt, CASE WHEN gt IN ('0/0', '0|0') THEN '0' WHEN gt IN ('1/1', '1|1') THEN '1'
       WHEN gt IN ('0/1', '1/0', '0|1', '1|0') THEN '.' ELSE gt END AS gt FROM v_variants""",
    ("v_variants",),
)
def collapse_gt(spark, d):
    return keys_of(V.collapse_gt(variants(spark, d)), F.element_at("fmt", "GT").alias("gt"))


@query(
    "variants_tab",
    """SELECT sample, chrom, pos, ref, alt, coalesce(p[1], '') AS consequence, coalesce(p[2], '') AS gene, coalesce(p[3], '') AS transcript,
       coalesce(p[4], '') AS biotype, coalesce(p[5], '') AS strand, coalesce(p[6], '') AS amino_acid_change, coalesce(p[7], '') AS dna_change
       FROM (SELECT *, string_split(list_filter(string_split(csq, ','), lambda x: x <> '' AND x <> '.' AND NOT starts_with(x, '@'))[1], '|') AS p
             FROM v_variants)""",
    ("v_variants",),
)
def variants_tab(spark, d):
    return V.variants_tab(variants(spark, d)).drop("type")


_TYPES = """typed AS (SELECT *, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN length(ref) = length(alt) THEN 'MNP'
    WHEN length(ref) < length(alt) THEN 'INS' ELSE 'DEL' END AS type,
    CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN ref || '>' || alt END AS sub FROM filtered),
    classed AS (SELECT *, CASE WHEN sub IN ('A>G', 'G>A', 'C>T', 'T>C') THEN 1 WHEN sub IS NOT NULL THEN 0 END AS ts FROM typed)"""


@query(
    "vcf_summary",
    """SELECT sample, count(*) AS total, count(*) FILTER (WHERE filter = 'PASS') AS pass, count(*) FILTER (WHERE filter <> 'PASS') AS filtered,
       count(*) FILTER (WHERE filter LIKE '%LowQual%') AS lowqual, count(*) FILTER (WHERE filter LIKE '%LowDepth%') AS lowdepth,
       count(*) FILTER (WHERE type = 'SNP') AS snp, count(*) FILTER (WHERE type = 'MNP') AS mnp, 0 AS indel, 0 AS complex, 0 AS symbolic,
       count(DISTINCT chrom) AS contigs_with_variants, count(*) FILTER (WHERE csq <> '') AS bcsq_annotated,
       count(*) FILTER (WHERE ts = 1) AS transitions, count(*) FILTER (WHERE ts = 0) AS transversions,
       CAST(count(*) FILTER (WHERE ts = 1) AS DOUBLE) / count(*) FILTER (WHERE ts = 0) AS ts_tv_ratio,
       avg(qual) AS qual_mean, avg(CAST(dp AS DOUBLE)) AS depth_mean, min(CAST(dp AS DOUBLE)) AS depth_min, max(CAST(dp AS DOUBLE)) AS depth_max,
       round(avg(CAST(dp - 1 AS DOUBLE) / dp), 8) AS allele_fraction_mean FROM classed GROUP BY sample""",
    ("v_variants",),
    _LABELS + ", " + _TYPES,
)
def vcf_summary(spark, d):
    out = S.vcf_summary(V.short_read_filters(variants(spark, d)))
    return out.withColumn("allele_fraction_mean", F.round("allele_fraction_mean", 8))


@query(
    "vcf_breakdown",
    """SELECT sample, section, label, count(*) AS count FROM (
       SELECT sample, 'filter' AS section, unnest(string_split(filter, ';')) AS label FROM classed
       UNION ALL SELECT sample, 'type', type FROM classed
       UNION ALL SELECT sample, 'substitution', sub FROM classed WHERE sub IS NOT NULL AND ts IS NOT NULL
       UNION ALL SELECT sample, 'consequence', unnest(string_split(string_split(a, '|')[1], '&')) FROM (
         SELECT sample, unnest(string_split(csq, ',')) AS a FROM classed WHERE csq <> '') WHERE NOT starts_with(a, '@'))
       WHERE label <> '' GROUP BY ALL""",
    ("v_variants",),
    _LABELS + ", " + _TYPES,
)
def vcf_breakdown(spark, d):
    return S.vcf_breakdown(V.short_read_filters(variants(spark, d)))


@query(
    "type_counts",
    """SELECT sample, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN length(ref) = length(alt) THEN 'MNP' ELSE 'MISSING' END AS type,
       count(*) AS count FROM v_variants GROUP BY ALL""",
    ("v_variants",),
)
def type_counts(spark, d):
    alt = F.get("alts", F.lit(0))
    named = F.when(F.length("ref") == F.length(alt), X.put(F.col("info"), "TYPE", A.infer_type(F.col("ref"), alt, "tags")))
    return S.type_counts(variants(spark, d).withColumn("info", F.coalesce(named, F.col("info"))))


@query(
    "genome_histogram",
    """SELECT s.sample, c.contig, g.idx, count(v.pos) AS n FROM (SELECT DISTINCT sample FROM v_variants) s, cols c,
       LATERAL (SELECT unnest(range(c.w)) AS idx) g
       LEFT JOIN filtered v ON v.sample = s.sample AND v.chrom = c.contig AND length(v.ref) = 1 AND length(v.alt) = 1 AND v.filter = 'PASS'
         AND v.pos <= c.length AND ((v.pos - 1) * c.w) // c.length = g.idx
       GROUP BY 1, 2, 3""",
    ("v_variants", "v_contigs"),
    _LABELS
    + """, sized AS (SELECT *, length * 55 AS share, sum(length) OVER () AS genome, 60 - 5 AS left_over FROM v_contigs),
    ranked AS (SELECT *, row_number() OVER (ORDER BY share % genome DESC, ord) AS r, share // genome AS base FROM sized),
    cols0 AS (SELECT contig, length, ord, 1 + base + CASE WHEN r <= left_over - (SELECT sum(base) FROM ranked) THEN 1 ELSE 0 END AS w0 FROM ranked), cols AS (SELECT contig, length, ord, CAST(w0 AS BIGINT) AS w FROM cols0)""",
)
def genome_histogram(spark, d):
    v = V.retype(V.short_read_filters(variants(spark, d)))
    return S.genome_histogram(v, contigs(spark, d), 60)


@query(
    "report_scope",
    """SELECT sample, chrom, pos, ref, alt, CAST(dp AS INT) AS dp, gt FROM filtered WHERE filter = 'PASS'""",
    ("v_variants",),
    _LABELS,
)
def report_scope(spark, d):
    v = V.report_scope(V.short_read_filters(variants(spark, d)), "pass")
    return keys_of(v, X.as_int(F.element_at("fmt", "DP")).alias("dp"), F.element_at("fmt", "GT").alias("gt"))


@query(
    "variant_windows",
    "SELECT sample, chrom, pos, ref, alt, greatest(0, pos - 50 - 1) AS start_, pos + length(ref) + 50 AS end_ FROM v_variants",
    ("v_variants",),
)
def variant_window_query(spark, d):
    w = variant_windows(variants(spark, d), 50)
    return keys_of(w, F.col("start").alias("start_"), F.col("end").alias("end_"))


_ISLANDS = """runs AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
    marks AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM runs),
    merged AS (SELECT g, min(s) AS s, max(e) AS e FROM marks GROUP BY g, island)"""


@query(
    "mixed_sites",
    "SELECT split_part(g, '/', 1) AS sample, split_part(g, '/', 2) AS contig, s AS start_, e AS end_ FROM merged",
    ("v_variants",),
    _LABELS + ", spans AS (SELECT sample || '/' || chrom AS g, pos - 1 AS s, pos - 1 + length(ref) AS e FROM filtered WHERE filter = 'MixedSite'), " + _ISLANDS,
)
def mixed_sites(spark, d):
    return V.mixed_sites(V.short_read_filters(variants(spark, d))).withColumnsRenamed({"start": "start_", "end": "end_"})


@query(
    "callset_union_intersect",
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT chrom, pos, ref, alt FROM v_variants WHERE sample LIKE 'A%' UNION SELECT chrom, pos, ref, alt FROM v_variants WHERE sample NOT LIKE 'A%')
       UNION ALL SELECT 'intersect', count(*) FROM (SELECT chrom, pos, ref, alt FROM v_variants WHERE sample LIKE 'A%' INTERSECT SELECT chrom, pos, ref, alt FROM v_variants WHERE sample NOT LIKE 'A%')
       UNION ALL SELECT 'except', count(*) FROM (SELECT chrom, pos, ref, alt FROM v_variants WHERE sample LIKE 'A%' EXCEPT SELECT chrom, pos, ref, alt FROM v_variants WHERE sample NOT LIKE 'A%')""",
    ("v_variants",),
)
def callset_union_intersect(spark, d):
    v = variants(spark, d)
    a, b = v.filter(F.col("sample").startswith("A")), v.filter(~F.col("sample").startswith("A"))
    parts = [V.callset_ops(a, b, op).agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op in ("union", "intersect", "except")]
    return parts[0].union(parts[1]).union(parts[2])


_SAMPLES = ["AF", "AO", "NF", "NO", "RF", "RO"]
_MEMBER = " || ".join(f"max(CASE WHEN sample = '{n}' THEN '1' ELSE '0' END)" for n in _SAMPLES)


@query(
    "upset",
    f"""SELECT membership, count(*) AS n FROM (SELECT chrom, pos, ref, alt, {_MEMBER} AS membership FROM v_variants GROUP BY 1, 2, 3, 4)
       GROUP BY 1 ORDER BY n DESC, membership LIMIT 40""",
    ("v_variants",),
)
def upset(spark, d):
    return V.upset(variants(spark, d), _SAMPLES, "sample")


@query(
    "upset_from_genotypes",
    f"""SELECT membership, count(*) AS n FROM (SELECT chrom, pos, ref, alt, {_MEMBER.replace("THEN '1'", "AND gt <> '0/0' THEN '1'")} AS membership
        FROM v_variants GROUP BY 1, 2, 3, 4) GROUP BY 1 ORDER BY n DESC, membership LIMIT 40""",
    ("v_variants",),
)
def upset_from_genotypes(spark, d):
    key = F.concat_ws("/", "chrom", F.col("pos").cast("string"), "ref", F.get("alts", F.lit(0)))
    return V.upset_from_genotypes(variants(spark, d).withColumn("rec_no", key), _SAMPLES)


@query("set_sizes", "SELECT sample, count(*) AS n FROM v_variants GROUP BY 1", ("v_variants",))
def set_sizes(spark, d):
    return V.set_sizes(variants(spark, d), "sample")


@query(
    "merge_callsets",
    "SELECT chrom, pos, ref, alt, "
    + ", ".join(f"coalesce(min(CASE WHEN sample = '{n}' THEN gt END), './.') AS {n}" for n in _SAMPLES)
    + " FROM v_variants GROUP BY 1, 2, 3, 4",
    ("v_variants",),
)
def merge_callsets(spark, d):
    return V.merge_callsets(variants(spark, d), _SAMPLES, "sample")


@query(
    "merged_genotypes",
    """SELECT chrom, pos, ref, alt, string_agg(sample || ':' || gt, ',' ORDER BY sample) AS genotypes
       FROM (SELECT chrom, pos, ref, alt, sample, min(gt) AS gt FROM v_variants GROUP BY ALL) GROUP BY 1, 2, 3, 4""",
    ("v_variants",),
)
def merged_genotypes(spark, d):
    shown = F.transform("genotypes", lambda g: F.concat(g["name"], F.lit(":"), g["gt"]))
    return V.merged_genotypes(variants(spark, d), "sample").withColumn("genotypes", F.array_join(shown, ","))


@query(
    "compare_truth",
    """SELECT chrom, count(*) FILTER (WHERE c AND t) AS found, count(*) FILTER (WHERE t AND NOT c) AS missed, count(*) FILTER (WHERE c AND NOT t) AS extra
       FROM (SELECT chrom, pos + skip AS p, substr(ref, skip + 1, length(ref) - skip - tail) AS r, substr(alt, skip + 1, length(alt) - skip - tail) AS a,
             bool_or(sample < 'N') AS c, bool_or(sample > 'B') AS t
             FROM (SELECT *, CASE WHEN length(ref) > 1 AND length(alt) > 1 AND tail = 0 AND substr(ref, 1, 1) = substr(alt, 1, 1) THEN 1 ELSE 0 END AS skip
                   FROM (SELECT *, CASE WHEN length(ref) > 1 AND length(alt) > 1 AND right(ref, 1) = right(alt, 1) THEN 1 ELSE 0 END AS tail FROM v_variants))
             GROUP BY 1, 2, 3, 4) GROUP BY 1""",
    ("v_variants",),
)
def compare_truth(spark, d):
    v = variants(spark, d).withColumn("c", F.col("chrom"))
    called, truth = v.filter(F.col("sample") < "N"), v.filter(F.col("sample") > "B")
    return V.compare_truth(called, truth, ("c",)).withColumnRenamed("c", "chrom")


@query(
    "compare_truth_in_regions",
    """SELECT chrom, count(*) FILTER (WHERE c AND t AND i) AS found, count(*) FILTER (WHERE t AND NOT c AND i) AS missed, count(*) FILTER (WHERE c AND NOT t AND i) AS extra,
         count(*) FILTER (WHERE c AND t AND NOT i) AS found_outside, count(*) FILTER (WHERE t AND NOT c AND NOT i) AS missed_outside, count(*) FILTER (WHERE c AND NOT t AND NOT i) AS extra_outside
       FROM (SELECT m.*, h.p IS NOT NULL AS i FROM alleles m LEFT JOIN (SELECT DISTINCT m.chrom, m.p FROM alleles m JOIN v_intervals r ON r.contig = m.chrom AND m.p > r.start_ AND m.p <= r.end_) h
             ON h.chrom = m.chrom AND h.p = m.p) GROUP BY 1""",
    ("v_variants", "v_intervals"),
    """alleles AS (SELECT chrom, pos + skip AS p, substr(ref, skip + 1, length(ref) - skip - tail) AS r, substr(alt, skip + 1, length(alt) - skip - tail) AS a,
         bool_or(sample < 'N') AS c, bool_or(sample > 'B') AS t
       FROM (SELECT *, CASE WHEN length(ref) > 1 AND length(alt) > 1 AND tail = 0 AND substr(ref, 1, 1) = substr(alt, 1, 1) THEN 1 ELSE 0 END AS skip
             FROM (SELECT *, CASE WHEN length(ref) > 1 AND length(alt) > 1 AND right(ref, 1) = right(alt, 1) THEN 1 ELSE 0 END AS tail FROM v_variants))
       GROUP BY 1, 2, 3, 4)""",
)
def compare_truth_in_regions(spark, d):
    v = variants(spark, d).withColumn("c", F.col("chrom"))
    called, truth = v.filter(F.col("sample") < "N"), v.filter(F.col("sample") > "B")
    return V.compare_truth(called, truth, ("c",), intervals(spark, d)).withColumnRenamed("c", "chrom")


@query(
    "add_deletions",
    """SELECT g.sample, g.contig AS chrom, CASE WHEN g.s = 0 THEN 1 ELSE g.s END AS pos,
       'DEL_' || CAST(row_number() OVER (PARTITION BY g.sample ORDER BY g.ord, g.s) AS STRING) AS id, g.e AS end_,
       CASE WHEN g.s = 0 THEN -g.e ELSE g.s - g.e END AS svlen, CASE WHEN g.s = 0 THEN '-' ELSE '<DEL>' END AS alt
       FROM gaps g LEFT JOIN busy v ON v.k = g.sample || '/' || g.contig AND v.s <= g.e AND v.e >= CASE WHEN g.s = 0 THEN 1 ELSE g.s END
       WHERE v.k IS NULL""",
    ("v_variants", "v_intervals", "v_contigs"),
    """spans AS (SELECT contig AS g, start_ AS s, end_ AS e FROM v_intervals), """
    + _ISLANDS
    + """, holes AS (SELECT m.g AS contig, coalesce(lag(m.e) OVER (PARTITION BY m.g ORDER BY m.s), 0) AS s, m.s AS e FROM merged m
        UNION ALL SELECT c.contig, coalesce(max(m.e), 0), c.length FROM v_contigs c LEFT JOIN merged m ON m.g = c.contig GROUP BY c.contig, c.length),
      gaps AS (SELECT sample, h.contig, h.s, h.e, c.ord FROM holes h JOIN v_contigs c ON c.contig = h.contig,
        (SELECT DISTINCT sample FROM v_variants) WHERE h.e > h.s),
      busy AS (SELECT sample || '/' || chrom AS k, pos AS s, pos + length(ref) - 1 AS e FROM v_variants)""",
)
def add_deletions(spark, d):
    v = stage(variants(spark, d))
    names = v.agg(F.sort_array(F.collect_set("sample"))).scalar()
    holes = complement(intervals(spark, d), contigs(spark, d)).withColumn("sample", F.explode(names))
    # in blocks: a contig may be longer than a text can be
    blocks = contigs(spark, d).filter("length IS NOT NULL").select("contig", "length", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L) div {CHUNK})")).alias("block"))
    seqs = blocks.select("contig", "block", F.expr(f"repeat('A', cast(least(length - block * {CHUNK}, {CHUNK}) as int))").alias("seq"))
    out = V.add_deletions(v, holes, seqs, contigs(spark, d), merged=True).filter(F.map_contains_key("info", "ZERODEPTH"))
    return out.select(
        "sample", "chrom", "pos", "id", F.element_at("info", "END").cast("long").alias("end_"), F.element_at("info", "SVLEN").cast("long").alias("svlen"),
        F.array_join("alts", ",").alias("alt"),
    )


@query(
    "add_deletions_to_texts",
    """SELECT sample, chrom, pos, id, ref, alt, end_, svlen FROM (
         SELECT g.sample, g.contig AS chrom, greatest(g.s, 1) AS pos, 'DEL_' || CAST(row_number() OVER (PARTITION BY g.sample ORDER BY g.ord, g.s) AS STRING) AS id,
           CASE WHEN g.s > 0 THEN 'N' WHEN g.e >= g.n THEN g.seq ELSE substr(g.seq, 1, g.e + 1) END AS ref,
           CASE WHEN g.s > 0 THEN '<DEL>' ELSE '-' END AS alt, g.e AS end_, CASE WHEN g.s > 0 THEN g.s - g.e ELSE -g.e END AS svlen
         FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM v_alleles v WHERE v.sample = g.sample AND v.contig = g.contig
           AND v.pos <= g.e AND v.pos + length(v.ref) - 1 >= greatest(g.s, 1)))
       UNION ALL SELECT sample, contig, pos, '.', ref, alt, NULL, NULL FROM v_alleles""",
    ("v_alleles",),
    """names AS (SELECT DISTINCT sample FROM v_alleles UNION ALL SELECT 'Z'),
      holes AS (SELECT contig, ord, n, upper(seq) AS seq, CAST(0 AS BIGINT) AS s, least(n, 5 + ord % 300) AS e FROM v_sequences WHERE n > 0 AND ord % 3 = 0
        UNION ALL SELECT contig, ord, n, '', n // 2 + 200, n // 2 + 220 FROM v_sequences WHERE n > 700 AND ord % 3 < 2
        UNION ALL SELECT contig, ord, n, upper(seq), 0, n FROM v_sequences WHERE n > 0 AND ord % 3 = 2),
      gaps AS (SELECT names.sample, holes.* FROM holes, names)""",
)
def add_deletions_to_texts(spark, d):
    """Leading, inner and whole gaps of every text, for all samples with records and one without."""
    v = view(spark, d, "v_alleles").select(
        "sample", F.col("contig").alias("chrom"), "pos", F.lit(".").alias("id"), "ref", F.array("alt").alias("alts"), F.lit(None).cast("double").alias("qual"),
        strings().alias("filters"), X.empty_map().alias("info"), F.create_map(F.lit("GT"), F.col("gt")).alias("fmt"), F.col("rec_no").cast("long").alias("rec_no"),
    )
    v = stage(v)
    seqs = view(spark, d, "v_sequences").filter("n > 0")
    third, middle = F.col("ord") % 3, F.expr("cast(n div 2 + 200 as bigint)")
    lead = F.when(third == 0, F.least("n", 5 + F.col("ord") % 300)).when(third == 2, F.col("n"))
    spots = F.array(F.struct(F.lit(0).cast("long").alias("start"), lead.cast("long").alias("end")), F.struct(middle.alias("start"), (middle + 20).alias("end")))
    kept = F.filter(spots, lambda g: F.when(g["start"] == 0, third != 1).otherwise((third < 2) & (F.col("n") > 700)))
    names = F.concat(v.agg(F.sort_array(F.collect_set("sample"))).scalar(), F.array(F.lit("Z")))
    holes = seqs.select("contig", F.explode(kept).alias("g"), names.alias("names")).select(F.explode("names").alias("sample"), "contig", "g.*")
    frame = seqs.select("contig", F.col("n").cast("long").alias("length"), "ord")
    out = V.add_deletions(v, holes, seqs.select("contig", "seq"), frame, merged=True)
    return out.select(
        "sample", "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"),
        F.try_element_at("info", F.lit("END")).cast("long").alias("end_"), F.try_element_at("info", F.lit("SVLEN")).cast("long").alias("svlen"),
    )


@query(
    "deletion_keys",
    "SELECT DISTINCT sample, chrom, pos, pos + length(ref) - length(alt) AS end_ FROM v_variants WHERE length(ref) > length(alt) AND starts_with(ref, alt)",
    ("v_variants",),
)
def deletion_keys(spark, d):
    return V.deletion_keys(variants(spark, d)).withColumnRenamed("end", "end_")


@query(
    "new_deletions",
    """SELECT DISTINCT sample, chrom, pos, pos + 1 AS end_ FROM v_variants v WHERE NOT EXISTS (SELECT 1 FROM v_variants w
       WHERE w.sample = v.sample AND w.chrom = v.chrom AND w.pos = v.pos AND length(w.ref) = length(w.alt) + 1 AND starts_with(w.ref, w.alt))""",
    ("v_variants",),
)
def new_deletions(spark, d):
    v = variants(spark, d)
    every = v.select("sample", "chrom", "pos", (F.col("pos") + 1).alias("end")).distinct()
    return V.new_deletions(every, v).withColumnRenamed("end", "end_")


@query(
    "sorted_variants",
    "SELECT sample, chrom, pos, ref, alt FROM v_variants",
    ("v_variants",),
)
def sorted_variants(spark, d):
    return keys_of(V.sort_variants(variants(spark, d), contigs(spark, d)))
