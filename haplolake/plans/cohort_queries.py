"""Queries over cohorts: core sites, distances, outliers, trees, QC tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplolake.operators import cohort as K
from haplolake.operators import stats as S
from haplolake.operators import tree as T
from haplolake.operators import variants as V
from haplolake.plans.registry import query, variants
from haplolake.plans.views import table, view

_M = ("v_msa_sites",)
_SITES = """sites AS (SELECT site, count(*) FILTER (WHERE base IN ('A', 'C', 'G', 'T')) AS known, count(DISTINCT CASE WHEN base IN ('A', 'C', 'G', 'T') THEN base END) AS variants,
    min(CASE WHEN base IN ('A', 'C', 'G', 'T') THEN base END) AS base FROM v_msa_sites GROUP BY site)"""


def _msa(spark, d):
    return view(spark, d, "v_msa_sites")


@query(
    "soft_core",
    "SELECT site, known, variants FROM sites WHERE known * 1.0e0 / (SELECT count(DISTINCT sample) FROM v_msa_sites) >= 0.25e0 AND variants > 1",
    _M,
    _SITES,
)
def soft_core(spark, d):
    return K.soft_core(_msa(spark, d), 0.25)


@query(
    "core_alignment",
    """SELECT s.sample, string_agg(coalesce(m.base, '-'), '' ORDER BY c.site) AS seq FROM (SELECT DISTINCT sample FROM v_msa_sites) s, core c
       LEFT JOIN v_msa_sites m ON m.sample = s.sample AND m.site = c.site GROUP BY s.sample""",
    _M,
    _SITES + ", core AS (SELECT site FROM sites WHERE known * 1.0e0 / (SELECT count(DISTINCT sample) FROM v_msa_sites) >= 0.25e0 AND variants > 1)",
)
def core_alignment(spark, d):
    msa = _msa(spark, d)
    return K.core_alignment(msa, K.soft_core(msa, 0.25), block=256)


@query(
    "constant_sites",
    """SELECT count(*) FILTER (WHERE base = 'A') AS a, count(*) FILTER (WHERE base = 'C') AS c, count(*) FILTER (WHERE base = 'G') AS g, count(*) FILTER (WHERE base = 'T') AS t
       FROM sites WHERE variants = 1""",
    _M,
    _SITES,
)
def constant_sites(spark, d):
    return K.constant_sites(_msa(spark, d))


@query(
    "snp_distances",
    """SELECT p.a, p.b, coalesce(d.n, 0) AS distance FROM (SELECT x.sample AS a, y.sample AS b FROM names x JOIN names y ON x.sample < y.sample) p
       LEFT JOIN (SELECT x.sample AS a, y.sample AS b, count(*) AS n FROM known x JOIN known y ON x.site = y.site AND x.sample < y.sample AND x.base <> y.base GROUP BY 1, 2) d
       ON d.a = p.a AND d.b = p.b""",
    _M,
    "names AS (SELECT DISTINCT sample FROM v_msa_sites), known AS (SELECT * FROM v_msa_sites WHERE base IN ('A', 'C', 'G', 'T'))",
)
def snp_distances(spark, d):
    return K.snp_distances(_msa(spark, d), tile=128)


# five samples, each with the complement of every fifth contig
_FIVE = "five AS (SELECT contig, ord, n, CAST(k AS STRING) AS sample, k, CASE WHEN ord % 5 = k THEN translate(seq, 'ACGT', 'TGCA') ELSE seq END AS seq FROM (SELECT contig, ord, n, seq, unnest(range(5)) AS k FROM v_sequences))"


def _five(spark, d):
    s = view(spark, d, "v_sequences").select("contig", "ord", "seq", F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    own = F.when(F.col("ord") % 5 == F.col("k"), F.translate("seq", "ACGT", "TGCA")).otherwise(F.col("seq"))
    return s.select(F.col("k").cast("string").alias("sample"), "contig", "ord", "k", own.alias("seq"))


@query(
    "build_msa",
    """SELECT 1 AS ord, sample, string_agg(seq, '' ORDER BY f.ord) AS seq FROM five f GROUP BY sample
       UNION ALL SELECT 0, 'reference', string_agg(seq, '' ORDER BY ord) FROM v_sequences""",
    ("v_sequences",),
    _FIVE,
)
def build_msa(spark, d):
    ref = view(spark, d, "v_sequences").select("contig", F.col("ord").cast("int").alias("ord"), "seq")
    return K.build_msa(_five(spark, d).select("sample", "contig", "seq"), ref)


@query(
    "check_msa",
    """SELECT 'contigs' AS check_, sample, contig AS key, 'missing' AS detail FROM five WHERE (ord + k) % 11 = 0
       UNION ALL SELECT 'contigs', sample, contig, 'duplicate' FROM five WHERE (ord + k) % 11 = 1
       UNION ALL SELECT 'contigs', sample, 'x' || contig, 'extra' FROM five WHERE (ord + k) % 11 = 2
       UNION ALL SELECT 'contigs', sample, contig, 'missing' FROM five WHERE (ord + k) % 11 = 2
       UNION ALL SELECT 'contig_length', sample, contig, (n + 2) || ' bases for ' || n FROM five WHERE (ord + k) % 11 = 3""",
    ("v_sequences",),
    _FIVE,
)
def check_msa(spark, d):
    case = (F.col("ord") + F.col("k")) % 11
    bad = _five(spark, d).withColumn("case", case).where("case <> 0")
    times = F.when(F.col("case") == 1, 2).otherwise(1)
    bad = bad.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    name = F.when(F.col("case") == 2, F.concat(F.lit("x"), "contig")).otherwise(F.col("contig"))
    seq = F.when(F.col("case") == 3, F.concat("seq", F.lit("NN"))).otherwise(F.col("seq"))
    found = K.check_msa(bad.select("sample", name.alias("contig"), seq.alias("seq")), view(spark, d, "v_sequences").select("contig", "ord", "seq"))
    return found.withColumnRenamed("check", "check_")


@query(
    "mad_outliers",
    """SELECT sequence, aligned, m AS mad_median, 1.4826e0 * s AS mad_scaled, aligned < m - greatest(10.0e0, 3.5e0 * 1.4826e0 * s) AS removed
       FROM v_aligned, (SELECT median(aligned) AS m FROM v_aligned), (SELECT median(abs(aligned - (SELECT median(aligned) FROM v_aligned))) AS s FROM v_aligned)""",
    ("v_aligned",),
)
def mad_outliers(spark, d):
    return K.lower_mad(view(spark, d, "v_aligned")).select("sequence", "aligned", "mad_median", "mad_scaled", "removed")


# a second, lower cluster that is well above the minimum component weight
_TWO = "two AS (SELECT sequence, CASE WHEN CAST(sequence AS INT) % 7 = 0 AND aligned > 60 THEN aligned - 50 ELSE aligned END AS aligned FROM v_aligned)"


@query(
    "filter_samples",
    """SELECT sequence, aligned, aligned < 60 AS removed, CASE WHEN aligned < 60 THEN 'removed_by_gmm' ELSE 'retained_by_gmm' END AS filter_reason FROM two
       UNION ALL SELECT 'reference', 100.0e0, false, 'reference'""",
    ("v_aligned",),
    _TWO,
)
def filter_samples(spark, d):
    low = (F.col("sequence").cast("int") % 7 == 0) & (F.col("aligned") > 60)
    aligned = view(spark, d, "v_aligned").withColumn("aligned", F.when(low, F.col("aligned") - 50).otherwise(F.col("aligned")))
    ref = aligned.limit(1).select(F.lit("reference").alias("sequence"), F.lit(100.0).alias("aligned"))
    return K.filter_samples(aligned.unionByName(ref)).select("sequence", "aligned", "removed", "filter_reason")


@query(
    "cluster_ami",
    """SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM a) AS left_count, (SELECT count(*) FROM b) AS right_count,
       round((mi - emi) / ((hx + hy) / 2.0e0 - emi), 7) AS ami FROM
       (SELECT sum(nij / n * ln(n * nij / (ai * bj))) AS mi FROM cells JOIN a ON a.lang = cells.lang JOIN b ON b.source = cells.source, total),
       (SELECT -sum(ai / n * ln(ai / n)) AS hx FROM a, total), (SELECT -sum(bj / n * ln(bj / n)) AS hy FROM b, total),
       (SELECT sum(k / n * ln(n * k / (ai * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(n - ai + 1) + lgamma(n - bj + 1) - lgamma(n + 1) - lgamma(k + 1)
          - lgamma(ai - k + 1) - lgamma(bj - k + 1) - lgamma(n - ai - bj + k + 1))) AS emi FROM (SELECT ai, bj, n, CAST(unnest(range(greatest(1, CAST(ai + bj - n AS BIGINT)),
          CAST(least(ai, bj) AS BIGINT) + 1)) AS DOUBLE) AS k FROM a, b, total))""",
    (),
    """cells AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS nij FROM documents GROUP BY 1, 2), a AS (SELECT lang, sum(nij) AS ai FROM cells GROUP BY 1),
       b AS (SELECT source, sum(nij) AS bj FROM cells GROUP BY 1), total AS (SELECT sum(nij) AS n FROM cells)""",
)
def cluster_ami(spark, d):
    return K.adjusted_mutual_information(table(spark, d, "documents"), "lang", "source").withColumn("ami", F.round("ami", 7))


# --- trees --------------------------------------------------------------------------------


@query("scale_tree", "SELECT node, parent, len * 17 AS len FROM v_tree_edges", ("v_tree_edges",))
def scale_tree(spark, d):
    return T.scale_tree(view(spark, d, "v_tree_edges"), 10, "1,2,3,1")


@query(
    "newick_forest",
    """SELECT l_orderkey AS tree_id, 'L' || l_linenumber AS name, l_returnflag AS parent, CAST(l_quantity AS DOUBLE) AS len FROM lineitem
       UNION ALL SELECT l_orderkey, l_returnflag, 'O ' || l_orderkey, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY l_orderkey, l_returnflag
       UNION ALL SELECT DISTINCT l_orderkey, 'O ' || l_orderkey, NULL, NULL::DOUBLE FROM lineitem""",
)
def newick_forest(spark, d):
    """One Newick text per order, with a quoted name, read back into edges."""
    lines = table(spark, d, "lineitem")
    leaf = F.concat(F.lit("L"), F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_quantity").cast("double").cast("string"))
    inner = lines.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(leaf)).alias("below"), F.count("*").alias("n"))
    part = F.concat(F.lit("("), F.array_join("below", ", "), F.lit(")"), "l_returnflag", F.lit(":"), F.col("n").cast("string"))
    tree = F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(part)), ","), F.lit(")'O "), F.col("l_orderkey").cast("string"), F.lit("';"))
    edges = T.newick_edges(inner.groupBy("l_orderkey").agg(tree.alias("newick")).withColumnRenamed("l_orderkey", "tree_id"))
    above = edges.select("tree_id", F.col("node").alias("parent"), F.col("name").alias("above"))
    return edges.join(above, ["tree_id", "parent"], "left").select("tree_id", "name", F.col("above").alias("parent"), "len")


@query(
    "tree_distances",
    """SELECT x.node AS a, y.node AS b, x.depth + y.depth - 2 * CASE WHEN x.n = y.n THEN x.dn WHEN x.r = y.r THEN x.dr ELSE 0 END AS distance
       FROM tips x JOIN tips y ON x.node > y.node""",
    ("v_tree_edges",),
    """tips AS (SELECT s.node, s.parent AS n, n.parent AS r, n.len + r.len AS dn, r.len AS dr, s.len + n.len + r.len AS depth
       FROM v_tree_edges s JOIN v_tree_edges n ON n.node = s.parent JOIN v_tree_edges r ON r.node = n.parent WHERE s.node LIKE 'S%'
       UNION ALL SELECT n.node, n.node, n.parent, n.len + r.len, r.len, n.len + r.len FROM v_tree_edges n JOIN v_tree_edges r ON r.node = n.parent
         WHERE n.node LIKE 'N%' AND n.node NOT IN (SELECT parent FROM v_tree_edges))""",
)
def tree_distances(spark, d):
    return T.tree_distances(view(spark, d, "v_tree_edges"))


@query(
    "match_tips",
    "SELECT c_custkey, c_nationkey FROM customer WHERE 'N' || CAST(c_nationkey AS STRING) IN (SELECT node FROM v_tree_edges WHERE parent <> 'R0')",
    ("v_tree_edges",),
)
def match_tips(spark, d):
    tips = view(spark, d, "v_tree_edges").filter(F.col("parent") != "R0").select(F.col("node").alias("name"))
    meta = table(spark, d, "customer").withColumn("sample", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return T.match_tips(meta, tips).select("c_custkey", "c_nationkey")


@query(
    "subdivision_latlng",
    """SELECT c_custkey, CASE WHEN n_regionkey < 4 THEN CAST(n_nationkey AS DOUBLE) END AS latitude, CASE WHEN n_regionkey < 4 THEN n_regionkey + 0.5e0 END AS longitude
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def subdivision_latlng(spark, d):
    n = table(spark, d, "nation").filter(F.col("n_regionkey") < 4)
    lookup = n.select(F.col("n_nationkey").alias("code"), F.format_string("[%d, %d.5]", "n_nationkey", "n_regionkey").alias("latLng"))
    return T.with_subdivision_latlng(table(spark, d, "customer").withColumn("subdivision", F.col("c_nationkey")), lookup).select("c_custkey", "latitude", "longitude")


# --- QC tables ----------------------------------------------------------------------------


@query(
    "qc_join",
    "SELECT CAST(s_suppkey AS STRING) AS sample, s_acctbal AS vcf_qual_mean, a.aligned AS core_aligned_percent FROM supplier LEFT JOIN v_aligned a ON a.sequence = CAST(s_suppkey AS STRING) AND a.sequence <> '7'",
    ("v_aligned",),
)
def qc_join(spark, d):
    qc = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sample"), F.col("s_acctbal").alias("vcf_qual_mean"))
    return S.add_core_alignment_qc(qc, view(spark, d, "v_aligned"), reference="7")


@query(
    "sample_qc",
    """SELECT sample, CASE WHEN sample < 'N' THEN 'short' ELSE 'long' END AS pipeline_type, count(*) AS vcf_total, avg(qual) AS vcf_qual_mean, min(CAST(dp AS DOUBLE)) AS vcf_depth_min,
       (SELECT sum(length(text)) FROM documents WHERE CAST(doc_id % 6 AS INT) = g.k) AS final_length
       FROM v_variants v JOIN (SELECT sample AS s, row_number() OVER (ORDER BY sample) - 1 AS k FROM (SELECT DISTINCT sample FROM v_variants)) g ON g.s = v.sample GROUP BY sample, g.k""",
    ("v_variants",),
)
def sample_qc(spark, d):
    v = variants(spark, d)
    names = F.array(*[F.lit(n) for n in ("AF", "AO", "NF", "NO", "RF", "RO")])
    docs = table(spark, d, "documents").select(F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("sample"), F.col("text").alias("seq"))
    samples = v.select("sample").distinct().withColumn("pipeline_type", F.when(F.col("sample") < "N", "short").otherwise("long"))
    out = S.sample_qc(samples, vcf=S.vcf_summary(v), fasta=S.composition(docs))
    return out.select("sample", "pipeline_type", "vcf_total", "vcf_qual_mean", "vcf_depth_min", "final_length")


@query(
    "union_by_name",
    """SELECT CAST(c_custkey AS STRING) AS sample, c_acctbal AS vcf_qual_mean, NULL::DOUBLE AS vcf_depth_mean, c_mktsegment AS zone FROM customer
       UNION ALL SELECT CAST(s_suppkey AS STRING), NULL, s_acctbal, NULL FROM supplier""",
)
def union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_mktsegment").alias("zone"), F.col("c_acctbal").alias("vcf_qual_mean"), F.col("c_custkey").cast("string").alias("sample"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("vcf_depth_mean"), F.col("s_suppkey").cast("string").alias("sample"))
    return S.union_by_name([a, b])


@query("union_strict", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT c_custkey, c_name FROM customer")
def union_strict(spark, d):
    parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name")]
    return S.union_strict([table(spark, d, t).select(F.col(k).cast("long").alias("k"), F.col(n).alias("name")) for t, k, n in parts])


@query(
    "inner_join_tables",
    "SELECT o_custkey AS k, o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def inner_join_tables(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    return S.inner_join_tables(o, c, "k")


@query(
    "check_unique",
    """SELECT 'unique' AS "check", CAST(l_orderkey AS STRING) AS key, CAST(count(*) AS STRING) || ' rows' AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""",
)
def check_unique(spark, d):
    from haplolake.operators.checks import check_unique as check

    return check(table(spark, d, "lineitem"), "l_orderkey").drop("sample")


@query(
    "check_aligned_percent",
    """SELECT CAST(s_suppkey AS STRING) AS sample, CAST(s_acctbal / 100 AS VARCHAR) IS NOT NULL AS bad FROM supplier WHERE s_acctbal / 100 < 0 OR s_acctbal / 100 > 90 - 90 + 100""",
)
def check_aligned_percent(spark, d):
    from haplolake.operators.checks import check_aligned_percent as check

    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sequence"), (F.col("s_acctbal") / 100).alias("aligned"))
    return check(rows).select("sample", F.lit(True).alias("bad"))


@query(
    "split_failures",
    "SELECT sample, count(*) AS n FROM v_variants WHERE sample NOT IN (SELECT sample FROM v_variants GROUP BY 1 HAVING count(*) > (SELECT count(*) / 6 FROM v_variants)) GROUP BY 1",
    ("v_variants",),
)
def split_failures(spark, d):
    from haplolake.operators.checks import split_failures as split

    v = variants(spark, d)
    mean = v.agg((F.count("*") / 6).alias("m")).scalar()
    sizes = v.groupBy("sample").agg(F.count("*").alias("n")).filter(F.col("n") > mean)
    bad = sizes.select(F.lit("size").alias("check"), "sample", F.lit("rows").alias("key"), F.col("n").cast("string").alias("detail"))
    return split(v, bad)[0].groupBy("sample").agg(F.count("*").alias("n"))
