"""Queries over sequences, reads, features and sample files."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplolake.functions import alleles as A
from haplolake.functions import fields as X
from haplolake.functions import names as N
from haplolake.operators import reads as R
from haplolake.operators import samples as P
from haplolake.operators import sequences as Q
from haplolake.operators import stats as S
from haplolake.plans.registry import query, strings
from haplolake.plans.views import table, view
from haplolake.sources.readers import peek_contents

_S = ("v_sequences",)


@query("clean_bases", "SELECT contig, regexp_replace(translate(upper(replace(raw, 'ß', 'ss')), 'U', 'T'), '[^ACGTN]', 'N', 'g') AS seq FROM v_sequences", _S)
def clean_bases(spark, d):
    return view(spark, d, "v_sequences").select("contig", A.clean_bases(F.col("raw")).alias("seq"))


@query("reverse_complement", "SELECT contig, translate(reverse(seq), 'ACGTN', 'TGCAN') AS seq FROM v_sequences", _S)
def reverse_complement(spark, d):
    return view(spark, d, "v_sequences").select("contig", A.reverse_complement(F.col("seq")).alias("seq"))


def _count(letter: str) -> str:
    return f"sum(length(seq) - length(replace(seq, '{letter}', '')))"


@query(
    "composition",
    f"""SELECT *, final_acgt * 1.0e0 / final_length AS final_acgt_fraction, final_upper_n * 1.0e0 / final_length AS final_upper_n_fraction,
        final_lower_n * 1.0e0 / final_length AS final_lower_n_fraction, final_gap * 1.0e0 / final_length AS final_gap_fraction,
        final_length - final_acgt - final_upper_n - final_lower_n - final_gap AS final_other
        FROM (SELECT *, "final_A" + "final_C" + "final_G" + "final_T" AS final_acgt FROM (SELECT lang AS sample, sum(length(seq)) AS final_length,
          {', '.join(f'{_count(b)} + {_count(b.lower())} AS "final_{b}"' for b in 'ACGT')}, {_count('N')} AS final_upper_n, {_count('n')} AS final_lower_n, {_count('-')} AS final_gap
          FROM (SELECT lang, text AS seq FROM documents) GROUP BY lang))""",
)
def composition(spark, d):
    return S.composition(table(spark, d, "documents").select(F.col("lang").alias("sample"), F.col("text").alias("seq")))


@query(
    "aligned_pct",
    "SELECT contig AS sequence, length(regexp_replace(upper(raw), '[^ACGT]', '', 'g')) * 100.0e0 / length(raw) AS aligned FROM v_sequences",
    _S,
)
def aligned_pct(spark, d):
    return S.aligned_percent(view(spark, d, "v_sequences").select(F.col("contig").alias("sample"), F.col("raw").alias("seq")))


@query(
    "reference_summary",
    "SELECT (SELECT count(*) FROM v_sequences) AS num_sequences, (SELECT sum(length(seq)) FROM v_sequences) AS total_length, (SELECT count(*) FROM v_features) AS num_features",
    ("v_sequences", "v_features"),
)
def reference_summary(spark, d):
    return S.reference_summary(view(spark, d, "v_sequences"), view(spark, d, "v_features"))


# --- edits of document sequences ---------------------------------------------------------


def _edits(spark, d):
    v = view(spark, d, "v_alleles")
    return v.select(
        "sample", F.col("contig").alias("chrom"), "pos", F.lit(".").alias("id"), "ref", F.array("alt").alias("alts"), F.lit(60.0).alias("qual"),
        strings(F.when(F.col("pos") % 11 == 0, "LowQual").otherwise("PASS")).alias("filters"), X.empty_map().alias("info"),
        F.create_map(F.lit("GT"), F.col("gt")).alias("fmt"), "rec_no",
    )


_SPAN = """spots AS (SELECT DISTINCT sample, contig, pos - 1 AS s, pos - 1 + length(ref) AS e FROM v_alleles WHERE pos % 5 = 0),
    inside AS (SELECT sample, contig, unnest(range(s, e)) AS p FROM spots),
    covered AS (SELECT DISTINCT sample, contig, p FROM inside)"""


@query(
    "mask_sequences",
    """SELECT q.sample, q.contig, string_agg(CASE WHEN c.p IS NULL THEN q.b ELSE 'X' END, '' ORDER BY q.p) AS seq
       FROM (SELECT g.sample, s.contig, unnest(range(length(s.seq))) AS p, unnest(string_split(s.seq, '')) AS b FROM v_sequences s, (SELECT DISTINCT sample FROM v_alleles) g) q
       LEFT JOIN covered c ON c.sample = q.sample AND c.contig = q.contig AND c.p = q.p GROUP BY 1, 2""",
    ("v_alleles",),
    _SPAN,
)
def mask_sequences(spark, d):
    v = view(spark, d, "v_alleles")
    names = v.agg(F.sort_array(F.collect_set("sample"))).scalar()
    seqs = view(spark, d, "v_sequences").filter(F.length("seq") > 0).select("contig", "seq", F.explode(names).alias("sample"))
    bed = v.filter(F.col("pos") % 5 == 0).select("sample", "contig", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end"))
    return Q.mask_sequences(seqs, bed, "X", size=1024)


@query(
    "consensus",
    """SELECT q.sample, q.contig, string_agg(coalesce(w.b, q.b), '' ORDER BY q.p) AS seq
       FROM (SELECT g.sample, s.contig, unnest(range(length(s.seq))) AS p, unnest(string_split(s.seq, '')) AS b FROM v_sequences s, (SELECT DISTINCT sample FROM v_alleles) g) q
       LEFT JOIN written w ON w.sample = q.sample AND w.contig = q.contig AND w.p = q.p GROUP BY 1, 2""",
    ("v_alleles",),
    """RECURSIVE usable AS (SELECT sample, contig, pos, arg_min(ref, rec_no) AS ref, arg_min(alt, rec_no) AS alt
        FROM (SELECT * FROM v_alleles WHERE pos % 11 <> 0 AND length(alt) <= length(ref)) GROUP BY 1, 2, 3),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY sample, contig ORDER BY pos) AS i FROM usable),
      walk AS (SELECT sample, contig, pos, ref, alt, i, pos + length(ref) AS free, true AS kept FROM ranked WHERE i = 1
        UNION ALL SELECT r.sample, r.contig, r.pos, r.ref, r.alt, r.i, CASE WHEN r.pos >= w.free THEN r.pos + length(r.ref) ELSE w.free END, r.pos >= w.free
        FROM walk w JOIN ranked r ON r.sample = w.sample AND r.contig = w.contig AND r.i = w.i + 1),
      written AS (SELECT sample, contig, pos - 1 + k AS p, CASE WHEN k >= length(alt) THEN '-' WHEN substr(alt, k + 1, 1) = substr(ref, k + 1, 1) THEN substr(alt, k + 1, 1)
        ELSE lower(substr(alt, k + 1, 1)) END AS b FROM (SELECT *, unnest(range(length(ref))) AS k FROM walk WHERE kept))""",
)
def consensus(spark, d):
    seqs = view(spark, d, "v_sequences").filter(F.length("seq") > 0)
    return Q.consensus(seqs, _edits(spark, d), size=1024)


@query(
    "ref_mismatches",
    """SELECT DISTINCT a.sample, a.contig AS chrom, a.pos, substr(a.ref, 1, 1) || 'A' AS ref, a.alt FROM v_alleles a JOIN v_sequences s ON s.contig = a.contig
       WHERE substr(s.seq, CAST(a.pos + 1 AS INT), 1) <> 'A'""",
    ("v_alleles",),
)
def ref_mismatches(spark, d):
    v = _edits(spark, d).withColumn("ref", F.concat(F.substring("ref", 1, 1), F.lit("A")))
    return Q.reference_mismatches(v, view(spark, d, "v_sequences"), size=512)


@query(
    "normalize",
    """SELECT sample, contig AS chrom, pos + skip AS pos, substr(ref, skip + 1) AS ref, substr(alt, skip + 1) AS alt, rec_no FROM (
       SELECT *, CASE WHEN length(ref) > 1 AND length(alt) > 1 THEN coalesce(list_min(list_filter(range(0, least(length(ref), length(alt)) - 1),
         lambda k: substr(ref, k + 1, 1) <> substr(alt, k + 1, 1))), least(length(ref), length(alt)) - 1) ELSE 0 END AS skip
       FROM walk WHERE final)""",
    ("v_alleles",),
    """RECURSIVE walk AS (
        SELECT sample, contig, pos, ref, alt, rec_no, right(ref, 1) <> right(alt, 1) OR (least(length(ref), length(alt)) = 1 AND (pos = 1 OR length(ref) = length(alt))) AS final FROM v_alleles
        UNION ALL
        SELECT sample, contig, pos, ref, alt, rec_no, right(ref, 1) <> right(alt, 1) OR (least(length(ref), length(alt)) = 1 AND (pos = 1 OR length(ref) = length(alt))) FROM (
          SELECT w.sample, w.contig, CASE WHEN least(length(w.ref), length(w.alt)) = 1 THEN w.pos - 1 ELSE w.pos END AS pos,
            CASE WHEN least(length(w.ref), length(w.alt)) = 1 THEN substr(s.seq, CAST(w.pos - 1 AS INT), 1) ELSE '' END || left(w.ref, length(w.ref) - 1) AS ref,
            CASE WHEN least(length(w.ref), length(w.alt)) = 1 THEN substr(s.seq, CAST(w.pos - 1 AS INT), 1) ELSE '' END || left(w.alt, length(w.alt) - 1) AS alt, w.rec_no
          FROM walk w JOIN v_sequences s ON s.contig = w.contig WHERE NOT w.final))""",
)
def normalize(spark, d):
    out = Q.normalize(_edits(spark, d), view(spark, d, "v_sequences"), size=256)
    return out.select("sample", "chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "rec_no")


_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _aa(codon: str) -> str:
    at = " + ".join(f"(instr('TCAG', substr({codon}, {i}, 1)) - 1) * {w}" for i, w in ((1, 16), (2, 4), (3, 1)))
    return f"CASE WHEN contains({codon}, 'N') THEN 'X' ELSE substr('{_CODE}', {at} + 1, 1) END"


@query(
    "consequences",
    """SELECT sample, chrom, pos, ref, alt, csq FROM labelled""",
    ("v_alleles",),
    f"""cds AS (SELECT contig, 't' || contig AS transcript, CASE WHEN ord % 2 = 0 THEN '+' ELSE '-' END AS strand, 6 AS s, 6 + (length(seq) - 6) // 3 * 3 AS e, seq FROM v_sequences WHERE length(seq) > 16),
      snv AS (SELECT a.sample, a.contig AS chrom, a.pos, a.ref, a.alt, c.transcript, c.strand, c.seq, c.s, c.e,
        CASE WHEN c.strand = '+' THEN a.pos - 1 - c.s ELSE c.e - a.pos END AS o FROM v_alleles a LEFT JOIN cds c ON c.contig = a.contig AND a.pos > c.s AND a.pos <= c.e
        WHERE length(a.ref) = 1 AND length(a.alt) = 1),
      codon AS (SELECT *, o // 3 AS n, CASE WHEN strand = '+' THEN substr(seq, CAST(s + o // 3 * 3 + 1 AS INT), 3) ELSE translate(reverse(substr(seq, CAST(e - o // 3 * 3 - 2 AS INT), 3)), 'ACGTN', 'TGCAN') END AS c0,
        CASE WHEN strand = '+' THEN alt ELSE translate(alt, 'ACGTN', 'TGCAN') END AS b FROM snv),
      swapped AS (SELECT *, substr(c0, 1, CAST(o % 3 AS INT)) || b || substr(c0, CAST(o % 3 AS INT) + 2) AS c1 FROM codon),
      amino AS (SELECT *, {_aa('c0')} AS r, {_aa('c1')} AS a FROM swapped),
      labelled AS (SELECT sample, chrom, pos, ref, alt, CASE WHEN transcript IS NULL THEN '' ELSE concat_ws('|',
        CASE WHEN r = a THEN 'synonymous' WHEN n = 0 THEN 'start_lost' WHEN a = '*' THEN 'stop_gained' WHEN r = '*' THEN 'stop_lost' ELSE 'missense' END,
        transcript, transcript, 'protein_coding', strand, CASE WHEN r = a THEN CAST(n + 1 AS STRING) || r ELSE CAST(n + 1 AS STRING) || r || '>' || CAST(n + 1 AS STRING) || a END,
        CAST(pos AS STRING) || ref || '>' || alt) END AS csq FROM amino)""",
)
def consequences(spark, d):
    seqs = view(spark, d, "v_sequences").filter(F.length("seq") > 16)
    name = F.concat(F.lit("t"), F.col("contig"))
    cds = seqs.select(
        "contig", F.lit(6).cast("long").alias("start"), F.expr("6 + (length(seq) - 6) div 3 * 3").alias("end"),
        F.when(F.col("ord") % 2 == 0, "+").otherwise("-").alias("strand"), name.alias("gene"), name.alias("transcript"), F.lit("protein_coding").alias("biotype"),
    )
    v = _edits(spark, d).filter((F.length("ref") == 1) & (F.length(F.get("alts", F.lit(0))) == 1))
    out = Q.annotate_consequences(v, cds, seqs)
    return out.select("sample", "chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), F.coalesce(F.try_element_at("info", F.lit("BCSQ")), F.lit("")).alias("csq"))


_FLAT = """flat AS (SELECT contig, type, start_, end_, strand, gene_id, min(feature_no) AS feature_no FROM (
      SELECT 'chr' || CAST(l_suppkey % 4 AS STRING) AS contig, CASE l_linenumber WHEN 1 THEN 'gene' WHEN 2 THEN 'CDS' WHEN 3 THEN 'exon' WHEN 4 THEN 'tRNA' WHEN 5 THEN 'source' ELSE 'CDS' END AS type,
        l_orderkey AS start_, l_orderkey + CAST(l_quantity AS BIGINT) AS end_, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'g' || CAST(l_partkey AS STRING) AS gene_id,
        l_orderkey * 8 + l_linenumber AS feature_no FROM lineitem) GROUP BY ALL)"""


@query(
    "gff_rollup",
    """SELECT contig, 'gene' AS type, min(start_) AS start_, max(end_) AS end_, 'gene:' || gene_id AS id, '' AS parent FROM kept GROUP BY contig, gene_id
       UNION ALL SELECT contig, 'transcript', min(start_), max(end_), 'transcript:' || gene_id || '_transcript_1', 'gene:' || gene_id FROM kept WHERE type <> 'gene' GROUP BY contig, gene_id
       UNION ALL SELECT contig, type, start_, end_, '', 'transcript:' || gene_id || '_transcript_1' FROM flat WHERE type IN ('CDS', 'exon')
       UNION ALL SELECT contig, 'gene', start_, end_, 'gene:' || gene_id, '' FROM flat WHERE type = 'tRNA'""",
    (),
    _FLAT
    + """, body AS (SELECT *, row_number() OVER (PARTITION BY contig, gene_id ORDER BY feature_no, start_, end_, strand) AS r FROM flat WHERE type IN ('gene', 'CDS', 'exon')),
      kept AS (SELECT * FROM body WHERE type <> 'gene' OR r = 1)""",
)
def gff_rollup(spark, d):
    l = table(spark, d, "lineitem")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("gene", "CDS", "exon", "tRNA", "source", "CDS", "CDS")]), F.col("l_linenumber"))
    flat = (
        l.select(
            F.concat(F.lit("chr"), (F.col("l_suppkey") % 4).cast("string")).alias("contig"), kinds.alias("type"), F.col("l_orderkey").alias("start"),
            (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
            F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("feature_no"),
        )
        .groupBy("contig", "type", "start", "end", "strand", "gene_id").agg(F.min("feature_no").alias("feature_no"))
        .withColumn("attributes", F.create_map(F.lit("locus_tag"), F.col("gene_id")))
    )
    out = Q.gene_models(flat)
    return out.select("contig", "type", F.col("start").alias("start_"), F.col("end").alias("end_"), F.coalesce("id", F.lit("")).alias("id"), F.coalesce("parent", F.lit("")).alias("parent"))


# --- reads --------------------------------------------------------------------------------

_READS = """reads AS (SELECT sample AS file, contig AS read_id, 1 AS mate, seq, translate(seq, 'ACGTN', '!5?I#') AS qual, ord FROM v_sequences)"""


def _reads(spark, d):
    s = view(spark, d, "v_sequences")
    return s.select(F.col("sample").alias("file"), F.col("contig").alias("read_id"), F.lit(1).alias("mate"), "seq", F.translate("seq", "ACGTN", "!5?I#").alias("qual"), "ord")


@query(
    "read_stats_n50",
    """SELECT file, count(*) AS num_seqs, sum(len) AS sum_len, min(len) AS min_len, avg(len) AS avg_len, max(len) AS max_len,
       quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS q2, quantile_cont(len, 0.75) AS q3, 0 AS sum_gap,
       max(len) FILTER (WHERE down * 2 >= total) AS n50, max(len) FILTER (WHERE down * 10 >= total * 9) AS n90,
       sum(len - length(replace(replace(replace(seq, 'C', ''), 'G', ''), 'T', ''))) * 0 + (sum(length(seq) - length(replace(replace(replace(seq, 'C', ''), 'G', ''), 'T', '')))) * 100.0e0 / sum(len) AS q20_percent,
       sum(length(seq) - length(replace(replace(seq, 'G', ''), 'T', ''))) * 100.0e0 / sum(len) AS q30_percent,
       sum(length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) * 100.0e0 / sum(len) AS gc_percent
       FROM (SELECT *, length(seq) AS len, sum(length(seq)) OVER (PARTITION BY file ORDER BY length(seq) DESC) AS down, sum(length(seq)) OVER (PARTITION BY file) AS total FROM reads) GROUP BY file""",
    _S,
    _READS,
)
def read_stats_n50(spark, d):
    return R.read_stats(_reads(spark, d), all_stats=True, n_stats=(90,))


@query(
    "merge_read_stats",
    """SELECT lang AS sample, string_agg(source, ',' ORDER BY source) AS read_files, sum(n) AS read_num_seqs, sum(l) AS read_sum_len, min(lo) AS read_min_len,
       sum(l * 1.0e0 / n * n) / sum(n) AS read_avg_len, max(hi) AS read_max_len
       FROM (SELECT lang, source, count(*) AS n, sum(length(text)) AS l, min(length(text)) AS lo, max(length(text)) AS hi FROM documents GROUP BY 1, 2) GROUP BY 1""",
)
def merge_read_stats(spark, d):
    docs = table(spark, d, "documents").select("lang", F.concat_ws("/", "lang", "source").alias("file"), F.col("text").alias("seq"))
    stats = R.read_stats(docs).withColumns({"sample": F.substring_index("file", "/", 1), "ord": F.substring_index("file", "/", -1)})
    return S.merge_read_stats(stats.withColumn("file", F.substring_index("file", "/", -1)))


_BAD = "len < 200 OR low * 100.0e0 > len * 26.0e0 OR n > 5"


@query(
    "clean_reads",
    f"""SELECT read_id FROM (SELECT read_id, length(seq) AS len, length(seq) - length(replace(replace(seq, 'A', ''), 'N', '')) AS low, length(seq) - length(replace(seq, 'N', '')) AS n FROM reads)
        WHERE NOT ({_BAD})""",
    _S,
    _READS,
)
def clean_reads(spark, d):
    return R.clean_reads(_reads(spark, d), 200, 26, 5).select("read_id")


@query(
    "clean_read_pairs",
    f"""SELECT read_id FROM (SELECT ord // 2 AS pair, contig AS read_id, bool_or({_BAD}) OVER (PARTITION BY ord // 2) AS bad FROM (SELECT ord, contig, length(seq) AS len,
        length(seq) - length(replace(replace(seq, 'A', ''), 'N', '')) AS low, length(seq) - length(replace(seq, 'N', '')) AS n FROM v_sequences)) WHERE NOT bad""",
    _S,
)
def clean_read_pairs(spark, d):
    pairs = _reads(spark, d).withColumn("name", F.col("read_id")).withColumn("read_id", F.expr("ord div 2")).withColumn("mate", F.col("ord") % 2 + 1)
    return R.clean_reads(pairs, 200, 26, 5, paired=True).select(F.col("name").alias("read_id"))


@query(
    "clean_long_reads",
    """SELECT read_id FROM reads WHERE length(seq) >= 1000 AND -10 * log10((length(replace(translate(seq, 'CGTN', '----'), '-', '')) * 1.0e0
       + length(replace(translate(seq, 'AGTN', '----'), '-', '')) * pow(10.0e0, -2.0e0) + length(replace(translate(seq, 'ACTN', '----'), '-', '')) * pow(10.0e0, -3.0e0)
       + length(replace(translate(seq, 'ACGN', '----'), '-', '')) * pow(10.0e0, -4.0e0) + (length(seq) - length(replace(seq, 'N', ''))) * pow(10.0e0, -0.2e0)) / length(seq)) >= 5""",
    _S,
    _READS,
)
def clean_long_reads(spark, d):
    return R.clean_long_reads(_reads(spark, d), 1000, 5.0).select("read_id")


@query("dup_reads", "SELECT min(CAST(doc_id AS STRING)) AS read_id FROM documents GROUP BY text")
def dup_reads(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("read_id"), F.col("text").alias("seq"))
    return R.dedup_reads(docs).select("read_id")


_HASH = "CAST('0x' || substr(md5('42:' || {}), 1, 15) AS BIGINT)"


@query(
    "downsample_fraction",
    f"SELECT qname, flag, pos, mapq FROM v_alignments WHERE {_HASH.format('qname')} < {int(0.25 * (1 << 60))}",
    ("v_alignments",),
)
def downsample_fraction(spark, d):
    return R.sample_fraction(view(spark, d, "v_alignments"), 0.25).select("qname", "flag", "pos", "mapq")


@query(
    "sample_to_coverage",
    f"""SELECT read_id FROM (SELECT read_id, sum(length(seq)) OVER (ORDER BY {_HASH.format('read_id')}, read_id) - length(seq) AS before FROM reads) WHERE before < 500000""",
    _S,
    _READS,
)
def sample_to_coverage(spark, d):
    return R.sample_to_coverage(_reads(spark, d), 5.0, 100000).select("read_id")


@query(
    "sample_n",
    f"""SELECT l_orderkey AS read_id, l_linenumber AS mate FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem)
        ORDER BY {_HASH.format('CAST(l_orderkey AS STRING)')}, l_orderkey LIMIT 700)""",
)
def sample_n(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("mate"))
    return R.sample_n(l, 700)


# --- sample files -------------------------------------------------------------------------

_KIND = """kinds AS (SELECT path, CASE WHEN path LIKE '%.fasta' THEN 'ASM' WHEN path LIKE '%.fq' THEN 'ONT' ELSE 'ILL' END AS kind,
    regexp_replace(regexp_replace(string_split(path, '/')[-1], '\\.(gz|xz|zstd)$', ''), '\\.(fq|fastq|fa|fasta|fna)$', '') AS sample, regexp_replace(path, '/[^/]*$', '') AS parent FROM v_files),
    paired AS (SELECT *, sample AS id FROM kinds)"""


_HEADS = """heads AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '@RG' || chr(9) || 'ID:a' || chr(9) || 'PL:illumina' WHEN 1 THEN '@PG' || chr(9) || 'ID:m' || chr(9) || 'CL:mm2 -ax map-ont'
        WHEN 2 THEN '@RG' || chr(9) || 'ID:a' || chr(9) || 'PL:PACBIO' ELSE '@HD' || chr(9) || 'VN:1.6' END AS head FROM orders),
    seqs AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN 4 WHEN l_linenumber = 2 THEN 256 WHEN l_orderkey % 11 = 3 THEN 2048 ELSE 16 END AS flag,
        CAST(l_quantity * 40 AS INT) AS bases FROM lineitem)"""


@query(
    "discover_alignments",
    """SELECT '/d/s' || o_orderkey || '.sam' AS path, median_length,
         CASE WHEN o_orderkey % 7 = 0 THEN 'ILL' WHEN o_orderkey % 7 IN (1, 2) THEN 'ONT' WHEN median_length >= 1000 THEN 'ONT' WHEN median_length IS NOT NULL THEN 'ILL' END AS kind
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 OR first_line > 1 THEN lengths[len(lengths) // 2 + 1] END AS median_length
             FROM heads LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS first_line, list_sort(list(bases) FILTER (WHERE flag = 16)) AS lengths FROM seqs GROUP BY 1) ON l_orderkey = o_orderkey)""",
    (),
    _HEADS,
)
def discover_alignments(spark, d):
    """One SAM file per order, classified by platform, preset or the median of its reads."""
    tab = F.lit("\t")
    text = lambda *cells: F.concat_ws("\t", *cells)
    k = F.col("o_orderkey") % 7
    head = F.when(k == 0, "@RG\tID:a\tPL:illumina").when(k == 1, "@PG\tID:m\tCL:mm2 -ax map-ont").when(k == 2, "@RG\tID:a\tPL:PACBIO").otherwise("@HD\tVN:1.6")
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    flag = F.when((line == 1) & (key % 5 == 0), 4).when(line == 2, 256).when(key % 11 == 3, 2048).otherwise(16)
    seq = F.repeat(F.lit("A"), (F.col("l_quantity") * 40).cast("int"))
    record = F.concat(F.lit("r"), tab, flag.cast("string"), tab, text(F.lit("c"), F.lit("1"), F.lit("60"), F.lit("9M"), F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*")))
    records = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", record.alias("value")))).alias("r"))
    lines = F.concat_ws("\n", F.array(head), F.transform("r", lambda x: x["value"]))
    files = table(spark, d, "orders").join(records, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        F.concat(F.lit("/d/s"), F.col("o_orderkey").cast("string"), F.lit(".sam")).alias("path"), F.encode(lines, "UTF-8").alias("content")
    )
    return P.classify_files(peek_contents(files)).select("path", "median_length", "kind")


@query("classify_files", "SELECT path, kind, sample FROM kinds", ("v_files",), _KIND)
def classify_files(spark, d):
    return P.with_sample_ids(P.classify_files(view(spark, d, "v_files"))).select("path", "kind", "sample")


def _pairs(spark, d):
    """Both mates of a file in each folder level."""
    return table(spark, d, "orders").select(
        F.concat(F.lit("/runs/b"), (F.col("o_custkey") % 5).cast("string"), F.lit("/s"), F.expr("o_orderkey div 4").cast("string"), F.lit("_R"), (F.col("o_orderkey") % 2 + 1).cast("string"), F.lit(".fastq.gz")).alias("path")
    ).distinct().withColumn("first_line", F.lit("@x"))


_MATES = """files AS (SELECT DISTINCT '/runs/b' || CAST(o_custkey % 5 AS STRING) AS parent, 's' || CAST(o_orderkey // 4 AS STRING) AS base, CAST(o_orderkey % 2 + 1 AS STRING) AS mate FROM orders),
    named AS (SELECT *, parent || '/' || base || '_R' || mate || '.fastq.gz' AS path, CASE WHEN count(*) OVER (PARTITION BY parent, base) = 2 THEN base ELSE base || '_R' || mate END AS sample FROM files),
    homes AS (SELECT sample, count(DISTINCT parent) AS n FROM named GROUP BY 1),
    resolved AS (SELECT a.path, a.mate, CASE WHEN h.n > 1 THEN substr(a.parent, 7) || '-' || a.sample ELSE a.sample END AS sample FROM named a JOIN homes h ON h.sample = a.sample)"""


@query("pair_reads", "SELECT path, sample FROM named", (), _MATES)
def pair_reads(spark, d):
    return P.pair_reads(P.with_sample_ids(P.classify_files(_pairs(spark, d)))).select("path", "sample")


@query("resolve_sample_ids", "SELECT path, sample FROM resolved", (), _MATES)
def resolve_sample_ids(spark, d):
    return P.resolve_sample_ids(P.pair_reads(P.with_sample_ids(P.classify_files(_pairs(spark, d))))).select("path", "sample")


@query(
    "sample_sheet",
    """SELECT sample, 'short' AS type, min(path) AS "left", CASE WHEN count(*) = 2 THEN max(path) END AS "right" FROM resolved GROUP BY sample""",
    (),
    _MATES,
)
def sample_sheet(spark, d):
    files = P.resolve_sample_ids(P.pair_reads(P.with_sample_ids(P.classify_files(_pairs(spark, d)))))
    return P.build_sample_sheet(files).select("sample", "type", "left", "right")


@query(
    "sample_type_counts",
    "SELECT CASE kind WHEN 'ILL' THEN 'short' WHEN 'ONT' THEN 'long' ELSE 'asm' END AS type, count(DISTINCT sample || parent) AS n FROM kinds GROUP BY 1",
    ("v_files",),
    _KIND,
)
def sample_type_counts(spark, d):
    files = P.resolve_sample_ids(P.with_sample_ids(P.classify_files(view(spark, d, "v_files"))))
    return P.sample_type_counts(P.build_sample_sheet(files))


@query("json_lookup", "SELECT event_id, lower(trim(coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k')))) AS value FROM events")
def json_lookup(spark, d):
    return table(spark, d, "events").select("event_id", X.json_first(F.col("props"), "$.name", "$.k").alias("value"))


@query("duplicate_names", "SELECT o_orderkey AS ord, CASE WHEN r = 1 THEN o_orderpriority ELSE o_orderpriority || ' (' || CAST(r AS STRING) || ')' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS r FROM orders)")
def duplicate_names(spark, d):
    from haplolake.operators.variants import unique_names

    o = table(spark, d, "orders").select(F.concat_ws("|", "o_orderpriority", F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("ord"))
    out = unique_names(o)
    return out.select("ord", F.regexp_replace("label", r"\|\d+", "").alias("label"))
