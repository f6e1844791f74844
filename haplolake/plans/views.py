"""Genomic tables derived from the TPC-H-style Parquet tables.

Each view is one SQL text in the syntax Spark and DuckDB share, so that a query
and its check read the same rows. Coordinates are a multiple of the order key:
the genome grows with the tables and its density stays constant.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Letters of prose to bases, as two aligned alphabets.
_LETTERS = "abcdefghijklmnopqrstuvwxyz .,"
_BASES = "ACGTACGTACGTACGTACGTACGTACGTA"

VIEWS: dict[str, str] = {
    # one row per (sample, chrom, pos, ref, alt)
    "v_variants": """
        SELECT l_returnflag || l_linestatus AS sample,
               'chr' || CAST(l_suppkey % 4 AS STRING) AS chrom,
               CAST(l_orderkey * 40 + l_partkey % 40 + 1 AS BIGINT) AS pos,
               CASE WHEN l_partkey % 10 IN (0, 2) THEN substr('ACGT', CAST((l_linenumber + l_partkey) % 4 AS INT) + 1, 1) || 'A'
                    ELSE substr('ACGT', CAST((l_linenumber + l_partkey) % 4 AS INT) + 1, 1) END AS ref,
               CASE WHEN l_partkey % 10 = 0 THEN substr('ACGT', CAST((l_linenumber + l_partkey) % 4 AS INT) + 1, 1)
                    WHEN l_partkey % 10 = 1 THEN substr('ACGT', CAST((l_linenumber + l_partkey) % 4 AS INT) + 1, 1) || 'GT'
                    WHEN l_partkey % 10 = 2 THEN substr('ACGT', CAST(((l_linenumber + l_partkey) % 4 + 1 + l_orderkey % 3) % 4 AS INT) + 1, 1) || 'C'
                    ELSE substr('ACGT', CAST(((l_linenumber + l_partkey) % 4 + 1 + l_orderkey % 3) % 4 AS INT) + 1, 1) END AS alt,
               CAST(max(l_quantity) AS INT) AS dp,
               CAST(max(l_quantity) * 4 AS DOUBLE) AS qual,
               min(CASE WHEN l_linenumber % 7 = 0 THEN '0/1' WHEN l_linenumber % 7 = 1 THEN '0|1'
                        WHEN l_linenumber % 7 = 2 THEN '0/0' ELSE '1/1' END) AS gt,
               min(CASE WHEN l_partkey % 5 = 0 THEN 'missense&splice_region|g1|t1|protein_coding|+|1A>1C|5A>C,@7'
                        WHEN l_partkey % 5 = 1 THEN '@12,synonymous|g2|t2|protein_coding|-'
                        WHEN l_partkey % 5 = 2 THEN 'non_coding|g3' ELSE '' END) AS csq
        FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "v_intervals": """
        SELECT DISTINCT 'chr' || CAST(l_suppkey % 4 AS STRING) AS contig,
               CAST(l_orderkey * 40 + l_linenumber * 5 AS BIGINT) AS start_,
               CAST(l_orderkey * 40 + l_linenumber * 5 + l_quantity * 3 AS BIGINT) AS end_
        FROM lineitem""",
    # chr9 has no data
    "v_contigs": """
        SELECT 'chr' || CAST(CASE WHEN r_regionkey = 4 THEN 9 ELSE r_regionkey END AS STRING) AS contig,
               CAST((SELECT max(o_orderkey) FROM orders) * 40 + 2000 AS BIGINT) AS length,
               CAST(r_regionkey AS INT) AS ord
        FROM region""",
    "v_alignments": """
        SELECT DISTINCT 'r' || CAST(l_orderkey AS STRING) AS qname,
               CASE l_linenumber WHEN 1 THEN 99 WHEN 2 THEN 147 WHEN 3 THEN 1123 WHEN 4 THEN 256
                                 WHEN 5 THEN 4 WHEN 6 THEN 2064 ELSE 16 END AS flag,
               'chr' || CAST(l_orderkey % 4 AS STRING) AS rname,
               CAST(l_orderkey * 40 + l_linenumber * 5 + 1 AS BIGINT) AS pos,
               CAST(l_quantity + 10 AS INT) AS mapq,
               CASE l_partkey % 5 WHEN 0 THEN '100M'
                    WHEN 1 THEN CAST(l_suppkey % 20 + 1 AS STRING) || 'S' || CAST(99 - l_suppkey % 20 AS STRING) || 'M'
                    WHEN 2 THEN '40M2D60M' WHEN 3 THEN '50M3I47M' ELSE '5H80M15S' END AS cigar,
               CAST(CASE WHEN l_partkey % 5 = 4 THEN 95 ELSE 100 END AS INT) AS seq_len,
               CAST(l_partkey % 4 AS INT) AS shift
        FROM lineitem""",
    "v_paf": """
        SELECT 'q' || CAST(o_orderkey AS STRING) AS qname,
               'chr' || CAST(o_custkey % 4 AS STRING) AS tname,
               CAST(o_orderkey * 40 AS BIGINT) AS tstart,
               CAST(o_orderkey * 40 + 200 + o_custkey % 300 AS BIGINT) AS tend,
               CAST(200 + o_custkey % 300 AS INT) AS qlen_aligned,
               CAST(o_orderkey % 61 AS INT) AS mapq,
               CAST(100 + o_custkey % 200 AS INT) AS s1,
               CAST(o_orderkey % 250 AS INT) AS s2,
               CAST(o_orderkey % 10 AS DOUBLE) / 100.0e0 AS de,
               CASE WHEN o_orderkey % 9 = 0 THEN 'S' ELSE 'P' END AS tp
        FROM orders""",
    "v_msa_sites": """
        SELECT CAST(l_suppkey AS STRING) AS sample, CAST(l_partkey AS BIGINT) AS site,
               CASE WHEN min(l_orderkey) % 8 = 0 THEN substr('TGCA-N', CAST(l_partkey % 6 AS INT) + 1, 1)
                    ELSE substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) END AS base
        FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "v_aligned": """
        SELECT CAST(l_suppkey AS STRING) AS sequence,
               CAST(CASE WHEN l_suppkey % 29 = 0 THEN 40 ELSE 90 END + count(*) % 8 AS DOUBLE) AS aligned
        FROM lineitem GROUP BY l_suppkey""",
    "v_tree_edges": """
        SELECT 'R' || CAST(r_regionkey AS STRING) AS node, 'root' AS parent, CAST(r_regionkey % 7 + 1 AS DOUBLE) AS len FROM region
        UNION ALL
        SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), CAST(n_nationkey % 7 + 1 AS DOUBLE) FROM nation
        UNION ALL
        SELECT 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING), CAST(s_suppkey % 7 + 1 AS DOUBLE) FROM supplier""",
    # every document is a contig; letters are read as bases
    "v_sequences": f"""
        SELECT CAST(doc_id AS STRING) AS contig,
               translate(lower(text), '{_LETTERS}', '{_BASES}') AS raw,
               regexp_replace(translate(lower(text), '{_LETTERS}', '{_BASES}'), '[^ACGT]', 'N'{{g}}) AS seq,
               length(regexp_replace(translate(lower(text), '{_LETTERS}', '{_BASES}'), '[^ACGT]', 'N'{{g}})) AS n,
               source AS sample, doc_id AS ord
        FROM documents""",
    # edits whose REF agrees with v_sequences
    "v_edits": """
        SELECT sample, contig, pos, min(ref) AS ref, kind, gt, step,
               min(id) * 16 + step * 4 + CASE kind WHEN 'del' THEN 0 WHEN 'mnp' THEN 1 WHEN 'ins' THEN 2 ELSE 3 END AS rec_no
        FROM (SELECT l.l_returnflag AS sample, s.contig,
                     CAST((l.l_partkey * 7 + l.l_linenumber * 31) % (s.n - 8) + 1 AS BIGINT) AS pos,
                     substr(s.seq, CAST((l.l_partkey * 7 + l.l_linenumber * 31) % (s.n - 8) + 1 AS INT),
                            CAST(CASE WHEN l.l_partkey % 5 = 0 THEN 4 WHEN l.l_partkey % 5 = 1 THEN 2 ELSE 1 END AS INT)) AS ref,
                     CASE WHEN l.l_partkey % 5 = 0 THEN 'del' WHEN l.l_partkey % 5 = 1 THEN 'mnp'
                          WHEN l.l_partkey % 5 = 2 THEN 'ins' ELSE 'snp' END AS kind,
                     CASE WHEN l.l_linenumber = 7 THEN '0/1' ELSE '1/1' END AS gt,
                     CAST(1 + l.l_suppkey % 3 AS INT) AS step,
                     l.l_orderkey * 8 + l.l_linenumber AS id
              FROM (SELECT *, l_orderkey % (SELECT count(*) FROM documents) AS doc FROM lineitem) l
              JOIN v_sequences s ON s.ord = l.doc
              WHERE s.n > 16) e
        GROUP BY sample, contig, pos, kind, gt, step""",
    "v_alleles": """
        SELECT sample, contig, pos, rec_no, ref, gt,
               CASE kind WHEN 'del' THEN substr(ref, 1, 1)
                         WHEN 'ins' THEN ref || 'ACG'
                         WHEN 'mnp' THEN CASE step WHEN 1 THEN translate(ref, 'ACGTN', 'CGTAA')
                                                   WHEN 2 THEN translate(ref, 'ACGTN', 'GTACC') ELSE translate(ref, 'ACGTN', 'TACGG') END
                         ELSE CASE step WHEN 1 THEN translate(ref, 'ACGTN', 'CGTAA')
                                        WHEN 2 THEN translate(ref, 'ACGTN', 'GTACC') ELSE translate(ref, 'ACGTN', 'TACGG') END END AS alt
        FROM v_edits""",
    "v_features": """
        SELECT 'chr' || CAST(p_partkey % 4 AS STRING) AS contig, 'f' || CAST(p_partkey AS STRING) AS feature_id,
               CAST(p_partkey * 290 + 1 AS BIGINT) AS gff_start, CAST(p_partkey * 290 + 1 + p_size * 12 AS BIGINT) AS gff_end
        FROM part""",
    "v_files": """
        SELECT '/data/' || source || '/d' || CAST(doc_id % 7 AS STRING) || '/s' || CAST(doc_id AS STRING)
               || CASE lang WHEN 'en' THEN '_R1.fastq.gz' WHEN 'fr' THEN '_1.fq' WHEN 'de' THEN '.fasta' ELSE '_S1_L001_R2_001.fastq.gz' END AS path,
               CASE lang WHEN 'en' THEN '@read1' WHEN 'fr' THEN '@runid=abc' WHEN 'de' THEN '>contig1' ELSE '@read2' END AS first_line
        FROM documents""",
}

_NEEDS = {"v_edits": ["v_sequences"], "v_alleles": ["v_sequences", "v_edits"]}


def _names(views: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in views:
        for item in [*_NEEDS.get(name, []), name]:
            if item not in out:
                out.append(item)
    return out


def sql_views(*views: str) -> str:
    """``WITH`` list for DuckDB."""
    return ", ".join(f"{n} AS ({VIEWS[n].replace('{g}', ', ' + chr(39) + 'g' + chr(39))})" for n in _names(views))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The view as a DataFrame over the Parquet files in ``folder``."""
    text = VIEWS[name].replace("{g}", "")
    needs = _NEEDS.get(name, [])
    if needs:
        text = "WITH " + ", ".join(f"{n} AS ({VIEWS[n].replace('{g}', '')})" for n in needs) + " " + text.strip()
    used = {}
    for name_ in TABLES:
        pattern = rf"\b(FROM|JOIN) {name_}\b"
        if re.search(pattern, text):
            used[name_] = table(spark, folder, name_)
            text = re.sub(pattern, rf"\1 {{{name_}}}", text)
    return spark.sql(text, **used)
