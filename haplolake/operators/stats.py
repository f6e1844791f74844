"""Per-sample summaries of call sets, sequences and QC tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.functions import alleles as A
from haplolake.functions import fields as X

# Metrics of a sample in report order.
QC_COLUMNS = (
    "sample", "pipeline_type", "read_files", "read_num_seqs", "read_sum_len", "read_min_len", "read_avg_len", "read_max_len",
    "alignment_total", "alignment_primary", "alignment_secondary", "alignment_supplementary", "alignment_duplicates",
    "alignment_mapped", "alignment_mapped_percent", "alignment_properly_paired", "alignment_properly_paired_percent",
    "alignment_reads_mapped", "alignment_reads_unmapped", "alignment_bases_mapped", "alignment_error_rate",
    "alignment_average_length", "alignment_average_quality", "alignment_insert_size_average", "alignment_mean_depth",
    "alignment_mean_breadth", "alignment_contigs", "vcf_total", "vcf_pass", "vcf_filtered", "vcf_lowqual", "vcf_lowdepth",
    "vcf_snp", "vcf_mnp", "vcf_indel", "vcf_complex", "vcf_symbolic", "vcf_contigs_with_variants", "vcf_bcsq_annotated",
    "vcf_transitions", "vcf_transversions", "vcf_ts_tv_ratio", "vcf_qual_mean", "vcf_depth_mean", "vcf_depth_min",
    "vcf_depth_max", "vcf_allele_fraction_mean", "final_length", "final_acgt", "final_A", "final_C", "final_G", "final_T",
    "final_N", "final_n", "final_gap", "final_other", "final_acgt_fraction", "final_N_fraction", "final_n_fraction",
    "final_gap_fraction", "core_aligned_percent",
)


def _types() -> Column:
    """TYPE list of the record, inferred per ALT when INFO has none."""
    given = F.filter(F.split(F.coalesce(F.try_element_at("info", F.lit("TYPE")), F.lit("")), ","), lambda t: t != "")
    alts = F.filter("alts", lambda a: a != "")
    return F.when(F.size(given) > 0, given).otherwise(F.transform(alts, lambda a: A.infer_type(F.col("ref"), a)))


def _labels() -> Column:
    return F.when(X.is_exact_pass(F.col("filters")), F.array(F.lit("PASS"))).otherwise(F.col("filters"))


def _substitution() -> Column:
    alt = F.get("alts", F.lit(0))
    return F.when(F.size("alts") == 1, A.substitution_class(F.col("ref"), alt))


def vcf_summary(v: DataFrame, by: str = "sample") -> DataFrame:
    """One row of counts and means per sample; a record passes if FILTER is ``.`` or PASS alone."""
    depth = X.depth_of(F.col("fmt"), F.col("info"))
    rows = v.select(
        by, "chrom", "qual", _labels().alias("_f"), _types().alias("_t"), _substitution().alias("_s"), depth.alias("_d"),
        X.allele_fraction(F.col("fmt"), F.col("info"), depth).alias("_af"), F.map_contains_key("info", "BCSQ").alias("_b"),
    )

    def count(cond: Column) -> Column:
        return F.sum(F.coalesce(cond.cast("long"), F.lit(0).cast("long")))

    def listed(array: str, value: str) -> Column:
        return F.sum(F.size(F.filter(array, lambda x: x == value)).cast("long"))

    passed = F.array_contains("_f", "PASS") & (F.size("_f") == 1)
    ts, tv = count(F.col("_s") == "transition"), count(F.col("_s") == "transversion")
    return rows.groupBy(by).agg(
        F.count("*").alias("total"),
        count(passed).alias("pass"),
        count(~passed).alias("filtered"),
        listed("_f", "LowQual").alias("lowqual"),
        listed("_f", "LowDepth").alias("lowdepth"),
        *[listed("_t", t).alias(t.lower()) for t in ("SNP", "MNP", "INDEL", "COMPLEX", "SYMBOLIC")],
        F.countDistinct("chrom").alias("contigs_with_variants"),
        count(F.col("_b")).alias("bcsq_annotated"),
        ts.alias("transitions"),
        tv.alias("transversions"),
        (ts.cast("double") / F.nullif(tv, F.lit(0))).alias("ts_tv_ratio"),
        F.avg("qual").alias("qual_mean"),
        F.avg("_d").alias("depth_mean"),
        F.min("_d").alias("depth_min"),
        F.max("_d").alias("depth_max"),
        F.avg("_af").alias("allele_fraction_mean"),
    )


def vcf_breakdown(v: DataFrame, by: str = "sample") -> DataFrame:
    """Long table (sample, section, label, count) in one pass over the records."""
    annotations = F.filter(F.split(F.coalesce(F.try_element_at("info", F.lit("BCSQ")), F.lit("")), ","), lambda a: ~a.startswith("@"))
    terms = F.flatten(F.transform(annotations, lambda a: F.split(F.substring_index(a, "|", 1), "&")))
    change = F.concat("ref", F.lit(">"), F.get("alts", F.lit(0)))

    def section(name: str, labels: Column) -> Column:
        return F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.struct(F.lit(name).alias("section"), x.alias("label")))

    every = F.concat(
        section("filter", _labels()),
        section("type", _types()),
        section("substitution", X.compact(F.when(_substitution().isNotNull(), change))),
        section("consequence", terms),
    )
    return (
        v.select(by, F.explode(every).alias("e"))
        .groupBy(by, F.col("e.section").alias("section"), F.col("e.label").alias("label"))
        .agg(F.count("*").alias("count"))
    )


def type_counts(v: DataFrame, by: str = "sample") -> DataFrame:
    """Records per INFO TYPE, MISSING where there is none."""
    types = F.split(F.coalesce(F.try_element_at("info", F.lit("TYPE")), F.lit("MISSING")), ",")
    return v.select(by, F.explode(types).alias("type")).groupBy(by, "type").agg(F.count("*").alias("count"))


def histogram_columns(contigs: DataFrame, total: int, minimum: int = 1) -> DataFrame:
    """Columns per contig (``w``) by largest remainder, and the offset of the first one.

    One row per contig of the header goes through the ranking, never data rows.
    """
    if total <= 0 or minimum < 0:
        raise ValueError("total must be positive and minimum not negative")
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy("ord")
    sized = contigs.select("contig", F.col("length").cast("long").alias("length"), "ord").withColumn("_n", F.count("*").over(everything))
    least = F.when(F.col("_n") * minimum > total, 0).otherwise(minimum)
    sized = (
        sized.withColumn("_min", least)
        .withColumn("_rest", F.lit(total) - F.col("_min") * F.col("_n"))
        .withColumn("_genome", F.sum("length").over(everything))
        .withColumn("_base", F.floor(F.col("length") * F.col("_rest") / F.col("_genome")).cast("long"))
        .withColumn("_base", F.expr("(length * _rest) div _genome"))
        .withColumn("_frac", F.col("length") * F.col("_rest") % F.col("_genome"))
        .withColumn("_rank", F.row_number().over(everything.orderBy(F.desc("_frac"), "ord")))
        .withColumn("_spare", F.col("_rest") - F.sum("_base").over(everything))
    )
    w = F.col("_min") + F.col("_base") + (F.col("_rank") <= F.col("_spare")).cast("long")
    return sized.withColumn("w", w.cast("long")).select(
        "contig", "length", "ord", "w", (F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("offset")
    )


def genome_histogram(
    v: DataFrame, contigs: DataFrame, total: int, minimum: int = 1, pass_only: bool = True, by: str = "sample"
) -> DataFrame:
    """SNP counts per genome column and sample, empty columns included."""
    layout = histogram_columns(contigs, total, minimum).filter(F.col("w") > 0)
    kept = v.filter(F.array_contains(_types(), "SNP"))
    if pass_only:
        kept = kept.filter((F.size("filters") == 1) & F.array_contains("filters", "PASS"))
    places = layout.select(F.col("contig").alias("chrom"), "length", "w", "offset")
    index = F.least(F.expr("((pos - 1) * w) div length"), F.col("w") - 1)
    counts = (
        kept.join(places, "chrom")
        .filter((F.col("pos") >= 1) & (F.col("pos") <= F.col("length")))
        .groupBy(by, (F.col("offset") + index).alias("column"))
        .agg(F.count("*").alias("n"))
    )
    columns = layout.select("contig", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("idx")).select(
        "contig", "idx", (F.col("offset") + F.col("idx")).alias("column")
    )
    grid = v.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))).alias("column"))
    return (
        grid.join(columns, "column")
        .join(counts, [by, "column"], "left")
        .select(by, "contig", "idx", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    )


# --- sequences -------------------------------------------------------------------------


def _occurrences(letter: str) -> Column:
    return F.sum((F.length("seq") - F.length(F.replace(F.col("seq"), F.lit(letter)))).cast("long"))


def composition(seqs: DataFrame, by: str = "sample") -> DataFrame:
    """Symbol counts and fractions; ACGT fold case, N and n are told apart."""
    counted = seqs.groupBy(by).agg(
        F.sum(F.length("seq").cast("long")).alias("final_length"),
        *[(_occurrences(b) + _occurrences(b.lower())).alias(f"final_{b}") for b in "ACGT"],
        _occurrences("N").alias("_upper_n"),
        _occurrences("n").alias("_lower_n"),
        _occurrences("-").alias("final_gap"),
    )
    acgt = F.col("final_A") + F.col("final_C") + F.col("final_G") + F.col("final_T")
    size = F.greatest("final_length", F.lit(1))
    return counted.select(
        by,
        "final_length",
        acgt.alias("final_acgt"),
        "final_A",
        "final_C",
        "final_G",
        "final_T",
        F.col("_upper_n").alias("final_upper_n"),
        F.col("_lower_n").alias("final_lower_n"),
        "final_gap",
        (F.col("final_length") - acgt - F.col("_upper_n") - F.col("_lower_n") - F.col("final_gap")).alias("final_other"),
        (acgt / size).alias("final_acgt_fraction"),
        (F.col("_upper_n") / size).alias("final_upper_n_fraction"),
        (F.col("_lower_n") / size).alias("final_lower_n_fraction"),
        (F.col("final_gap") / size).alias("final_gap_fraction"),
    )


# Columns of ``composition`` whose report names differ only by case.
REPORT_NAMES = {
    "final_upper_n": "final_N",
    "final_lower_n": "final_n",
    "final_upper_n_fraction": "final_N_fraction",
    "final_lower_n_fraction": "final_n_fraction",
}


def aligned_percent(msa: DataFrame, by: str = "sample") -> DataFrame:
    """Share of A, C, G, T (case folded) in each sequence, in percent."""
    known = F.length(F.regexp_replace(F.upper("seq"), "[^ACGT]", ""))
    return msa.select(F.col(by).alias("sequence"), F.coalesce(known * 100.0 / F.nullif(F.length("seq"), F.lit(0)), F.lit(0.0)).alias("aligned"))


def reference_summary(seqs: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """num_sequences, total_length and num_features in one row."""
    parts = seqs.select(F.lit(1).cast("long").alias("s"), F.length("seq").cast("long").alias("l"), F.lit(0).cast("long").alias("f"))
    if features is not None:
        zero = F.lit(0).cast("long")
        parts = parts.union(features.select(zero.alias("s"), zero.alias("l"), F.lit(1).cast("long").alias("f")))
    return parts.agg(F.sum("s").alias("num_sequences"), F.sum("l").alias("total_length"), F.sum("f").alias("num_features"))


# --- QC tables -------------------------------------------------------------------------


def sample_qc(
    samples: DataFrame,
    reads: DataFrame | None = None,
    alignments: DataFrame | None = None,
    vcf: DataFrame | None = None,
    fasta: DataFrame | None = None,
    core: DataFrame | None = None,
) -> DataFrame:
    """Join per-sample tables into the metrics of ``QC_COLUMNS`` that are present.

    ``samples`` holds (sample, pipeline_type); vcf columns get the ``vcf_`` prefix.
    """
    out = samples.select("sample", "pipeline_type")
    if vcf is not None:
        vcf = vcf.select("sample", *[F.col(c).alias(f"vcf_{c}") for c in vcf.columns if c != "sample"])
    for part in (reads, alignments, vcf, fasta, core):
        if part is not None:
            out = out.join(part, "sample", "left")
    back = {v: k for k, v in REPORT_NAMES.items()}
    wanted = [back.get(c, c) for c in QC_COLUMNS]
    return out.select(*[c for c in wanted if c in out.columns])


def add_core_alignment_qc(qc: DataFrame, aligned: DataFrame, reference: str = "reference") -> DataFrame:
    """Fill core_aligned_percent by sample; rows without a match keep what they have."""
    core = aligned.filter(F.col("sequence") != reference).select(F.col("sequence").alias("sample"), F.col("aligned").alias("_core"))
    old = F.col("core_aligned_percent") if "core_aligned_percent" in qc.columns else F.lit(None).cast("double")
    return qc.join(core, "sample", "left").withColumn("core_aligned_percent", F.coalesce(F.col("_core"), old)).drop("_core")


def union_strict(parts: list[DataFrame]) -> DataFrame:
    """Union of tables with one header; a different header is an error."""
    for part in parts[1:]:
        if part.columns != parts[0].columns:
            raise ValueError(f"header {part.columns} differs from {parts[0].columns}")
    return reduce(DataFrame.union, parts)


def union_by_name(parts: list[DataFrame], order: tuple[str, ...] = tuple(QC_COLUMNS)) -> DataFrame:
    """Union by name; known columns in ``order``, further ones sorted behind them."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    known = [c for c in order if c in merged.columns]
    return merged.select(*known, *sorted(set(merged.columns) - set(known)))


def inner_join_tables(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join; columns of ``right`` already in ``left`` are left out."""
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(on, *extra), on)


def merge_read_stats(stats: DataFrame, by: str = "sample") -> DataFrame:
    """Combine per-file read statistics into one row per sample."""
    weighted = F.sum(F.coalesce(F.col("avg_len"), F.lit(0.0)) * F.coalesce(F.col("num_seqs"), F.lit(0)))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "file"))), lambda f: f["file"]), ",")
    return stats.groupBy(by).agg(
        names.alias("read_files"),
        F.sum("num_seqs").alias("read_num_seqs"),
        F.sum("sum_len").alias("read_sum_len"),
        F.min("min_len").alias("read_min_len"),
        (weighted / F.nullif(F.sum("num_seqs"), F.lit(0))).alias("read_avg_len"),
        F.max("max_len").alias("read_max_len"),
    )
