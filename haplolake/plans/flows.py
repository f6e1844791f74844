"""Whole analyses as chains of operators; every step works on all samples at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.operators import cohort as K
from haplolake.operators import sequences as Q
from haplolake.operators import stats as S
from haplolake.operators import variants as V
from haplolake.operators.alignments import filter_alignments
from haplolake.operators.assembly import missing_regions
from haplolake.operators.checks import split_failures
from haplolake.operators.depth import depth_blocks, depth_segments
from haplolake.session import stage


@dataclass
class SampleResult:
    """Tables of a sample run, keyed by sample."""

    variants: DataFrame
    passing: DataFrame
    consensus: DataFrame
    summary: DataFrame
    breakdown: DataFrame
    table: DataFrame
    qc: DataFrame


def _finish(
    v: DataFrame, samples: DataFrame, seqs: DataFrame, cds: DataFrame | None, low: DataFrame | None, user_mask: DataFrame | None, pipeline_type: str
) -> SampleResult:
    """``samples`` lists every sample of the run; one without a call keeps the reference's sequence and has its rows."""
    if cds is not None:
        v = Q.annotate_consequences(v, cds, seqs)
    v = stage(v)
    final = V.collapse_gt(v)
    passing = V.pass_only(v)
    # masks come after the consensus, so that REF still agrees while edits are applied
    out = Q.consensus(seqs, passing, samples)
    out = Q.mask_sequences(out, V.mixed_sites(v), "n")
    if low is not None:
        out = Q.mask_sequences(out, low, "N")
    if user_mask is not None:
        names = samples.agg(F.sort_array(F.collect_set("sample"))).scalar()
        out = Q.mask_sequences(out, user_mask.withColumn("sample", F.explode(names)), "X")
    out = stage(out)
    summary = S.vcf_summary(final)
    qc = S.sample_qc(samples.withColumn("pipeline_type", F.lit(pipeline_type)), vcf=summary, fasta=S.composition(out))
    return SampleResult(final, V.pass_only(final), out, summary, S.vcf_breakdown(final), V.variants_tab(final), qc)


def short_reads(
    calls: DataFrame,
    alignments: DataFrame,
    seqs: DataFrame,
    contigs: DataFrame,
    cds: DataFrame | None = None,
    min_depth: int = 0,
    user_mask: DataFrame | None = None,
    **context: int,
) -> SampleResult:
    """From calls and alignments (both with ``sample``) to annotated calls, masked consensus and QC.

    The samples are those of the alignments and of the calls together.
    """
    samples = stage(alignments.select("sample").union(calls.select("sample")).distinct())
    v = V.retype(V.split_multiallelic(V.has_alt_gt(calls)))
    v = V.short_read_filters(V.drop_unobserved(Q.normalize(v, seqs)))
    used = filter_alignments(alignments)
    names = samples.agg(F.sort_array(F.collect_set("sample"))).scalar()
    frame = contigs.withColumn("sample", F.explode(names))
    segments = stage(depth_segments(used, frame, keys=("sample",)))
    zero, low = depth_blocks(segments, min_depth, ("sample", "contig"))
    v = V.add_deletions(v, zero, seqs, contigs, merged=True)
    v = V.context_filter(v, **context)
    return _finish(v, samples, seqs, cds, low if min_depth > 0 else None, user_mask, "short")


def assembly(calls: DataFrame, blocks: DataFrame, seqs: DataFrame, contigs: DataFrame, cds: DataFrame | None = None, sample: str = "sample", **context: int) -> SampleResult:
    """The same from assembly calls and their alignment blocks; uncovered reference counts as deleted."""
    v = V.retype(V.split_multiallelic(V.has_alt_gt(calls)))
    v = V.assembly_filters(V.drop_unobserved(Q.normalize(v, seqs)))
    gaps = missing_regions(blocks, contigs).withColumn("sample", F.lit(sample))
    v = V.add_deletions(v, gaps, seqs, contigs, merged=True)
    samples = calls.select("sample").union(calls.sparkSession.createDataFrame([(sample,)], "sample string")).distinct()
    return _finish(V.context_filter(v, **context), samples, seqs, cds, None, None, "asm")


def long_reads(
    calls: DataFrame,
    alignments: DataFrame,
    seqs: DataFrame,
    contigs: DataFrame,
    cds: DataFrame | None = None,
    min_depth: int = 0,
    user_mask: DataFrame | None = None,
    **context: int,
) -> SampleResult:
    """The same as ``short_reads`` with the filters of long reads."""
    samples = stage(alignments.select("sample").union(calls.select("sample")).distinct())
    v = V.retype(V.split_multiallelic(V.has_alt_gt(calls)))
    v = V.long_read_filters(V.drop_unobserved(Q.normalize(v, seqs)))
    names = samples.agg(F.sort_array(F.collect_set("sample"))).scalar()
    segments = stage(depth_segments(filter_alignments(alignments), contigs.withColumn("sample", F.explode(names)), keys=("sample",)))
    zero, low = depth_blocks(segments, min_depth, ("sample", "contig"))
    v = V.context_filter(V.add_deletions(v, zero, seqs, contigs, merged=True), **context)
    return _finish(v, samples, seqs, cds, low if min_depth > 0 else None, user_mask, "long")


@dataclass
class CoreResult:
    """Tables of a core analysis; ``failed`` holds samples that don't fit the reference, with their errors."""

    failed: DataFrame
    alignment: DataFrame
    decisions: DataFrame
    core: DataFrame
    constant: DataFrame
    full_distances: DataFrame
    core_distances: DataFrame


def core(consensus: DataFrame, reference: DataFrame, threshold: float = 0.95, reference_id: str = "reference") -> CoreResult:
    """Join samples into one alignment, drop poorly aligned ones, and keep the soft core."""
    consensus, failed = split_failures(consensus, stage(K.check_msa(consensus, reference)))
    msa = K.build_msa(consensus, reference, reference_id, checked=True)
    decisions = stage(K.filter_samples(S.aligned_percent(msa), reference_id))
    kept = decisions.filter(~F.col("removed")).select(F.col("sequence").alias("sample"))
    cells = consensus.select("sample", "contig", "seq").unionByName(reference.select(F.lit(reference_id).alias("sample"), "contig", "seq"))
    sites = stage(K.msa_sites(cells.join(kept, "sample", "left_semi"), reference))
    chosen = K.soft_core(sites, threshold)
    return CoreResult(
        failed, msa, decisions, K.core_alignment(sites, chosen), K.constant_sites(sites), K.snp_distances(sites), K.snp_distances(sites.join(chosen.select("site"), "site", "left_semi"))
    )


@dataclass
class CohortResult:
    """Sample results of any kind taken together, and the core analysis over them."""

    breakdown: DataFrame
    qc: DataFrame
    failed: DataFrame
    core: CoreResult


def cohort(results: list[SampleResult], reference: DataFrame, threshold: float = 0.95, reference_id: str = "reference") -> CohortResult:
    """Combined breakdown and QC of several runs, the core of their consensus, and the samples that fell out.

    ``qc`` gets each sample's aligned share; samples that don't fit the reference
    or are removed as outliers are in ``failed`` with the reason.
    """
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    seqs = union([r.consensus.select("sample", "contig", "seq") for r in results])
    found = core(seqs, reference, threshold, reference_id)
    shares = found.decisions.select("sequence", "aligned")
    qc = S.add_core_alignment_qc(S.union_by_name([r.qc for r in results]), shares, reference_id)
    out = found.decisions.filter("removed").select(F.col("sequence").alias("sample"), F.concat(F.lit("removed: "), F.coalesce("filter_reason", F.lit(""))).alias("error"))
    return CohortResult(union([r.breakdown for r in results]), qc, found.failed.select("sample", "error").unionByName(out), found)
