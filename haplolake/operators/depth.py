"""Depth, coverage, copy number and pileups."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haplolake.functions import alleles as A
from haplolake.functions import cigar as C
from haplolake.functions import fields as X
from haplolake.functions.numbers import fisher_two_sided, half_up, phred, quality_sum
from haplolake.operators.alignments import EXCLUDE_DEFAULT, REVERSE, as_intervals, filter_alignments, has
from haplolake.operators.intervals import merge_intervals, overlap_join, sweep

# Bins near the length of what meets: aligned stretches of reads, and features.
READ_BIN, FEATURE_BIN = 256, 2048


def aligned_blocks(a: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reference stretches covered by aligned bases (M, =, X)."""
    spans = F.transform(
        F.filter(C.placed(F.col("cigar"), F.col("pos") - 1), lambda p: p["op"].isin(*C.ALIGNED_OPS)),
        lambda p: F.struct(p["ref"].cast("long").alias("start"), (p["ref"] + p["len"]).cast("long").alias("end")),
    )
    return as_intervals(a).select(*keys, "contig", F.explode(spans).alias("b")).select(*keys, "contig", "b.*")


def depth_segments(
    a: DataFrame,
    contigs: DataFrame,
    exclude_flags: int = EXCLUDE_DEFAULT,
    min_mapq: int = 0,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Run-length depth over whole contigs, zeros included."""
    used = filter_alignments(a, min_mapq, exclude_flags)
    by = [*keys, "contig"]
    return sweep(aligned_blocks(used, keys), by, frame=contigs.select(*by, "length"))


def segments_from_depth(depth: DataFrame) -> DataFrame:
    """Per-base (contig, pos, depth) rows as one-base segments."""
    return depth.select("contig", (F.col("pos") - 1).cast("long").alias("start"), F.col("pos").cast("long").alias("end"), F.col("depth").cast("long").alias("depth"))


def depth_blocks(segments: DataFrame, min_depth: int, by: tuple[str, ...] = ("contig",)) -> tuple[DataFrame, DataFrame]:
    """Merged (zero-depth, low-depth) intervals."""
    zero = merge_intervals(segments.filter(F.col("depth") == 0), list(by))
    low = merge_intervals(segments.filter((F.col("depth") > 0) & (F.col("depth") < min_depth)), list(by))
    return zero, low


def contig_coverage(
    a: DataFrame, contigs: DataFrame, exclude_flags: int = EXCLUDE_DEFAULT, min_mapq: int = 0, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Reads, covered bases, breadth, mean depth, mean base quality and mean mapping quality per contig.

    ``meanbaseq`` is over aligned bases of reads with qualities, summed per read; 0 without any.
    """
    by = [*keys, "contig"]
    size = F.col("end") - F.col("start")
    bases = (
        depth_segments(a, contigs, exclude_flags, min_mapq, keys)
        .groupBy(*by)
        .agg(
            F.sum(F.when(F.col("depth") > 0, size).otherwise(0)).alias("covbases"),
            F.sum(size * F.col("depth")).alias("_bases"),
        )
    )
    qual = C.aligned_text(F.col("cigar"), F.col("qual")) if "qual" in a.columns else F.lit(None).cast("string")
    reads = (
        as_intervals(filter_alignments(a, min_mapq, exclude_flags))
        .withColumn("_qual", qual)
        .groupBy(*by)
        .agg(
            F.count("*").alias("numreads"),
            F.avg("mapq").alias("meanmapq"),
            (F.sum(quality_sum(F.col("_qual"))) / F.nullif(F.sum(F.length("_qual").cast("long")), F.lit(0))).alias("meanbaseq"),
        )
    )
    return (
        contigs.select(*by, "length")
        .join(bases, by, "left")
        .join(reads, by, "left")
        .select(
            *by,
            "length",
            F.coalesce("numreads", F.lit(0)).alias("numreads"),
            F.coalesce("covbases", F.lit(0)).alias("covbases"),
            (F.coalesce("covbases", F.lit(0)) * 100.0 / F.col("length")).alias("coverage"),
            (F.coalesce("_bases", F.lit(0)) / F.col("length")).alias("meandepth"),
            F.coalesce("meanbaseq", F.lit(0.0)).alias("meanbaseq"),
            F.coalesce("meanmapq", F.lit(0.0)).alias("meanmapq"),
        )
    )


def genome_coverage(coverage: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Length-weighted mean depth and breadth over contigs."""
    total = F.nullif(F.sum("length"), F.lit(0))
    return coverage.groupBy(*keys).agg(
        (F.sum(F.col("meandepth") * F.col("length")) / total).alias("mean_depth"),
        (F.sum(F.col("coverage") * F.col("length")) / total).alias("mean_breadth"),
        F.count("*").alias("contigs"),
    )


# --- copy number ---------------------------------------------------------------------


def _above_zero(base: Column) -> Column:
    return F.when(base > 0, base).otherwise(F.raise_error(F.lit("baseline depth must be above zero")).cast("double"))


def contig_cnv(coverage: DataFrame, baseline: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Copy number of each contig against ``baseline`` or the longest contig (first on ties) of the same ``keys``."""
    if baseline is not None:
        known, base = coverage, F.lit(float(baseline))
    else:
        rank = F.struct(F.col("length").cast("long"), (-F.col("ord")).cast("long"))
        longest = coverage.groupBy(*keys).agg(F.max_by("meandepth", rank).alias("_base"))
        known = coverage.join(longest, list(keys)) if keys else coverage.withColumn("_base", longest.scalar())
        base = F.col("_base")
    depth = F.col("meandepth")
    return known.select(*keys, "contig", depth.alias("read_depth"), half_up(depth / _above_zero(base)).alias("copy_number"))


def feature_depth(
    features: DataFrame, segments: DataFrame, keep: tuple[str, ...] = ("feature_id",), keys: tuple[str, ...] = ()
) -> DataFrame:
    """Median per-base depth of each feature (start, end 0-based); uncovered bases count as 0.

    Overlaps are summed per depth value first, then the median is a weighted one.
    With ``keys`` (of the segments) each feature has a row per key that has
    segments on its contig; whole-contig segments always do.
    """
    key = [*keys, *keep, "contig", "start", "end"]
    if keys:
        features = features.join(segments.select(*keys, "contig").distinct(), "contig")
    width = F.least("end", "end_b") - F.greatest("start", "start_b")
    cut = (
        overlap_join(features.select(*key), segments.filter(F.col("depth") > 0), [*keys, "contig"], bin_size=FEATURE_BIN)
        .groupBy(*key, "depth")
        .agg(F.sum(width).alias("bases"))
    )
    seen = cut.groupBy(*key).agg(F.sum("bases").alias("_seen"))
    bare = features.select(*key).join(seen, key, "left").select(
        *key, F.lit(0).cast("long").alias("depth"), (F.col("end") - F.col("start") - F.coalesce("_seen", F.lit(0))).cast("long").alias("bases")
    )
    every = cut.unionByName(bare).filter(F.col("bases") > 0)
    return every.groupBy(*key).agg(F.percentile("depth", F.lit(0.5), F.col("bases")).alias("read_depth"))


def feature_cnv(
    features: DataFrame,
    segments: DataFrame,
    baseline: float | Column | DataFrame,
    keep: tuple[str, ...] = ("feature_id",),
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Copy number of each feature; ``baseline`` is a number, a column, or a table (keys, baseline). One of 0 or less is an error."""
    found = feature_depth(features, segments, keep, keys)
    if isinstance(baseline, DataFrame):
        found = found.join(baseline.select(*keys, F.col("baseline").alias("_base")), list(keys))
        return found.withColumn("copy_number", half_up(F.col("read_depth") / _above_zero(F.col("_base")))).drop("_base")
    base = F.lit(float(baseline)) if not isinstance(baseline, Column) else baseline
    return found.withColumn("copy_number", half_up(F.col("read_depth") / _above_zero(base)))


def baseline_from_region(
    segments: DataFrame, contigs: DataFrame, region: tuple[str | None, int, int], keys: tuple[str, ...] = ()
) -> DataFrame:
    """One row per key: median depth of a 1-based closed region, on the longest contig unless named; 0 is an error."""
    contig, start, end = region
    place = contigs.filter(F.col("contig") == contig) if contig else contigs.orderBy(F.desc("length"), "ord").limit(1)
    spot = place.select(F.lit("region").alias("feature_id"), "contig", F.lit(start - 1).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))
    return feature_depth(spot, segments, keys=keys).select(*keys, _above_zero(F.col("read_depth")).alias("baseline"))


def find_feature(features: DataFrame, name: str) -> DataFrame:
    """The feature with this id or attribute value; none or several is an error."""
    hit = (F.col("feature_id") == name) | F.exists(F.map_values("attributes"), lambda v: v == name)
    found = features.filter(hit)
    several = found.limit(2).agg(F.count("*").alias("n")).scalar()
    checked = F.when(several == 1, F.col("feature_id")).otherwise(F.raise_error(F.lit(f"feature {name!r} matches several features")).cast("string"))
    if found.isEmpty():
        raise ValueError(f"feature {name!r} not found")
    return found.withColumn("feature_id", checked)


def baseline_from_feature(segments: DataFrame, features: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: median depth of a named feature; 0 is an error."""
    return feature_depth(find_feature(features, name), segments, keys=keys).select(*keys, _above_zero(F.col("read_depth")).alias("baseline"))


# --- pileup and strand bias ------------------------------------------------------------


def pileup(
    a: DataFrame,
    positions: DataFrame,
    exclude_flags: int = EXCLUDE_DEFAULT,
    min_mapq: int = 0,
    min_baseq: int = 0,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Observations at the given (contig, pos): base, strand, and the indel that follows.

    ``keys`` are columns of the reads that stay on the observations; where the
    positions have them too, a position is asked of these reads alone.

    ``base`` is ``*`` inside a deletion; ``ins`` is the inserted text and
    ``del_len`` the deleted length right after the position. No overlap or BAQ
    adjustment is made.
    """
    own = [k for k in keys if k in positions.columns]
    spots = positions.select(*own, "contig", "pos").distinct().select(
        *own, "contig", F.col("pos").cast("long").alias("pos"), (F.col("pos") - 1).cast("long").alias("start"), F.col("pos").cast("long").alias("end")
    )
    # one row per aligned or deleted stretch of a read, with the text of that stretch and of the indel behind it
    reads = as_intervals(filter_alignments(a, min_mapq, exclude_flags)).withColumn("_ops", C.placed(F.col("cigar"), F.col("start")))
    stretch = F.transform("_ops", lambda p, i: F.struct(p.alias("here"), F.get("_ops", i + 1).alias("next")))
    wanted = F.filter(stretch, lambda s: s["here"]["op"].isin(*C.ALIGNED_OPS, "D"))
    rows = reads.select(*keys, "contig", "seq", *(["qual"] if "qual" in a.columns else []), "mapq", has(REVERSE).alias("_rev"), F.explode(wanted).alias("s"))
    here, after = F.col("s.here"), F.col("s.next")
    solid = here["op"] != "D"

    def text(name: str) -> Column:
        return F.when(solid, F.substr(name, here["query"] + 1, here["len"]))

    rows = rows.select(
        *keys,
        "contig",
        "mapq",
        F.when(F.col("_rev"), "-").otherwise("+").alias("strand"),
        here["ref"].cast("long").alias("start"),
        (here["ref"] + here["len"]).cast("long").alias("end"),
        text("seq").alias("_text"),
        (text("qual") if "qual" in a.columns else F.lit(None).cast("string")).alias("_qual"),
        F.when(solid & (after["op"] == "I"), F.substr("seq", after["query"] + 1, after["len"])).alias("_ins"),
        F.when(solid & (after["op"] == "D"), after["len"]).alias("_del"),
    )
    pairs = overlap_join(rows, spots, [*own, "contig"], bin_size=READ_BIN)
    at = (F.col("start_b") - F.col("start") + 1).cast("int")
    last = F.col("end_b") == F.col("end")
    out = pairs.select(
        *keys,
        "contig",
        "pos",
        F.coalesce(F.substr("_text", at, F.lit(1)), F.lit("*")).alias("base"),
        "strand",
        F.when(last, F.col("_ins")).alias("ins"),
        F.when(last, F.col("_del")).alias("del_len"),
        (F.ascii(F.substr("_qual", at, F.lit(1))) - 33).alias("baseq"),
        "mapq",
    )
    return out.filter(F.col("baseq").isNull() | (F.col("baseq") >= min_baseq)) if min_baseq else out


_TOKEN = re.compile(r"\^.|\$|(?P<base>[*#<>]|[.,ACGTNacgtn])(?:(?P<sign>[+-])(?P<size>\d+))?", re.S)


_OBSERVATION = (
    T.StructType().add("base", T.StringType()).add("strand", T.StringType()).add("ins", T.StringType()).add("del_len", T.IntegerType())
)


@F.pandas_udf(T.ArrayType(_OBSERVATION))
def decode_bases(texts: pd.Series) -> pd.Series:
    """Observations written in a samtools pileup base string."""

    def one(text: str) -> list[dict]:
        found, i = [], 0
        while i < len(text):
            token = _TOKEN.match(text, i)
            if token is None:
                i += 1
                continue
            i = token.end()
            base = token["base"]
            if base is None:
                continue
            if base in "*#<>":
                i = token.end("base")
                found.append({"base": base, "strand": None, "ins": None, "del_len": None})
                continue
            indel = None
            if token["sign"]:
                size = int(token["size"])
                indel = text[i : i + size].upper()
                if len(indel) != size:
                    raise ValueError(f"truncated indel in pileup bases {text!r}")
                i += size
            found.append(
                {
                    "base": base.upper(),
                    "strand": "+" if base in ".ACGTN" else "-",
                    "ins": indel if token["sign"] == "+" else None,
                    "del_len": len(indel) if token["sign"] == "-" else None,
                }
            )
        return found

    return texts.fillna("").map(one)


def pileup_from_text(p: DataFrame) -> DataFrame:
    """Observation rows from (contig, pos, bases) pileup text."""
    return p.select("contig", "pos", F.explode(decode_bases("bases")).alias("o")).select("contig", "pos", "o.*")


def strand_counts(v: DataFrame, observations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reference and alternate support by strand for single-ALT SNPs and anchored indels.

    With ``keys`` (say, the sample) a record meets observations of its own key only.

    Observations are counted per (position, base, strand, indel) before they meet
    the variants, so deep positions travel as a handful of rows.
    """
    seen = (
        observations.filter(F.col("strand").isNotNull())
        .groupBy(*keys, F.col("contig").alias("chrom"), F.col("pos").cast("long").alias("pos"), "base", "strand", "ins", "del_len")
        .agg(F.count("*").alias("_n"))
    )
    alt = F.get("alts", F.lit(0))
    snp = A.is_snp(F.col("ref"), F.col("alts"))
    single = v.filter((F.size("alts") == 1) & (snp | A.is_anchored_indel(F.col("ref"), alt)))
    sites = single.select(*keys, "chrom", F.col("pos").cast("long").alias("pos"), "ref", alt.alias("alt")).distinct()
    one_base = F.length("ref") == F.length("alt")
    grown = F.substr("alt", F.length("ref") + 1, F.length("alt"))
    target = F.when(F.length("alt") > F.length("ref"), F.col("ins") == grown).otherwise(
        F.col("del_len") == F.length("ref") - F.length("alt")
    )
    is_alt = F.coalesce(F.when(one_base, F.upper("base") == F.upper("alt")).otherwise(target), F.lit(False))
    is_ref = F.coalesce(F.col("base").isin(".", ",") | (F.upper("base") == F.upper(F.substring("ref", 1, 1))), F.lit(False))
    is_ref = is_ref & F.when(one_base, F.lit(True)).otherwise(~is_alt)

    def total(cond: Column, strand: str) -> Column:
        return F.coalesce(F.sum(F.when(cond & (F.col("strand") == strand), F.col("_n"))), F.lit(0)).cast("long")

    return (
        sites.join(seen, [*keys, "chrom", "pos"], "left")
        .groupBy(*keys, "chrom", "pos", "ref", "alt")
        .agg(
            total(is_ref, "+").alias("ref_fwd"),
            total(is_ref, "-").alias("ref_rev"),
            total(is_alt, "+").alias("alt_fwd"),
            total(is_alt, "-").alias("alt_rev"),
        )
    )


def with_strand_test(counts: DataFrame) -> DataFrame:
    """p-value, phred score and forward share of the alternate reads."""
    p = fisher_two_sided("ref_fwd", "ref_rev", "alt_fwd", "alt_rev")
    both = F.col("alt_fwd") + F.col("alt_rev")
    return (
        counts.withColumn("pvalue", p)
        .withColumn("phred", F.when(F.format_string("%.5e", F.col("pvalue")) == "1.00000e+00", 0.0).otherwise(phred(F.col("pvalue"))))
        .withColumn("alt_fwd_frac", F.col("alt_fwd") / F.nullif(both, F.lit(0)))
    )


def strand_bias(
    v: DataFrame, observations: DataFrame, filter_pvalue: float | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Annotate records with strand support; optionally label p-values below the threshold StrandBias."""
    tests = with_strand_test(strand_counts(v, observations, keys))
    keyed = v.withColumn("_alt", F.when(F.size("alts") == 1, F.get("alts", F.lit(0))))
    joined = keyed.join(tests.withColumnRenamed("alt", "_alt"), [*keys, "chrom", "pos", "ref", "_alt"], "left")
    tested = F.col("pvalue").isNotNull()
    share = F.coalesce(F.col("alt_fwd_frac").cast("string"), F.lit("."))
    notes = {
        "SB_REF_FWD": F.col("ref_fwd"),
        "SB_REF_REV": F.col("ref_rev"),
        "SB_ALT_FWD": F.col("alt_fwd"),
        "SB_ALT_REV": F.col("alt_rev"),
        "SB_ALT_FWD_FRAC": F.when(tested, share),
        "SB_PVALUE": F.col("pvalue"),
        "SB_PHRED": F.col("phred"),
        "SB_METHOD": F.when(tested, F.lit("FisherExact")),
    }
    out = joined.withColumn("info", X.put_all(F.col("info"), notes)).withColumn(
        "fmt", F.when(tested, X.put(F.col("fmt"), "SB", share)).otherwise(F.col("fmt"))
    )
    if filter_pvalue is not None:
        label = X.compact(F.when(F.col("pvalue") < filter_pvalue, F.lit("StrandBias")))
        out = out.withColumn("filters", X.add_labels(F.col("filters"), label))
    return out.select(*v.columns)


def call_snps(
    observations: DataFrame,
    reference_bases: DataFrame,
    min_mapq: int = 30,
    min_baseq: int = 13,
    min_alt_count: int = 2,
    min_alt_fraction: float = 0.05,
    hom_fraction: float = 0.9,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Threshold SNP calls: allele counts per position (and ``keys``), genotype by allele share.

    ``reference_bases`` holds (contig, pos, ref). This is no Bayesian caller and
    gives no QUAL.
    """
    good = observations.filter(
        (F.col("mapq") >= min_mapq) & (F.col("baseq").isNull() | (F.col("baseq") >= min_baseq)) & (F.col("base") != "*")
    )
    counts = good.groupBy(*keys, "contig", "pos", "base").agg(F.count("*").alias("ao"))
    depth = counts.groupBy(*keys, "contig", "pos").agg(F.sum("ao").alias("dp"))
    share = F.col("ao") / F.col("dp")
    return (
        counts.join(depth, [*keys, "contig", "pos"])
        .join(reference_bases.select("contig", "pos", "ref"), ["contig", "pos"])
        .filter((F.col("base") != F.col("ref")) & (F.col("ao") >= min_alt_count) & (share >= min_alt_fraction))
        .select(
            *keys, "contig", "pos", "ref", F.col("base").alias("alt"), "dp", "ao", F.when(share >= hom_fraction, "1/1").otherwise("0/1").alias("gt")
        )
    )
