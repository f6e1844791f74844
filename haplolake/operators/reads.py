"""Reads: statistics, cleaning, de-duplication, sampling.

Columns: file, read_id, mate, seq, qual (phred+33).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.operators.scan import Run, running

# Cleaning presets (min_length, max unqualified percent, max N, dedup).
CLEAN_PRESETS = {"default": (15, 20, 5, False), "aggressive": (30, 10, 2, True), "conservative": (10, 30, 10, False)}
UNQUALIFIED_BELOW = 15

_BUCKET_BITS = 16
_HASH_BITS = 60


def _quality_at_least(minimum: int) -> Column:
    """How many bases have this quality or more."""
    lowest, highest = 33, 33 + minimum - 1  # codes of the qualities below
    return F.length(F.regexp_replace("qual", f"[\\x{lowest:02x}-\\x{highest:02x}]", "")).cast("long")


def read_stats(reads: DataFrame, by: str = "file", all_stats: bool = False, n_stats: tuple[int, ...] = (), gaps: str = "-. ") -> DataFrame:
    """num_seqs, sum_len, min/avg/max length; with ``all_stats`` quartiles, gaps, N50, Q20, Q30 and GC shares.

    Reads are folded to one row per length first; order statistics use that table.
    """
    length = F.length("seq").cast("long")
    letters = length - F.length(F.translate("seq", gaps, "")).cast("long")
    gc = length - F.length(F.translate("seq", "GCgc", "")).cast("long")
    scored = "qual" in reads.columns
    q20, q30 = (_quality_at_least(20), _quality_at_least(30)) if scored else (F.lit(None).cast("long"),) * 2
    table = reads.groupBy(by, length.alias("len")).agg(
        F.count("*").alias("n"), F.sum(letters).alias("gap"), F.sum(gc).alias("gc"), F.sum(q20).alias("q20"), F.sum(q30).alias("q30")
    )
    total = F.sum(F.col("len") * F.col("n"))
    base = [
        F.sum("n").alias("num_seqs"), total.alias("sum_len"), F.min("len").alias("min_len"), (total / F.sum("n")).alias("avg_len"), F.max("len").alias("max_len"),
    ]
    if not all_stats and not n_stats:
        return table.groupBy(by).agg(*base)
    quarter = F.percentile("len", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    bases = F.nullif(total, F.lit(0))
    more = [
        quarter.alias("_q"), F.sum("gap").alias("sum_gap"), (F.sum("q20") * 100.0 / bases).alias("q20_percent"),
        (F.sum("q30") * 100.0 / bases).alias("q30_percent"), (F.sum("gc") * 100.0 / bases).alias("gc_percent"),
    ]
    flat = table.groupBy(by).agg(*base, *more)
    longer = running(table.select(by, "len", "n"), [by], "len", [Run("_down", "sum", F.col("len") * F.col("n"), backwards=True)])
    marks = sorted({50, *n_stats})
    reached = longer.join(flat.select(by, "sum_len"), by).groupBy(by).agg(
        *[F.max(F.when(F.col("_down") * 100 >= F.col("sum_len") * m, F.col("len"))).alias(f"n{m}") for m in marks]
    )
    quarters = [F.col("_q")[i].alias(f"q{i + 1}") for i in range(3)]
    return flat.join(reached, by).select(
        by, "num_seqs", "sum_len", "min_len", "avg_len", "max_len", *quarters, "sum_gap", *[f"n{m}" for m in marks], "q20_percent", "q30_percent", "gc_percent"
    )


def _fails(min_length: int, max_unqualified_percent: float, max_n: int) -> Column:
    length = F.length("seq")
    low = length - _quality_at_least(UNQUALIFIED_BELOW)
    n = length - F.length(F.translate("seq", "N", ""))
    return (length < min_length) | (low * 100.0 > length * float(max_unqualified_percent)) | (n > max_n)


def clean_reads(
    reads: DataFrame, min_length: int = 15, max_unqualified_percent: float = 20, max_n: int = 5, dedup: bool = False, paired: bool = False
) -> DataFrame:
    """Short-read filter; with ``paired`` a failing mate takes its partner along."""
    fails = _fails(min_length, max_unqualified_percent, max_n)
    if paired:
        kept = reads.join(reads.filter(fails).select("read_id").distinct(), "read_id", "left_anti").select(*reads.columns)
    else:
        kept = reads.filter(~fails)
    return dedup_reads(kept) if dedup else kept


def clean_reads_preset(reads: DataFrame, preset: str = "default", paired: bool = False) -> DataFrame:
    length, percent, n, dedup = CLEAN_PRESETS[preset]
    return clean_reads(reads, length, percent, n, dedup, paired)


def mean_quality(qual: Column) -> Column:
    """Phred of the mean error probability."""
    errors = F.transform(F.split(qual, ""), lambda c: F.pow(F.lit(10.0), (F.lit(33) - F.ascii(c)) / 10.0))
    total = F.aggregate(errors, F.lit(0.0), lambda acc, p: acc + p)
    return F.lit(-10.0) * F.log10(total / F.nullif(F.length(qual), F.lit(0)))


def clean_long_reads(reads: DataFrame, min_length: int = 1000, min_quality: float = 10.0) -> DataFrame:
    """Remove gaps, then drop short reads and reads of low mean quality."""
    bare = reads.withColumn("seq", F.translate("seq", "-", "")).filter(F.length("seq") >= min_length)
    return bare.filter(mean_quality(F.col("qual")) >= min_quality)


def dedup_reads(reads: DataFrame) -> DataFrame:
    """Keep the smallest read id of each set of identical templates (both mates equal)."""
    mate = F.col("mate") if "mate" in reads.columns else F.lit(1)
    templates = reads.groupBy("read_id").agg(F.min(F.when(mate == 1, F.col("seq"))).alias("_1"), F.min(F.when(mate == 2, F.col("seq"))).alias("_2"))
    kept = templates.groupBy("_1", "_2").agg(F.min("read_id").alias("read_id"))
    return reads.join(kept.select("read_id"), "read_id", "left_semi").select(*reads.columns)


# --- sampling -----------------------------------------------------------------------------


def sample_hash(key: Column, seed: int) -> Column:
    """Uniform 60-bit number of a key, the same in every engine that has MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1), F.lit(_HASH_BITS // 4)), 16, 10).cast("long")


def sample_fraction(a: DataFrame, fraction: float, seed: int = 42, key: str = "qname") -> DataFrame:
    """Keep templates whose hash falls below ``fraction``; mates share their fate."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    return a.filter(sample_hash(F.col(key), seed) < int(fraction * (1 << _HASH_BITS)))


def _below_cut(reads: DataFrame, weight: Column, target: int, seed: int, key: str) -> DataFrame:
    """Templates in hash order until their summed weight reaches ``target``.

    Bucket totals locate the bucket in which the target falls; only that bucket is
    ordered, and the cut is then a plain filter on the hash.
    """
    h = sample_hash(F.col(key), seed)
    shift = _HASH_BITS - _BUCKET_BITS
    weighed = reads.select(F.col(key).alias("k"), weight.alias("w")).groupBy("k").agg(F.sum("w").alias("w"))
    weighed = weighed.withColumn("h", sample_hash(F.col("k"), seed)).withColumn("b", F.shiftright("h", shift))
    per_bucket = weighed.groupBy("b").agg(F.sum("w").alias("w"))
    upto = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = per_bucket.withColumn("before", F.coalesce(F.sum("w").over(upto), F.lit(0)))
    edge = buckets.filter((F.col("before") < target) & (F.col("before") + F.col("w") >= target)).select("b", "before")
    inside = weighed.join(edge, "b")
    order = Window.partitionBy("b").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, -1)
    taken = inside.withColumn("sum", F.col("before") + F.coalesce(F.sum("w").over(order), F.lit(0))).filter(F.col("sum") < target)
    cut = taken.agg(F.max(F.struct("h", "k")).alias("c")).scalar()
    mine = F.struct(h.alias("h"), F.col(key).alias("k"))
    return reads.filter(F.coalesce(mine <= cut, F.lit(True)))


def sample_to_coverage(reads: DataFrame, coverage: float, genome_size: int, seed: int = 42, key: str = "read_id") -> DataFrame:
    """Random templates until coverage x genome size bases are reached; pairs stay together."""
    return _below_cut(reads, F.length("seq").cast("long"), int(coverage * genome_size), seed, key)


def sample_n(reads: DataFrame, n: int, seed: int = 42, key: str = "read_id") -> DataFrame:
    """``n`` random templates."""
    once = reads.groupBy(key).agg(F.lit(1).cast("long").alias("_w"))
    kept = _below_cut(once, F.col("_w"), n, seed, key).select(key)
    return reads.join(kept, key, "left_semi").select(*reads.columns)
