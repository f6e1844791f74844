"""Read alignments: filters, clipping, mates, duplicates, cropping, counts.

Columns: qname, flag, rname, pos (1-based), mapq, cigar, rnext, pnext, tlen, seq,
qual, tags MAP; a cohort adds its own leading columns such as sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions import cigar as C
from haplolake.functions.numbers import quality_sum
from haplolake.operators.intervals import merge_intervals, overlap_join

# FLAG bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
REVERSE, MATE_REVERSE, FIRST, SECOND = 0x10, 0x20, 0x40, 0x80
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800

# Flag masks of the filters.
EXCLUDE_DEFAULT = 1796
EXCLUDE_BY_QUALITY = 3844
STALE_TAGS = ("MD", "NM", "SA")

# Bins of the join between spans of reads and intervals.
SPAN_BIN = 256


def has(mask: int, flag: Column | None = None) -> Column:
    """Any of the bits is set."""
    return (F.col("flag") if flag is None else flag).bitwiseAND(mask) != 0


def reference_end() -> Column:
    """0-based end on the reference (exclusive)."""
    return F.col("pos") - 1 + C.reference_length(F.col("cigar"))


def as_intervals(a: DataFrame) -> DataFrame:
    """Adds contig, start, end of mapped reads."""
    mapped = a.filter(~has(UNMAPPED) & (F.col("rname") != "*") & (F.col("cigar") != "*"))
    return mapped.select(
        "*", F.col("rname").alias("contig"), (F.col("pos") - 1).cast("long").alias("start"), reference_end().cast("long").alias("end")
    )


def filter_alignments(
    a: DataFrame,
    min_mapq: int = 60,
    exclude_flags: int = EXCLUDE_DEFAULT,
    include_flags: int = 0,
    regions: DataFrame | None = None,
) -> DataFrame:
    """Flag and quality filter, optionally restricted to reads touching a region."""
    flag = F.col("flag")
    kept = a.filter(
        (flag.bitwiseAND(exclude_flags) == 0)
        & (flag.bitwiseAND(include_flags) == include_flags)
        & (F.col("mapq") >= min_mapq)
    )
    if regions is None:
        return kept
    return overlap_join(as_intervals(kept), regions, "contig", "left_semi").select(*a.columns)


def by_quality(a: DataFrame) -> DataFrame:
    return filter_alignments(a, 30, EXCLUDE_BY_QUALITY)


def proper_pairs(a: DataFrame, min_mapq: int = 60) -> DataFrame:
    return filter_alignments(a, min_mapq, include_flags=PROPER)


def with_contig_length(df: DataFrame, contigs: DataFrame, on: str = "rname") -> DataFrame:
    """Contig length by name; NULL when the contig is unknown."""
    return df.join(contigs.select(F.col("contig").alias(on), F.col("length").alias("contig_length")), on, "left")


def clip_filter(
    a: DataFrame,
    contigs: DataFrame,
    max_clip: int | None = 10,
    max_clip_fraction: float | None = None,
    invert: bool = False,
    fix_mate: bool = True,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Drop alignments clipped inside the contig; clipping that reaches a contig end is ignored.

    With ``fix_mate`` the paired reads that survive a dropped partner get the
    mate-unmapped bit. Only names that have both kept and dropped records are
    looked up, so a name with many records is never gathered in one place.
    """
    if max_clip is not None and max_clip < 0:
        raise ValueError("max_clip must not be negative")
    if max_clip_fraction is not None and not 0 <= max_clip_fraction <= 1:
        raise ValueError("max_clip_fraction must lie between 0 and 1")
    left, right = C.end_clips(F.col("cigar"))
    marked = with_contig_length(a, contigs).withColumn("_left", left).withColumn("_right", right)
    length = F.when(
        F.col("contig_length").isNull() & ((F.col("_left") > 0) | (F.col("_right") > 0)),
        F.raise_error(F.concat(F.lit("unknown contig "), F.col("rname"))).cast("long"),
    ).otherwise(F.col("contig_length"))
    end = F.col("pos") + F.length("seq") - 1
    inner_left = F.when(F.col("pos") <= 1 + F.col("_left"), 0).otherwise(F.col("_left"))
    inner_right = F.when(end >= length - F.col("_right"), 0).otherwise(F.col("_right"))
    marked = marked.withColumn("_left", inner_left).withColumn("_right", inner_right)
    bad = F.lit(False)
    if max_clip is not None:
        bad = bad | (F.greatest("_left", "_right") > max_clip)
    if max_clip_fraction is not None:
        full = C.query_length(F.col("cigar"))
        share = (F.col("_left") + F.col("_right")) / F.nullif(full, F.lit(0))
        bad = bad | F.coalesce(share > max_clip_fraction, F.lit(False))
    marked = marked.withColumn("_bad", bad & F.col("cigar").rlike(r"\d[SH]"))
    if invert:
        return marked.filter("_bad").select(*a.columns)
    kept = marked.filter(~F.col("_bad"))
    if not fix_mate:
        return kept.select(*a.columns)
    lost = marked.filter("_bad").select(*keys, "qname").distinct().withColumn("_lost", F.lit(True))
    flag = F.when(F.col("_lost") & has(PAIRED), F.col("flag").bitwiseOR(MATE_UNMAPPED)).otherwise(F.col("flag"))
    return kept.join(lost, [*keys, "qname"], "left").withColumn("flag", flag.cast("int")).select(*a.columns)


def _five_prime() -> Column:
    """Unclipped position of the first sequenced base."""
    left, right = C.end_clips(F.col("cigar"))
    return F.when(has(REVERSE), reference_end() - 1 + right).otherwise(F.col("pos") - 1 - left).cast("long")


def _base_quality_score() -> Column:
    """Sum of base qualities of 15 and above."""
    scores = F.transform(F.split(F.col("qual"), ""), lambda c: F.ascii(c) - 33)
    return F.aggregate(F.filter(scores, lambda q: q >= 15), F.lit(0).cast("long"), lambda acc, q: acc + q)


def mark_duplicates(
    a: DataFrame, remove: bool = True, score: Column | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    """One template per pair of unclipped 5' ends survives: best score, then smallest name.

    Templates and winners are both partial aggregates, so a pile of identical
    templates shrinks on the map side.
    """
    worth = (_base_quality_score() if score is None else score).cast("long")
    primary = ~has(UNMAPPED | SECONDARY | SUPPLEMENTARY)
    end = F.struct(F.col("rname").alias("contig"), _five_prime().alias("at"), has(REVERSE).alias("reverse"))
    templates = (
        a.filter(primary)
        .groupBy(*keys, "qname")
        .agg(F.min(end).alias("_a"), F.max(end).alias("_b"), F.sum(worth).alias("_score"))
    )
    best = (
        templates.groupBy(*keys, "_a", "_b")
        .agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("qname").alias("qname"))).alias("_w"))
        .select(*keys, F.col("_w.qname").alias("qname"), F.lit(True).alias("_best"))
    )
    marked = a.join(best, [*keys, "qname"], "left").withColumn("_dup", primary & F.col("_best").isNull())
    if remove:
        return marked.filter(~F.col("_dup")).select(*a.columns)
    flag = F.when(F.col("_dup"), F.col("flag").bitwiseOR(DUPLICATE)).otherwise(F.col("flag").bitwiseAND(~DUPLICATE))
    return marked.withColumn("flag", flag.cast("int")).select(*a.columns)


def fixmate(a: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fill mate reference, position, orientation and template length of primary pairs.

    tlen spans the outermost mapped bases and is positive on the leftmost mate
    (read 1 on a tie); 0 for mates on different contigs.
    """
    primary = has(PAIRED) & ~has(SECONDARY | SUPPLEMENTARY) & has(FIRST | SECOND)
    mate = F.struct(
        F.col("rname").alias("rname"), F.col("pos").alias("pos"), reference_end().alias("end"), F.col("flag").alias("flag"), F.col("cigar").alias("cigar")
    )
    ends = (
        a.filter(primary)
        .select(*keys, "qname", (~has(FIRST)).alias("_one"), mate.alias("_m"))
        .groupBy(*keys, "qname", "_one")
        .agg(F.min("_m").alias("_m"))
    )
    joined = a.withColumn("_one", F.when(primary, has(FIRST))).join(ends, [*keys, "qname", "_one"], "left")
    found = F.col("_m").isNotNull()
    same = (F.col("_m.rname") == F.col("rname")) & ~has(UNMAPPED) & ~has(UNMAPPED, F.col("_m.flag"))
    low = F.least(F.col("pos") - 1, F.col("_m.pos") - 1)
    span = (F.greatest(reference_end(), F.col("_m.end")) - low).cast("int")
    leftmost = (F.col("pos") < F.col("_m.pos")) | ((F.col("pos") == F.col("_m.pos")) & has(FIRST))
    flag = F.col("flag").bitwiseAND(~(MATE_REVERSE | MATE_UNMAPPED))
    flag = flag.bitwiseOR(F.when(has(REVERSE, F.col("_m.flag")), MATE_REVERSE).otherwise(0))
    flag = flag.bitwiseOR(F.when(has(UNMAPPED, F.col("_m.flag")), MATE_UNMAPPED).otherwise(0))
    filled = {
        "flag": F.when(found, flag).otherwise(F.col("flag")).cast("int"),
        "rnext": F.when(found, F.when(F.col("_m.rname") == F.col("rname"), "=").otherwise(F.col("_m.rname"))).otherwise(F.col("rnext")),
        "pnext": F.when(found, F.col("_m.pos")).otherwise(F.col("pnext")).cast("int"),
        "tlen": F.when(found & same, F.when(leftmost, span).otherwise(-span)).when(found, 0).otherwise(F.col("tlen")).cast("int"),
    }
    if "tags" in a.columns:
        fresh = F.map_concat(
            F.map_filter("tags", lambda k, _v: k != "MC"), F.create_map(F.lit("MC"), F.col("_m.cigar"))
        )
        filled["tags"] = F.when(found, fresh).otherwise(F.col("tags"))
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in a.columns])


def crop_reads(a: DataFrame, bed: DataFrame) -> DataFrame:
    """Cut reads to intervals: one record per overlapped merged interval.

    Clips are dropped, an insertion stays if its reference position is inside,
    edge deletions are trimmed, and tags that no longer hold are removed. Distinct
    spans alone are copied to bins and meet the intervals, so texts move once.
    """
    reads = as_intervals(a).filter(F.col("end") > F.col("start"))
    spans = reads.select("contig", "start", "end").distinct()
    places = overlap_join(spans, merge_intervals(bed), bin_size=SPAN_BIN)
    pairs = reads.join(places, ["contig", "start", "end"]).withColumn("_ops", C.placed(F.col("cigar"), F.col("start")))
    lo, hi = F.greatest("start", "start_b").cast("long"), F.least("end", "end_b").cast("long")
    pairs = pairs.withColumn("_lo", lo).withColumn("_hi", hi)

    def cut(p: Column) -> Column:
        first = F.greatest(p["ref"], F.col("_lo"))
        kept = F.greatest(F.lit(0), F.least(p["ref"] + p["len"], F.col("_hi")) - first)
        inside = (p["ref"] >= F.col("_lo")) & (p["ref"] < F.col("_hi"))
        spans = p["op"].isin(*C.ALIGNED_OPS)
        size = F.when(spans | p["op"].isin("D", "N"), kept).when(inside & p["op"].isin("I", "P"), p["len"]).otherwise(0)
        return F.struct(
            size.cast("int").alias("len"),
            p["op"].alias("op"),
            F.when(p["op"] == "I", p["ref"]).otherwise(first).alias("ref"),
            F.when(spans, p["query"] + first - p["ref"]).otherwise(p["query"]).cast("int").alias("query"),
        )

    parts = F.filter(F.transform("_ops", cut), lambda p: p["len"] > 0)
    edge = F.transform("_parts", lambda p: p["op"].isin(*C.EDGE_OPS))
    head = F.array_position(edge, False)
    tail = F.array_position(F.reverse(edge), False)
    trimmed = F.slice("_parts", F.greatest(head, F.lit(1)).cast("int"), F.greatest(F.size("_parts") - tail - head + 2, F.lit(0)).cast("int"))
    pairs = pairs.withColumn("_parts", parts).withColumn("_solid", F.exists("_parts", lambda p: ~p["op"].isin(*C.EDGE_OPS)))
    pairs = pairs.filter("_solid").withColumn("_parts", trimmed)
    on_ref = F.filter("_parts", lambda p: p["op"].isin(*C.REFERENCE_OPS))
    query = F.filter("_parts", lambda p: p["op"].isin(*C.QUERY_OPS))

    def letters(name: str) -> Column:
        text = F.array_join(F.transform(query, lambda p: F.substr(F.col(name), p["query"] + 1, p["len"])), "")
        return F.when(F.col(name) == "*", "*").otherwise(text)

    new = {
        "pos": (F.coalesce(F.get(on_ref, F.lit(0))["ref"], F.col("_lo")) + 1).cast(a.schema["pos"].dataType),
        "cigar": C.text(F.col("_parts")),
        "seq": letters("seq"),
        "qual": letters("qual"),
        "tags": F.map_filter("tags", lambda k, _v: ~k.isin(*STALE_TAGS)) if "tags" in a.columns else None,
    }
    return pairs.select(*[new[c].alias(c) if c in new else F.col(c) for c in a.columns])


def flagstat(a: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    primary = ~has(SECONDARY | SUPPLEMENTARY)
    paired = primary & has(PAIRED)

    def count(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    proper = count(paired & has(PROPER) & ~has(UNMAPPED))
    return a.groupBy(*keys).agg(
        F.count("*").alias("total"),
        count(primary).alias("primary"),
        count(has(SECONDARY)).alias("secondary"),
        count(has(SUPPLEMENTARY)).alias("supplementary"),
        count(has(DUPLICATE)).alias("duplicates"),
        count(~has(UNMAPPED)).alias("mapped"),
        (count(~has(UNMAPPED)) * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("mapped_percent"),
        proper.alias("properly_paired"),
        (proper * 100.0 / F.nullif(count(paired), F.lit(0))).alias("properly_paired_percent"),
    )


def alignment_stats(a: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mapped reads and bases, error rate, mean length, quality and insert size of primary records."""
    mapped = ~has(UNMAPPED)
    aligned = C.consumed(C.ops(F.col("cigar")), C.ALIGNED_OPS + ("I",))
    edits = F.try_element_at(F.col("tags"), F.lit("NM")).try_cast("long") if "tags" in a.columns else F.lit(None).cast("long")
    qual = F.col("qual") if "qual" in a.columns else F.lit(None).cast("string")
    insert = F.abs("tlen") if "tlen" in a.columns else F.lit(None).cast("int")
    length = F.length("seq").cast("long")
    return (
        a.filter(~has(SECONDARY | SUPPLEMENTARY))
        .groupBy(*keys)
        .agg(
            F.sum(mapped.cast("long")).alias("reads_mapped"),
            F.sum((~mapped).cast("long")).alias("reads_unmapped"),
            F.sum(F.when(mapped, aligned.cast("long"))).alias("bases_mapped"),
            (F.sum(F.when(mapped, edits)) / F.nullif(F.sum(F.when(mapped, aligned.cast("long"))), F.lit(0))).alias("error_rate"),
            (F.sum(length) / F.nullif(F.count("*"), F.lit(0))).alias("average_length"),
            (F.sum(quality_sum(qual)) / F.nullif(F.sum(F.when(qual != "*", F.length(qual).cast("long"))), F.lit(0))).alias("average_quality"),
            F.avg(F.when(has(PROPER) & (insert > 0), insert)).alias("insert_size_average"),
        )
    )


def sort_alignments(a: DataFrame, contigs: DataFrame | None = None, by: str = "coordinate") -> DataFrame:
    if by == "queryname":
        return a.orderBy("qname", "flag")
    if contigs is None:
        return a.orderBy("rname", "pos")
    ranks = contigs.select(F.col("contig").alias("rname"), F.col("ord").alias("_ord"))
    return a.join(ranks, "rname", "left").orderBy(F.col("_ord").asc_nulls_last(), "pos").select(*a.columns)
