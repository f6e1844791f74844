"""Assembly alignments: PAF context, delta blocks, unaligned regions.

PAF blocks use contig, start, end (target, half-open), qstart, qend, mapq and a
tags MAP. Delta blocks use 1-based closed ref and qry coordinates and signed
offsets; a reversed query has qry_start > qry_end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions import alleles as A
from haplolake.functions import fields as X
from haplolake.operators.intervals import best_block, complement, coverage_gt, merge_intervals, overlap_join
from haplolake.operators.sequences import fetch, sequence_blocks
from haplolake.session import stage

# Thresholds below or above which a PAF context is doubtful; 0 switches one off.
PAF_THRESHOLDS = {
    "min_mapq": 30,
    "max_secondary_ratio": 0.8,
    "max_gap_divergence": 0.05,
    "max_divergence": 0.05,
    "max_repeat_fraction": 0.5,
    "min_minimizers_per_kb": 0.0,
}

# Delta block filters; 0 switches one off.
MIN_IDENTITY, MIN_BLOCK, MAX_VARIANTS_PER_KB = 96.05, 700, 37.5

# Numeric PAF tags.
_PAF_NUMBERS = {"s1": "int", "s2": "int", "cm": "int", "AS": "int", "dv": "double", "de": "double", "rl": "int"}


def paf_fields(paf: DataFrame) -> DataFrame:
    """Typed tags as columns, and the aligned query length."""
    def tag(name: str) -> Column:
        return F.try_element_at("tags", F.lit(name))

    return paf.select(
        "*",
        F.coalesce(tag("tp"), F.lit("")).alias("tp"),
        *[tag(n).try_cast(t).alias(n.lower()) for n, t in _PAF_NUMBERS.items()],
        F.greatest(F.abs(F.col("qend") - F.col("qstart")), F.lit(1)).cast("int").alias("qspan"),
    )


def paf_primary(paf: DataFrame) -> DataFrame:
    return paf.filter(F.try_element_at("tags", F.lit("tp")).isin("P", "I"))


def paf_rank() -> Column:
    """Best mapping quality, chain score and span; ties go to the first in target order, then the smallest name."""
    code = F.transform(F.split("qname", ""), lambda c: -F.ascii(c))
    return F.struct(
        F.col("mapq").cast("int").alias("mapq"),
        F.coalesce("s1", F.lit(-1)).alias("s1"),
        (F.col("end") - F.col("start")).cast("long").alias("span"),
        (-F.col("start")).cast("long").alias("first"),
        code.alias("name"),
    )


def annotate_paf(v: DataFrame, paf: DataFrame, keys: tuple[str, ...] = (), **thresholds: float) -> DataFrame:
    """Add the context of the best covering PAF block and label doubtful records LowQual.

    With ``keys`` (say, the sample) a record meets blocks of its own key only.
    """
    t = {**PAF_THRESHOLDS, **thresholds}
    if set(t) != set(PAF_THRESHOLDS):
        raise ValueError(f"unknown threshold in {sorted(thresholds)}")
    keep = ["qname", "start", "end", "mapq", "tp", "s1", "s2", "cm", "as", "dv", "de", "rl", "qspan"]
    blocks = paf_fields(paf).select(*keys, "contig", *keep)
    points = v.withColumn("contig", F.col("chrom")).withColumn("pos0", (F.col("pos") - 1).cast("long"))
    found = best_block(points, blocks, paf_rank(), keep, [*keys, "contig"])
    hit = F.col("qname").isNotNull()
    ratio = F.when(F.col("s1") > 0, F.col("s2") / F.nullif(F.col("s1"), F.lit(0)))
    per_kb = F.col("cm") / (F.col("qspan") / 1000.0)
    share = F.col("rl") / F.col("qspan")

    def rule(limit: str, cond: Column, label: str) -> Column:
        return F.when(cond if t[limit] > 0 else F.lit(False), label)

    reasons = F.when(~hit, F.array(F.lit("NO_PAF_CONTEXT"))).otherwise(
        X.compact(
            rule("min_mapq", F.col("mapq") < t["min_mapq"], "LOW_MAPQ"),
            F.when((F.col("tp") != "") & ~F.col("tp").isin("P", "I"), "NON_PRIMARY"),
            rule("max_secondary_ratio", ratio >= t["max_secondary_ratio"], "REPETITIVE_CHAIN"),
            rule("max_gap_divergence", F.col("de") > t["max_gap_divergence"], "HIGH_DE"),
            rule("max_divergence", F.col("dv") > t["max_divergence"], "HIGH_DV"),
            rule("max_repeat_fraction", share > t["max_repeat_fraction"], "HIGH_RL"),
            rule("min_minimizers_per_kb", per_kb < t["min_minimizers_per_kb"], "LOW_CM_PER_KB"),
        )
    )
    edge = F.least(F.col("pos0") - F.col("start"), F.col("end") - F.col("pos0") - 1)
    notes = {
        "ASM_MAPQ": F.col("mapq"),
        "ASM_TP": F.nullif(F.col("tp"), F.lit("")),
        **{f"ASM_{n.upper()}": F.col(n) for n in ("s1", "s2", "cm", "as", "dv", "de", "rl")},
        "ASM_S2_RATIO": ratio,
        "ASM_CM_PER_KB": per_kb,
        "ASM_RL_FRAC": share,
        "ASM_EDGE_DIST": edge,
    }
    # a column of its own: written into the next expression, the map would be built for each of its uses there
    out = found.withColumn("_reasons", reasons).withColumn("info", X.put_all(F.col("info"), notes))
    info = X.add_reasons(F.col("info"), "ASM_LOWQUAL_REASON", F.col("_reasons"))
    label = F.when(F.size("_reasons") > 0, F.array(F.lit("LowQual"))).otherwise(F.array().cast("array<string>"))
    fmt = F.when(F.map_contains_key("fmt", "DP") | (F.size("fmt") == 0), F.col("fmt")).otherwise(
        F.map_concat(F.map_filter("fmt", lambda k, _v: k != "AO"), F.create_map(F.lit("DP"), F.lit("1"), F.lit("AO"), F.lit("1")))
    )
    return (
        out.withColumn("info", info)
        .withColumn("filters", X.add_labels(F.col("filters"), label))
        .withColumn("fmt", fmt)
        .select(*v.columns)
    )


def missing_regions(blocks: DataFrame, contigs: DataFrame, primary_only: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reference intervals no alignment block covers; with ``keys`` in both tables, by key.

    A key of ``contigs`` without any block lacks whole contigs.
    """
    used = paf_primary(blocks) if primary_only and "tags" in blocks.columns else blocks
    return complement(used.select(*keys, "contig", "start", "end"), contigs, [*keys, "contig"])


def coords_intervals(coords: DataFrame) -> DataFrame:
    """Merged half-open intervals of (contig, s1, e1) rows, 1-based closed and possibly reversed."""
    return merge_intervals(coords.select("contig", (F.least("s1", "e1") - 1).alias("start"), F.greatest("s1", "e1").alias("end")))


# --- delta blocks -----------------------------------------------------------------------


def block_metrics(blocks: DataFrame) -> DataFrame:
    """Length (longer of both spans), identity and, with ``n_variants``, variants per kb."""
    size = F.greatest(F.abs(F.col("ref_end") - F.col("ref_start")) + 1, F.abs(F.col("qry_end") - F.col("qry_start")) + 1)
    out = blocks.withColumn("block_len", size.cast("long")).withColumn("identity", (1.0 - F.col("errors") / F.col("block_len")) * 100.0)
    if "n_variants" in blocks.columns:
        out = out.withColumn("variants_per_kb", F.col("n_variants") * 1000.0 / F.col("block_len"))
    return out


def filter_blocks(
    blocks: DataFrame, min_identity: float = MIN_IDENTITY, min_length: int = MIN_BLOCK, max_variants_per_kb: float = MAX_VARIANTS_PER_KB
) -> DataFrame:
    kept = blocks
    if min_identity > 0:
        kept = kept.filter(F.col("identity") >= min_identity)
    if min_length > 0:
        kept = kept.filter(F.col("block_len") >= min_length)
    if max_variants_per_kb > 0:
        kept = kept.filter(F.col("variants_per_kb") <= max_variants_per_kb)
    return kept


def drop_ambiguous(records: DataFrame, blocks: DataFrame, at: str = "pos") -> DataFrame:
    """Drop records at positions that more than one block covers; ``blocks`` name ``contig``, ref_start and ref_end."""
    spans = blocks.select(
        F.col("contig").alias("chrom"),
        F.least("ref_start", "ref_end").cast("long").alias("start"),
        (F.greatest("ref_start", "ref_end") + 1).cast("long").alias("end"),
    )
    doubtful = coverage_gt(spans, 1, "chrom").select("chrom", "start", "end")
    spots = records.withColumn("start", F.col(at).cast("long")).withColumn("end", F.col(at).cast("long") + 1)
    return overlap_join(spots, doubtful, "chrom", "left_anti").select(*records.columns)


def _fold_offsets() -> Column:
    """Runs of offsets as (sign, ref_before, qry_before, size): bases consumed before each indel run."""
    kind = "array<struct<sign:int,ref:int,qry:int,size:int>>"
    state = F.struct(
        F.lit(0).alias("ref"), F.lit(0).alias("qry"), F.array().cast(kind).alias("out")
    )

    def step(s: Column, o: Column) -> Column:
        sign = F.signum(o).cast("int")
        matched = (F.abs(o) - 1).cast("int")
        last = F.try_element_at(s["out"], F.lit(-1))
        ref, qry = s["ref"] + matched, s["qry"] + matched
        grows = (matched == 0) & last["sign"].isNotNull()
        side = F.when(grows, last["sign"]).otherwise(sign)
        item = F.struct(sign.alias("sign"), ref.alias("ref"), qry.alias("qry"), F.lit(1).alias("size"))
        longer = F.struct(last["sign"].alias("sign"), last["ref"].alias("ref"), last["qry"].alias("qry"), (last["size"] + 1).alias("size"))
        out = F.when(grows, F.concat(F.slice(s["out"], 1, F.size(s["out"]) - 1), F.array(longer))).otherwise(F.concat(s["out"], F.array(item)))
        return F.struct(
            (ref + F.when(side > 0, 1).otherwise(0)).alias("ref"), (qry + F.when(side < 0, 1).otherwise(0)).alias("qry"), out.alias("out")
        )

    return F.aggregate(F.transform("offsets", lambda o: o.cast("int")), state, step, lambda s: s["out"])


def _owned(owner: str, name: str) -> Column:
    return F.concat(F.coalesce(F.length(owner).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(owner, F.lit("")), F.col(name))


def delta_variants(
    blocks: DataFrame,
    ref: DataFrame,
    qry: DataFrame,
    min_identity: float = MIN_IDENTITY,
    min_length: int = MIN_BLOCK,
    max_variants_per_kb: float = MAX_VARIANTS_PER_KB,
    drop_ambiguous_positions: bool = True,
    sample: str | None = None,
    chunk: int = 1024,
) -> DataFrame:
    """Variants of delta blocks: SNPs where aligned bases differ, left-anchored indels.

    If ``blocks`` and ``qry`` have a ``sample``, query contigs belong to it and so do
    the variants and ambiguous positions; otherwise all are of the one ``sample``.
    A block that names a contig which is not there is an error.

    A block becomes gap-free stretches, the stretches pieces of at most ``chunk``
    bases; a piece meets its two sequence chunks by equi-join, so no task holds a
    whole contig pair and a long block spreads over many tasks.
    """
    by_sample = "sample" in blocks.columns
    if by_sample:
        # sample and contig in one name, the length first so that no two names agree
        blocks, qry = blocks.withColumn("qry", _owned("sample", "qry")), qry.withColumn("contig", _owned("sample", "contig"))
    else:
        blocks = blocks.withColumn("sample", F.lit(sample).cast("string"))
    sized = qry.select(F.col("contig").alias("qry"), F.length("seq").alias("_qlen"))
    known = ref.select(F.col("contig").alias("ref"), F.lit(True).alias("_known"))
    base = block_metrics(stage(blocks.withColumn("block_id", F.monotonically_increasing_id())))
    base = base.join(sized, "qry", "left").join(known, "ref", "left")
    unknown = F.raise_error(F.concat(F.lit("delta block of an unknown contig: "), "ref", F.lit(" "), "qry")).cast("int")
    base = base.withColumn("_qlen", F.when(F.col("_known") & F.col("_qlen").isNotNull(), F.col("_qlen")).otherwise(unknown))
    base = base.withColumn("reverse", F.col("qry_start") > F.col("qry_end"))
    first_q = F.when(F.col("reverse"), F.col("_qlen") - F.col("qry_start")).otherwise(F.col("qry_start") - 1)
    base = base.withColumn("_r0", (F.col("ref_start") - 1).cast("int")).withColumn("_q0", first_q.cast("int"))
    base = stage(base.withColumn("_gaps", _fold_offsets()))
    tail = F.struct(F.lit(0).alias("sign"), F.lit(0).alias("ref"), F.lit(0).alias("qry"), F.lit(0).alias("size"))
    kept = ["sample", "block_id", "ref", "qry", "reverse", "ref_start", "ref_end", "errors", "block_len", "identity", "_r0", "_q0", "_qlen"]
    runs = base.select(*kept, "_gaps", F.posexplode(F.concat("_gaps", F.array(tail))).alias("_i", "_g"))
    before = F.get("_gaps", F.col("_i") - 1)
    # a run of sign + skips reference bases, of sign - skips query bases
    start_r = F.coalesce(before["ref"] + F.when(before["sign"] > 0, before["size"]).otherwise(0), F.lit(0))
    start_q = F.coalesce(before["qry"] + F.when(before["sign"] < 0, before["size"]).otherwise(0), F.lit(0))
    span = F.col("ref_end") - F.col("ref_start") + 1
    stop_r = F.when(F.col("_g.sign") == 0, span).otherwise(F.col("_g.ref"))
    stretches = runs.select(*kept, "_g", start_r.cast("int").alias("_sr"), start_q.cast("int").alias("_sq"), (stop_r - start_r).cast("int").alias("_n"))

    pieces = stretches.filter(F.col("_n") > 0).select(
        *kept, "_sr", "_sq", "_n",
        F.explode(F.sequence(F.expr(f"(_r0 + _sr) div {chunk}"), F.expr(f"(_r0 + _sr + _n - 1) div {chunk}"))).alias("rblock"),
    )
    lo = F.greatest(F.col("_r0") + F.col("_sr"), F.col("rblock") * chunk).cast("int")
    hi = F.least(F.col("_r0") + F.col("_sr") + F.col("_n"), (F.col("rblock") + 1) * chunk).cast("int")
    shift = F.col("_q0") + F.col("_sq") - F.col("_r0") - F.col("_sr")
    pieces = pieces.select(*kept, "rblock", lo.alias("lo"), hi.alias("hi"), (lo + shift).cast("int").alias("qlo"))
    # both are read several times below; only contigs of reversed blocks are turned
    ref = stage(ref.select("contig", F.upper("seq").alias("seq")))
    turned = qry.join(base.filter("reverse").select(F.col("qry").alias("contig")).distinct(), "contig", "left_semi")
    sides = [side.select("contig", F.upper("seq").alias("seq"), F.lit(back).alias("reverse")) for side, back in ((qry, False), (turned, True))]
    both = stage(sides[0].unionByName(sides[1].withColumn("seq", A.reverse_complement(F.col("seq")))))
    ref_parts = sequence_blocks(ref, chunk).select(F.col("contig").alias("ref"), F.col("block").alias("rblock"), F.col("seq").alias("rseq"))
    qry_parts = sequence_blocks(both, chunk, overlap=chunk).select(F.col("contig").alias("qry"), "reverse", F.col("block").alias("qblock"), F.col("seq").alias("qseq"))
    # each query chunk carries the next one as overlap, so a piece needs a single lookup
    pieces = pieces.withColumn("qblock", F.expr(f"qlo div {chunk}").cast("long")).withColumn("rblock", F.col("rblock").cast("long"))
    met = pieces.join(ref_parts, ["ref", "rblock"]).join(qry_parts, ["qry", "reverse", "qblock"])
    r = F.substr("rseq", (F.col("lo") - F.col("rblock") * chunk + 1).cast("int"), F.col("hi") - F.col("lo"))
    q = F.substr("qseq", (F.col("qlo") - F.col("qblock") * chunk + 1).cast("int"), F.col("hi") - F.col("lo"))
    met = met.withColumn("_r", r).withColumn("_q", q).filter(F.col("_r") != F.col("_q"))
    # only positions that differ become rows, so a piece's text is not copied once a base
    bases = F.arrays_zip(F.split("_r", "").alias("r"), F.split("_q", "").alias("a"))
    told = F.transform(bases, lambda x, i: F.struct((i + 1).alias("k"), x["r"].alias("r"), x["a"].alias("a")))
    index = F.explode(F.filter(told, lambda x: (x["r"] != x["a"]) & (x["r"] != "") & (x["a"] != ""))).alias("_d")
    common = ["sample", "block_id", "ref", "ref_start", "ref_end", "errors", "block_len", "identity"]
    snps = (
        met.select(*common, "lo", index)
        .select(*common, (F.col("lo") + F.col("_d.k")).cast("long").alias("pos"), F.col("_d.r").alias("r"), F.col("_d.a").alias("a"))
    )
    # indels: anchor base plus the skipped bases, read from the sequence that has them
    gaps = stretches.filter(F.col("_g.sign") != 0).select(
        *common, "qry", "reverse",
        (F.col("_r0") + F.col("_g.ref")).cast("int").alias("_gr"), (F.col("_q0") + F.col("_g.qry")).cast("int").alias("_gq"),
        F.col("_g.sign").alias("_sign"), F.col("_g.size").alias("_size"),
    )
    ref_len = F.when(F.col("_sign") > 0, F.col("_size") + 1).otherwise(1)
    qry_len = F.when(F.col("_sign") < 0, F.col("_size") + 1).otherwise(1)
    indels = (
        fetch(gaps.withColumn("contig", F.col("ref")), ref, ["contig"], F.col("_gr") - 1, ref_len, "r", chunk)
        .drop("contig")
        .withColumn("contig", F.col("qry"))
    )
    indels = fetch(indels, both, ["contig", "reverse"], F.col("_gq") - 1, qry_len, "a", chunk)
    indels = indels.select(*common, F.col("_gr").cast("long").alias("pos"), "r", "a")
    records = snps.unionByName(indels)
    records = stage(records)
    counts = records.groupBy("block_id").agg(F.count("*").alias("_m"))
    per_block = base.select(*common).join(counts, "block_id", "left").withColumn("n_variants", F.coalesce("_m", F.lit(0)))
    good = filter_blocks(per_block.withColumn("variants_per_kb", F.col("n_variants") * 1000.0 / F.col("block_len")), min_identity, min_length, max_variants_per_kb)
    used = records.join(good.select("block_id", "variants_per_kb"), "block_id")
    if drop_ambiguous_positions:
        place = _owned("sample", "ref")
        used = drop_ambiguous(used.withColumn("chrom", place), good.select(place.alias("contig"), "ref_start", "ref_end")).drop("chrom")
    low, high = F.least("ref_start", "ref_end"), F.greatest("ref_start", "ref_end")
    edge = F.least(F.abs(F.col("pos") - low), F.abs(high - F.col("pos")))
    notes = {
        "MUMMER_BLEN": F.col("block_len"),
        "MUMMER_ERR": F.col("errors"),
        "MUMMER_IDENTITY": F.format_string("%.5f", F.col("identity")),
        "MUMMER_VAR_KB": F.format_string("%.5f", F.col("variants_per_kb")),
        "MUMMER_EDGE_DIST": edge,
    }
    return used.select(
        "sample",
        F.col("ref").alias("chrom"),
        "pos",
        F.lit(".").alias("id"),
        F.col("r").alias("ref"),
        F.array("a").alias("alts"),
        F.lit(60.0).alias("qual"),
        F.array().cast("array<string>").alias("filters"),
        X.put_all(X.empty_map(), notes).alias("info"),
        F.create_map(F.lit("GT"), F.lit("1/1"), F.lit("DP"), F.lit("1"), F.lit("AO"), F.lit("1")).alias("fmt"),
        F.lit(0).cast("long").alias("rec_no"),
    )
