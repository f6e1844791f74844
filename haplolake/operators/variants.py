"""Variant records: predicates, soft filters, splitting, context, deletions.

Columns: sample, chrom, pos (1-based), id, ref, alts ARRAY, qual, filters ARRAY,
info MAP, fmt MAP, rec_no. The sample is a column; a cohort is one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.functions import alleles as A
from haplolake.functions import fields as X
from haplolake.operators.intervals import overlaps_any, merge_intervals, overlap_join
from haplolake.operators.scan import BIN, Run, running
from haplolake.session import stage

# INFO/FORMAT keys with one entry per ALT, or per allele.
PER_ALT_KEYS = ("AO", "AF", "QA", "TYPE", "PAO", "LEN", "CIGAR")
PER_ALLELE_KEYS = ("AD",)

MIN_QUAL_SHORT, MIN_DEPTH_SHORT = 100.0, 10
MIN_QUAL_ASSEMBLY, MIN_DEPTH_ASSEMBLY = 60.0, 1
MAX_INDEL_LONG = 10000

_BIG = 1 << 40


def _info(key: str) -> Column:
    return F.try_element_at(F.col("info"), F.lit(key))


def _fmt(key: str) -> Column:
    return F.try_element_at(F.col("fmt"), F.lit(key))


def has_alt_gt(v: DataFrame) -> DataFrame:
    return v.filter(X.has_alt(_fmt("GT")))


def split_multiallelic(
    v: DataFrame, per_alt: tuple[str, ...] = PER_ALT_KEYS, per_allele: tuple[str, ...] = PER_ALLELE_KEYS
) -> DataFrame:
    """One row per ALT; per-ALT and per-allele lists are sliced, other ALT indexes of GT become 0."""
    n = F.size("alts")
    parted = v.withColumn("_n", n).select("*", F.posexplode("alts").alias("_i", "_alt"))

    def sliced(entries: Column) -> Column:
        def one(k: Column, value: Column) -> Column:
            parts = F.split(value, ",")
            alt = F.when(F.size(parts) == F.col("_n"), F.get(parts, F.col("_i"))).otherwise(value)
            pair = F.concat_ws(",", F.get(parts, F.lit(0)), F.get(parts, F.col("_i") + F.lit(1)))
            allele = F.when(F.size(parts) == F.col("_n") + 1, pair).otherwise(value)
            return F.when(k.isin(*per_alt), alt).when(k.isin(*per_allele), allele).otherwise(value)

        return F.transform_values(entries, one)

    gt = _fmt("GT")
    index = (F.col("_i") + 1).cast("string")
    codes = F.transform(
        F.split(gt, r"[/|]"), lambda a: F.when(a == index, "1").when(a.rlike(r"^\d+$"), "0").otherwise(a)
    )
    recoded = F.when(F.contains(gt, F.lit("|")), F.array_join(codes, "|")).otherwise(F.array_join(codes, "/"))
    fmt = sliced(F.col("fmt"))
    split = parted.select(
        *[F.col(c) for c in v.columns if c not in ("alts", "info", "fmt")],
        F.array("_alt").alias("alts"),
        F.when(F.col("_n") > 1, sliced(F.col("info"))).otherwise(F.col("info")).alias("info"),
        F.when(F.col("_n") > 1, F.when(gt.isNull(), fmt).otherwise(X.put(fmt, "GT", recoded)))
        .otherwise(F.col("fmt"))
        .alias("fmt"),
    )
    return split.select(*v.columns)


def retype(v: DataFrame, dialect: str = "tags") -> DataFrame:
    """Rewrite INFO TYPE from the alleles."""
    types = F.transform("alts", lambda a: A.infer_type(F.col("ref"), a, dialect))
    return v.withColumn("info", X.put(F.col("info"), "TYPE", F.array_join(types, ",")))


def drop_unobserved(v: DataFrame, max_indel: int | None = None) -> DataFrame:
    """Drop ``*`` alleles and, when asked, indels longer than ``max_indel``."""
    kept = v.filter(~F.array_contains("alts", "*"))
    if max_indel is None:
        return kept
    long = F.exists("alts", lambda a: ~a.startswith("<") & (F.abs(F.length(a) - F.length("ref")) > max_indel))
    return kept.filter(~long)


def soft_filter(v: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Append the label of every rule that holds; NULL never fails, no label is PASS."""
    labels = X.compact(*[F.when(cond, F.lit(label)) for label, cond in rules])
    marked = X.add_labels(F.col("filters"), labels)
    return v.withColumn("filters", F.when(F.size(marked) == 0, F.array(F.lit("PASS"))).otherwise(marked))


def low_qual(minimum: float) -> tuple[str, Column]:
    return "LowQual", F.col("qual") < minimum


def low_depth(minimum: int) -> tuple[str, Column]:
    return "LowDepth", X.as_double(_fmt("DP")) < minimum


def mixed_site() -> tuple[str, Column]:
    return "MixedSite", _fmt("GT").isin(*X.HET_GENOTYPES)


def short_read_filters(v: DataFrame, min_qual: float = MIN_QUAL_SHORT, min_depth: int = MIN_DEPTH_SHORT) -> DataFrame:
    return soft_filter(v, [low_qual(min_qual), low_depth(min_depth), mixed_site()])


def assembly_filters(v: DataFrame) -> DataFrame:
    return short_read_filters(v, MIN_QUAL_ASSEMBLY, MIN_DEPTH_ASSEMBLY)


def long_read_filters(v: DataFrame, min_qual: float | None = None, min_depth: int = MIN_DEPTH_SHORT) -> DataFrame:
    last = [low_qual(min_qual)] if min_qual is not None else []
    return soft_filter(drop_unobserved(v, MAX_INDEL_LONG), [low_depth(min_depth), mixed_site(), *last])


def pass_only(v: DataFrame, no_insertions: bool = False) -> DataFrame:
    """PASS among the labels (``PASS;ZERODEPTH`` counts); optionally without insertions."""
    kept = v.filter(F.array_contains("filters", "PASS"))
    if not no_insertions:
        return kept
    return kept.filter(F.exists("alts", lambda a: (F.length(a) <= F.length("ref")) | (a == "<DEL>")))


def collapse_gt(v: DataFrame) -> DataFrame:
    gt = _fmt("GT")
    return v.withColumn("fmt", F.when(gt.isNull(), F.col("fmt")).otherwise(X.put(F.col("fmt"), "GT", X.collapse_genotype(gt))))


def with_sample(v: DataFrame, name: str) -> DataFrame:
    return v.withColumn("sample", F.lit(name))


def report_scope(v: DataFrame, scope: str = "all") -> DataFrame:
    if scope not in ("all", "pass"):
        raise ValueError(f"unknown scope {scope!r}")
    return v if scope == "all" else v.filter(X.is_exact_pass(F.col("filters")))


CONSEQUENCE_FIELDS = ("consequence", "gene", "transcript", "biotype", "strand", "amino_acid_change", "dna_change")


def consequence_fields(bcsq: Column) -> list[Column]:
    """The seven parts of the first usable annotation; '' where absent."""
    usable = F.filter(F.split(F.coalesce(bcsq, F.lit("")), ","), lambda a: ~a.isin("", ".") & ~a.startswith("@"))
    parts = F.split(F.get(usable, F.lit(0)), r"\|")
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(CONSEQUENCE_FIELDS)]


def variants_tab(v: DataFrame) -> DataFrame:
    """Flat table of the records that are not symbolic deletions."""
    alt = F.array_join("alts", ",")
    return v.filter(alt != "<DEL>").select(
        "sample",
        "chrom",
        "pos",
        F.coalesce(_info("TYPE"), F.lit(".")).alias("type"),
        "ref",
        alt.alias("alt"),
        *consequence_fields(_info("BCSQ")),
    )


# --- local context -----------------------------------------------------------------


def local_snp_density(points: DataFrame, keys: list[str], window: int, count: str = "n_snp", on: str = "pos") -> DataFrame:
    """Sum of ``count`` within ``window`` bases either side, on rows unique per (keys, on).

    Rows within reach of a neighbouring bin are copied into it, so every bin is
    self-contained.
    """
    size = max(BIN, 4 * window)

    def cell(x: Column) -> Column:
        return F.floor(x / F.lit(size)).cast("long")

    haloed = points.withColumn("_home", cell(F.col(on))).withColumn(
        "_bin", F.explode(F.sequence(cell(F.col(on) - window), cell(F.col(on) + window)))
    )
    frame = Window.partitionBy(*keys, "_bin").orderBy(F.col(on).cast("long")).rangeBetween(-window, window)
    return (
        haloed.withColumn("local_snps", F.sum(count).over(frame))
        .filter(F.col("_bin") == F.col("_home"))
        .drop("_bin", "_home")
    )


def position_summary(v: DataFrame, keys: list[str]) -> DataFrame:
    """SNP count and indel presence per position."""
    snp = A.is_snp(F.col("ref"), F.col("alts"))
    return v.groupBy(*keys, "pos").agg(
        F.sum(snp.cast("long")).alias("n_snp"),
        F.max(F.when(~snp & A.is_indel(F.col("ref"), F.col("alts")), F.col("pos").cast("long"))).alias("indel_pos"),
    )


def indel_distance(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of each position to the nearest indel of its key."""
    seen = running(
        points,
        keys,
        "pos",
        [Run("_before", "near", F.col("indel_pos")), Run("_after", "near", F.col("indel_pos"), backwards=True)],
    )
    gap = F.least(F.col("pos") - F.col("_before"), F.col("_after") - F.col("pos"))
    return seen.withColumn("indel_dist", gap.cast("long")).drop("_before", "_after")


def context_filter(
    v: DataFrame,
    max_local_snps: int = 0,
    local_snp_window: int = 0,
    min_snp_distance_to_indel: int = 0,
    min_snp_distance_to_breakpoint: int = 0,
    keys: tuple[str, ...] = ("sample", "chrom"),
) -> DataFrame:
    """Label SNPs LowQual by local context; 0 switches a rule off."""
    dense = max_local_snps > 0 and local_snp_window > 0
    near = min_snp_distance_to_indel > 0
    edge = min_snp_distance_to_breakpoint > 0
    if not (dense or near or edge):
        return v
    by = list(keys)
    out = v
    if dense or near:
        points = stage(position_summary(v, by))
        if near:
            points = indel_distance(points, by)
        if dense:
            points = local_snp_density(points, by, local_snp_window)
        out = out.join(points.drop("n_snp", "indel_pos"), [*by, "pos"], "left")
    snp = A.is_snp(F.col("ref"), F.col("alts"))
    reasons, notes = [], {}
    if edge:
        reasons.append(F.when(X.edge_distance(F.col("info")) < min_snp_distance_to_breakpoint, "NEAR_ALIGNMENT_EDGE"))
    if near:
        reasons.append(F.when(F.col("indel_dist") < min_snp_distance_to_indel, "NEAR_INDEL"))
        notes["CONTEXT_INDEL_DIST"] = F.col("indel_dist")
    if dense:
        reasons.append(F.when(F.col("local_snps") > max_local_snps, "LOCAL_SNP_CLUSTER"))
        notes["CONTEXT_LOCAL_SNPS"] = F.col("local_snps")
    found = F.when(snp, X.compact(*reasons)).otherwise(F.array().cast("array<string>"))
    info = X.put_all(F.col("info"), notes) if notes else F.col("info")
    return (
        out.withColumn("_reasons", found)
        .withColumn("info", F.when(snp, X.add_reasons(info, "CONTEXT_LOWQUAL_REASON", F.col("_reasons"))).otherwise(F.col("info")))
        .withColumn(
            "filters",
            X.add_labels(F.col("filters"), F.when(F.size("_reasons") > 0, F.array(F.lit("LowQual"))).otherwise(F.col("_reasons"))),
        )
        .select(*v.columns)
    )


# --- deletions from uncovered reference ---------------------------------------------


def _end_of_deletion() -> Column:
    symbolic = F.array_contains("alts", "<DEL>") | F.coalesce(_info("SVTYPE") == "DEL", F.lit(False))
    return F.when(symbolic, _info("END").try_cast("long"))


def occupied(v: DataFrame, keys: tuple[str, ...] = ("sample", "chrom")) -> DataFrame:
    """Closed interval [start, end] of reference touched by each record."""
    last = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    return v.select(*keys, F.col("pos").alias("start"), F.greatest(last, _end_of_deletion()).alias("end"))


def deletion_keys(v: DataFrame, keys: tuple[str, ...] = ("sample", "chrom")) -> DataFrame:
    """(pos, end) of deletions already called, symbolic or spelled out."""
    plain = F.filter(
        "alts",
        lambda a: ~a.isin("", ".", "*") & ~a.rlike(r"^<.*>$") & ~a.rlike(r"[\[\]]") & ~F.col("ref").isin("", "."),
    )
    shown = F.transform(plain, lambda a: F.when(a == "-", F.lit("")).otherwise(a))
    shrunk = F.filter(shown, lambda a: (F.length("ref") > F.length(a)) & F.startswith(F.col("ref"), a))
    ends = F.transform(shrunk, lambda a: (F.col("pos") + F.length("ref") - F.length(a)).cast("long"))
    every = F.array_distinct(F.concat(ends, X.compact(_end_of_deletion())))
    return v.select(*keys, "pos", F.explode(every).alias("end")).distinct()


def new_deletions(candidates: DataFrame, v: DataFrame, keys: tuple[str, ...] = ("sample", "chrom")) -> DataFrame:
    """Candidates (pos, end) without an identical deletion in ``v``."""
    return candidates.join(deletion_keys(v, keys), [*keys, "pos", "end"], "left_anti")


def add_deletions(
    v: DataFrame, zero: DataFrame, seqs: DataFrame, contigs: DataFrame, merged: bool = False
) -> DataFrame:
    """Append a deletion for every uncovered interval that touches no record.

    ``zero`` holds (sample, contig, start, end); say ``merged`` if it already is. Merged intervals never touch each
    other, so one anti join against the records decides them all; it also covers
    records that spell the same deletion, because those start at its anchor.
    Reference text is fetched last, in blocks, and only for what is left and starts its contig;
    a missing sequence is an error there. ``seqs`` holds (contig, seq), or (contig, block, seq) in blocks of ``CHUNK`` bases.
    """
    from haplolake.operators.sequences import fetch

    gaps = (zero if merged else merge_intervals(zero, ["sample", "contig"])).join(contigs.select("contig", "length", "ord"), "contig", "left")
    leads = F.col("start") == 0
    spans = gaps.select(
        "sample",
        F.col("contig").alias("chrom"),
        "length",
        "ord",
        F.col("start").alias("_start"),
        F.when(leads, F.lit(1)).otherwise(F.col("start")).cast("long").alias("pos"),
        F.when(leads, F.least("end", "length")).otherwise(F.col("end")).alias("_end"),
        F.when(F.col("end") >= F.col("length"), F.col("length")).otherwise(F.col("end") + 1).alias("_need"),
    )
    spans = stage(spans).withColumn("start", F.col("pos")).withColumn("end", F.col("_end"))
    free = overlap_join(spans, occupied(v), ["sample", "chrom"], "left_anti", closed=True)
    ranked = free.withColumn("_at", F.shiftleft(F.coalesce("ord", F.lit((1 << 26) - 1)).cast("long"), 36) + F.col("pos"))
    numbered = running(ranked, ["sample"], "_at", [Run("_no", "sum", F.lit(1).cast("long"))])
    numbered = stage(numbered.select("sample", "chrom", "pos", "_start", "_end", "_need", "_no"))
    texts = seqs.filter(F.col("seq").isNotNull()).withColumnRenamed("contig", "chrom")
    texts = texts.select(*[c for c in ("chrom", "block", "seq") if c in texts.columns])
    lead = fetch(numbered.filter(F.col("_start") == 0), texts, ["chrom"], F.lit(0), F.col("_need"), "ref")
    inner = numbered.filter(F.col("_start") > 0)
    numbered = inner.withColumns({"ref": F.lit("N"), "alt": F.lit("<DEL>")}).unionByName(lead.withColumns({"ref": F.upper("ref"), "alt": F.lit("-")}))
    info = F.create_map(
        *[
            x
            for k, value in (
                ("TYPE", F.lit("INDEL")),
                ("ZERODEPTH", F.lit("")),
                ("SVTYPE", F.lit("DEL")),
                ("END", F.col("_end").cast("string")),
                ("SVLEN", F.when(F.col("_start") == 0, -F.col("_end")).otherwise(F.col("pos") - F.col("_end")).cast("string")),
            )
            for x in (F.lit(k), value)
        ]
    )
    rows = numbered.select(
        "sample",
        "chrom",
        F.col("pos").cast(v.schema["pos"].dataType).alias("pos"),
        F.concat(F.lit("DEL_"), F.col("_no").cast("string")).alias("id"),
        "ref",
        F.array("alt").alias("alts"),
        F.lit(None).cast("double").alias("qual"),
        F.array(F.lit("PASS"), F.lit("ZERODEPTH")).alias("filters"),
        info.alias("info"),
        F.create_map(F.lit("GT"), F.lit("1/1")).alias("fmt"),
        (F.lit(_BIG) + F.col("_no")).alias("rec_no"),
    )
    return v.unionByName(rows)


def mixed_sites(v: DataFrame, any_label: bool = False) -> DataFrame:
    """Merged reference intervals of records labelled MixedSite (alone, unless ``any_label``)."""
    hit = F.array_contains("filters", "MixedSite")
    if not any_label:
        hit = hit & (F.size("filters") == 1)
    spans = v.filter(hit).select(
        "sample",
        F.col("chrom").alias("contig"),
        (F.col("pos") - 1).cast("long").alias("start"),
        (F.col("pos") - 1 + F.length("ref")).cast("long").alias("end"),
    )
    return merge_intervals(spans, ["sample", "contig"])


def sort_variants(v: DataFrame, contigs: DataFrame) -> DataFrame:
    """Contig rank, unknown contigs last by name, then position and input order."""
    ranks = contigs.select(F.col("contig").alias("chrom"), F.col("ord").alias("_ord"))
    return (
        v.join(ranks, "chrom", "left")
        .orderBy(F.col("_ord").asc_nulls_last(), F.when(F.col("_ord").isNull(), F.col("chrom")), "pos", "rec_no")
        .select(*v.columns)
    )


# --- call sets -----------------------------------------------------------------------


def variant_keys(v: DataFrame, *extra: str) -> DataFrame:
    """Distinct (chrom, pos, ref, alt), one per ALT; ``.`` and ``*`` are not alleles."""
    return (
        v.select(*extra, "chrom", "pos", "ref", F.explode("alts").alias("alt"))
        .filter(~F.col("alt").isin(".", "*"))
        .distinct()
    )


def callset_ops(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """``union``, ``intersect`` or ``except`` of the variant keys of two call sets."""
    left, right = variant_keys(a), variant_keys(b)
    if op == "union":
        return left.union(right).distinct()
    if op == "intersect":
        return left.intersect(right)
    if op == "except":
        return left.subtract(right)
    raise ValueError(f"unknown set operation {op!r}")


# Sets in one LONG of a membership bitmap.
WORD = 62


def upset(v: DataFrame, names: list[str], by: str = "source", max_intersections: int | None = 40) -> DataFrame:
    """How many variants each combination of call sets shares (1/0 vector in ``names`` order)."""
    rows = v.select(F.col(by).alias("_name"), "chrom", "pos", "ref", F.explode("alts").alias("alt")).filter(~F.col("alt").isin(".", "*"))
    return _intersections(rows, names, ["chrom", "pos", "ref", "alt"], max_intersections)


def upset_from_genotypes(v: DataFrame, names: list[str], max_intersections: int | None = 40) -> DataFrame:
    """The same from a merged call set with one row per (record, sample), by genotype."""
    name = F.when(X.has_alt(_fmt("GT")), F.col("sample"))
    return _intersections(v.select("rec_no", name.alias("_name")), names, ["rec_no"], max_intersections)


def _intersections(rows: DataFrame, names: list[str], key: list[str], top: int | None) -> DataFrame:
    """Counts of memberships of the keys in the sets ``_name``.

    A key's membership is a bitmap of one LONG per ``WORD`` sets, so repeated
    rows need not be removed first; it is written out for the combinations alone.
    """
    numbers = rows.sparkSession.createDataFrame(list(enumerate(names)), "_i int, _name string")
    placed = rows.join(numbers, "_name", "left").withColumn("_bit", F.expr(f"shiftleft(1L, _i % {WORD})"))
    width = max(1, -(-len(names) // WORD))
    words = [f"_w{w}" for w in range(width)]
    one = lambda w: F.bit_or(F.when(F.expr(f"_i div {WORD} = {w}"), F.col("_bit")))
    held = placed.groupBy(*key).agg(*[F.coalesce(one(w), F.lit(0).cast("long")).alias(n) for w, n in enumerate(words)])
    shown = F.concat(*[F.reverse(F.lpad(F.bin(n), WORD, "0")) for n in words])
    counts = held.groupBy(*words).agg(F.count("*").alias("n")).select(F.substring(shown, 1, len(names)).alias("membership"), "n")
    return counts if top is None else counts.orderBy(F.desc("n"), "membership").limit(top)


def set_sizes(v: DataFrame, by: str = "source") -> DataFrame:
    return variant_keys(v, by).groupBy(by).agg(F.count("*").alias("n"))


def unique_names(files: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Second and later uses of a name become ``name (2)``, ``name (3)``..."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    label = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.format_string("%s (%d)", F.col(name), F.col("_n")))
    return files.withColumn("_n", nth).withColumn("label", label).drop("_n")


def merge_callsets(v: DataFrame, names: list[str], by: str = "source", missing: str = "./.") -> DataFrame:
    """Full outer merge on (chrom, pos, ref, alt): one genotype column per call set."""
    rows = v.select(by, "chrom", "pos", "ref", F.explode("alts").alias("alt"), _fmt("GT").alias("_gt"))
    return rows.groupBy("chrom", "pos", "ref", "alt").agg(
        *[F.coalesce(F.min(F.when(F.col(by) == n, F.col("_gt"))), F.lit(missing)).alias(n) for n in names]
    )


def merged_genotypes(v: DataFrame, by: str = "source") -> DataFrame:
    """The same merge in long form: ``genotypes``, an array of (name, gt) by name of the call sets that have the variant.

    Its width doesn't depend on the number of call sets. The smallest genotype
    stands for a call set that lists a variant more than once.
    """
    rows = v.select(F.col(by).alias("name"), "chrom", "pos", "ref", F.explode("alts").alias("alt"), _fmt("GT").alias("gt"))
    one = rows.groupBy("chrom", "pos", "ref", "alt", "name").agg(F.min("gt").alias("gt"))
    return one.groupBy("chrom", "pos", "ref", "alt").agg(F.sort_array(F.collect_list(F.struct("name", "gt"))).alias("genotypes"))


def compare_truth(called: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("sample",), regions: DataFrame | None = None) -> DataFrame:
    """Counts of found, missed and extra alleles per sample, after trimming shared bases.

    With ``regions`` (contig, start, end; 0-based) these are the alleles whose
    trimmed position lies in one of them, and ``found_outside``,
    ``missed_outside`` and ``extra_outside`` count the others.
    """

    def trimmed(v: DataFrame, mark: str) -> DataFrame:
        t = v.select(*keys, "chrom", "pos", "ref", F.explode("alts").alias("alt"))
        t = t.withColumn("_t", A.trimmed(F.col("ref"), F.col("alt")))
        return t.select(
            *keys, "chrom", (F.col("pos") + F.col("_t.skip")).alias("pos"), F.col("_t.ref").alias("ref"), F.col("_t.alt").alias("alt"), F.lit(1).alias(mark)
        )

    both = trimmed(called, "called").unionByName(trimmed(truth, "truth"), allowMissingColumns=True)
    cells = both.groupBy(*keys, "chrom", "pos", "ref", "alt").agg(
        F.max(F.coalesce("called", F.lit(0))).alias("called"), F.max(F.coalesce("truth", F.lit(0))).alias("truth")
    )
    hit, called_, truth_ = F.lit(True), F.col("called"), F.col("truth")
    if regions is not None:
        placed = cells.withColumnRenamed("chrom", "contig").withColumns({"start": F.col("pos").cast("long") - 1, "end": F.col("pos").cast("long")})
        cells, hit = overlaps_any(placed, regions), F.col("_hit")
    kinds = {"found": called_ * truth_, "missed": truth_ * (1 - called_), "extra": called_ * (1 - truth_)}
    sides = {"": hit, **({"_outside": ~hit} if regions is not None else {})}
    return cells.groupBy(*keys).agg(*[F.sum(F.when(on, n).otherwise(0)).alias(kind + side) for side, on in sides.items() for kind, n in kinds.items()])
