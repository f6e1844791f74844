"""Sample discovery: from file names and first lines to a sample sheet.

Files: path, first_line, and for alignments header (text) and median_length, as ``scan_files`` finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.functions import names as N

LONG_READ = 1000


def classify_files(files: DataFrame) -> DataFrame:
    """Add ``kind`` (ASM, ONT, ILL or NULL) and ``is_alignment``."""
    first = F.coalesce("first_line", F.lit(""))
    aligned = N.base_name(F.col("path")).rlike(N.ALIGNMENT_SUFFIX) | F.lower("path").endswith(".sam.gz")
    header = F.coalesce(F.col("header"), F.lit("")) if "header" in files.columns else F.lit("")
    length = F.col("median_length") if "median_length" in files.columns else F.lit(None).cast("int")
    platforms = F.transform(
        F.regexp_extract_all(header, F.lit(r"(?im)^@RG[^\n]*?\tPL:([^\t\n\r]+)"), F.lit(1)), F.upper
    )

    def names(any_of: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for word in any_of:
            found = found | F.contains(F.lower(header), F.lit(word))
        return found

    def platform(any_of: tuple[str, ...]) -> Column:
        return F.exists(platforms, lambda p: p.isin(*any_of))

    by_header = (
        F.when(names(N.LONG_PRESETS), "ONT").when(names(N.SHORT_PRESETS), "ILL").when(platform(N.LONG_PLATFORMS), "ONT").when(platform(N.SHORT_PLATFORMS), "ILL")
    )
    by_length = F.when(length >= LONG_READ, "ONT").when(length.isNotNull(), "ILL")
    kind = F.when(aligned, F.coalesce(by_header, by_length)).when(first.startswith(">"), "ASM").when(
        first.rlike(r"^@\S"), F.when(N.is_ont_read_id(first), "ONT").otherwise("ILL")
    )
    return files.withColumn("kind", kind).withColumn("is_alignment", aligned)


def peek_median_length(a: DataFrame, n: int = 1000, key: str = "file", order: str = "rec_no") -> DataFrame:
    """Upper median length of the first ``n`` usable primary records of each file.

    Lengths of the leading records are kept by a bounded top-n per file.
    """
    usable = a.filter((F.col("flag").bitwiseAND(0x904) == 0) & (F.col("seq") != "*"))
    first = Window.partitionBy(key).orderBy(order)
    lead = usable.select(key, order, F.length("seq").alias("_len")).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n)
    lengths = F.sort_array(F.collect_list("_len"))
    return lead.groupBy(key).agg(lengths.alias("_l")).select(key, F.get("_l", F.floor(F.size("_l") / 2).cast("int")).alias("median_length"))


def with_sample_ids(files: DataFrame) -> DataFrame:
    """Add ``sample``: file name without suffixes, or the folder name if nothing is left."""
    name = N.strip_suffixes(N.base_name(F.col("path")))
    folder = N.base_name(N.parent_name(F.col("path")))
    return files.filter(F.col("kind").isNotNull()).withColumn("sample", F.when(name == "", folder).otherwise(name))


def pair_reads(files: DataFrame) -> DataFrame:
    """Give both files of an R1/R2 pair in one folder their common id."""
    parent = N.parent_name(F.col("path"))
    bare = N.strip_direction(F.col("sample"))
    base = F.when(bare == "", N.base_name(parent)).otherwise(bare)
    mate = F.when(F.col("kind") == "ILL", N.mate_of(N.base_name(F.col("path"))))
    marked = files.withColumn("_parent", parent).withColumn("_base", base).withColumn("_mate", mate)
    pairs = (
        marked.filter(F.col("kind") == "ILL")
        .groupBy("_parent", "_base")
        .agg(F.sum((F.col("_mate") == "R1").cast("int")).alias("_n1"), F.sum((F.col("_mate") == "R2").cast("int")).alias("_n2"))
    )
    joined = marked.join(pairs, ["_parent", "_base"], "left")
    clash = (F.col("_n1") > 1) | (F.col("_n2") > 1)
    checked = F.when(clash & F.col("_mate").isNotNull(), F.raise_error(F.concat(F.lit("several read files for "), "_base")).cast("string"))
    both = (F.col("_n1") == 1) & (F.col("_n2") == 1) & F.col("_mate").isNotNull()
    sample = F.coalesce(checked, F.when(both, F.col("_base")).otherwise(F.col("sample")))
    return joined.withColumn("sample", sample).select(*files.columns)


def _parents(files: DataFrame) -> DataFrame:
    """Label of each folder of a sample: its path below the common folder of all of them."""
    folders = files.select("sample", N.parent_name(F.col("path")).alias("_parent")).distinct()
    parts = F.split("_parent", "/")
    ends = folders.groupBy("sample").agg(F.min("_parent").alias("_a"), F.max("_parent").alias("_z"), F.count("*").alias("_folders"))
    # the common prefix of a sorted set is that of its first and last element
    a, z = F.split("_a", "/"), F.split("_z", "/")
    shared = F.aggregate(
        F.sequence(F.lit(0), F.least(F.size(a), F.size(z)) - 1),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct(
            (s["n"] + (s["on"] & (F.get(a, i) == F.get(z, i))).cast("int")).alias("n"), (s["on"] & (F.get(a, i) == F.get(z, i))).alias("on")
        ),
    )["n"]
    ends = ends.withColumn("_shared", shared)
    rest = F.slice(parts, F.col("_shared") + 1, F.greatest(F.size(parts) - F.col("_shared"), F.lit(0)))
    label = F.when(F.size(rest) == 0, N.base_name(F.col("_parent"))).otherwise(F.array_join(rest, "-"))
    return folders.join(ends.select("sample", "_folders", "_shared"), "sample").select("sample", "_parent", "_folders", label.alias("_label"))


def resolve_sample_ids(files: DataFrame) -> DataFrame:
    """Make ids unique: by folder label, or by file name when a folder has several files that are no read pair."""
    parent = N.parent_name(F.col("path"))
    groups = files.withColumn("_parent", parent)
    sizes = groups.groupBy("sample", "_parent").agg(F.count("*").alias("_n"), F.sum((F.col("kind") != "ILL").cast("int")).alias("_other"))
    joined = groups.join(sizes, ["sample", "_parent"]).join(_parents(files), ["sample", "_parent"])
    by_name = (F.col("_n") > 1) & (F.col("_other") > 0)
    label = F.col("_label")
    plain = (label == F.col("sample")) | F.endswith(label, F.concat(F.lit("-"), F.col("sample")))
    qualified = F.when(plain, label).otherwise(F.concat(label, F.lit("-"), F.col("sample")))
    sample = F.when(by_name, N.base_name(F.col("path"))).when(F.col("_folders") > 1, qualified).otherwise(F.col("sample"))
    return joined.withColumn("sample", sample).select(*files.columns)


def build_sample_sheet(files: DataFrame) -> DataFrame:
    """One row per sample: type, left, right, reads, bam, assembly; ``error`` tells what is wrong."""
    path = F.col("path")
    mate = N.mate_of(N.base_name(path))
    g = files.groupBy("sample").agg(
        F.count("*").alias("_n"),
        F.countDistinct("kind").alias("_kinds"),
        F.min("kind").alias("_kind"),
        F.sum(F.col("is_alignment").cast("int")).alias("_bams"),
        F.min(F.when(mate == "R1", path)).alias("_r1"),
        F.min(F.when(mate == "R2", path)).alias("_r2"),
        F.sum((mate == "R1").cast("int")).alias("_n1"),
        F.sum((mate == "R2").cast("int")).alias("_n2"),
        F.min("path").alias("_lo"),
        F.max("path").alias("_hi"),
    )
    ill, one = F.col("_kind") == "ILL", F.col("_n") == 1
    bam = F.when((F.col("_bams") > 0) & one, F.col("_lo"))
    both = F.col("_r1").isNotNull() & F.col("_r2").isNotNull()
    error = (
        F.when(F.col("_kinds") > 1, "several kinds of file")
        .when((F.col("_bams") > 0) & ~one, "several files with an alignment")
        .when(ill & ((F.col("_n1") > 1) | (F.col("_n2") > 1)), "several files for one mate")
        .when(ill & ~both & (F.col("_n") > 2), "needs two read files")
        .when(~ill & ~one, "several files")
    )
    reads = bam.isNull()
    kind = F.when(ill, "short").when(F.col("_kind") == "ONT", "long").otherwise("asm")
    return g.select(
        "sample",
        kind.alias("type"),
        F.when(ill & reads, F.when(both, F.col("_r1")).otherwise(F.col("_lo"))).alias("left"),
        F.when(ill & reads & ~one, F.when(both, F.col("_r2")).otherwise(F.col("_hi"))).alias("right"),
        F.when((F.col("_kind") == "ONT") & reads, F.col("_lo")).alias("reads"),
        bam.alias("bam"),
        F.when(F.col("_kind") == "ASM", F.col("_lo")).alias("assembly"),
        error.alias("error"),
    )


def apply_defaults(samples: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill missing or NULL options only."""
    out = samples
    for key, value in defaults.items():
        out = out.withColumn(key, F.coalesce(F.col(key), F.lit(value)) if key in out.columns else F.lit(value))
    return out


def sample_type_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("type").agg(F.count("*").alias("n"))
