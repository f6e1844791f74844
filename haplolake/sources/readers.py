"""Genomic text formats as DataFrames (plain or gzip)."""

from __future__ import annotations

import gzip
import io
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplolake.functions import fields as X
from haplolake.functions import names as N

__all__ = [
    "numbered_lines", "peek_contents", "parse_bed", "parse_coords", "parse_coverage", "parse_delta", "parse_fai", "parse_fasta", "parse_fastq", "parse_flagstat",
    "parse_gff", "parse_mpileup", "parse_paf", "parse_sam", "parse_sam_header", "parse_samstats", "parse_vcf", "parse_vcf_header", "read_bed", "read_coords", "read_coverage", "read_delta", "read_depth", "read_fai", "read_fasta", "read_fastq",
    "read_file_list", "read_flagstat", "read_gff", "read_metadata", "read_mpileup", "read_paf", "read_sam", "read_sam_header",
    "read_samples", "read_samstats", "read_vcf", "read_vcf_header", "scan_files",
]

Paths = str | list[str]

_SPLIT_UNIT = 1 << 20  # scan splits are megabytes apart
_ROW_BITS = 33


def _lines(spark: SparkSession, paths: Paths, **options: str) -> DataFrame:
    """Lines with their file and an order key that rises through each file."""
    row = F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)
    start = F.col("_metadata.file_block_start")
    order = F.shiftleft(F.floor(start / _SPLIT_UNIT).cast("long"), _ROW_BITS) + row
    return spark.read.options(**options).text(paths).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), order.alias("rec_no")
    )


def numbered_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Lines with exact 0-based line numbers: split sizes are counted first, then summed per file."""
    start = F.col("_metadata.file_block_start")
    raw = spark.read.text(paths).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), start.alias("_start"), F.monotonically_increasing_id().alias("_id")
    )
    splits = raw.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("file", "_start", "_first", "_before")
    return raw.join(offsets, ["file", "_start"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(N.base_name(path), r"(?i)\.gz$", ""), r"(?i)\.[a-z0-9]+$", "")


# --- VCF -----------------------------------------------------------------------------------


def parse_vcf(lines: DataFrame, sample: str | None = None) -> DataFrame:
    """Variant records, one row per (record, sample); ``sample`` overrides the header's names.

    Rows with fewer than 8 fields or a POS that is no number are dropped; a file
    without sample columns takes its name as the sample.
    """
    head = lines.filter(F.col("value").startswith("#CHROM")).select("file", F.split("value", "\t").alias("_h"))
    names = head.groupBy("file").agg(F.min("_h").alias("_h")).select("file", F.slice("_h", 10, F.greatest(F.size("_h") - 9, F.lit(0))).alias("_names"))
    f = F.col("_f")
    rows = lines.filter(~F.col("value").startswith("#")).withColumn("_f", F.split("value", "\t")).filter((F.size("_f") >= 8) & f[1].try_cast("bigint").isNotNull())
    rows = rows.join(names, "file", "left")
    cells = F.when(F.size(f) > 9, F.slice(f, 10, F.size(f) - 9)).otherwise(F.array(F.lit(".")))
    rows = rows.select("file", "rec_no", "_f", "_names", F.posexplode(cells).alias("_i", "_cell"))
    who = F.coalesce(F.get("_names", F.col("_i")), _stem(F.col("file")))
    if sample is not None:
        who = F.lit(sample)
    return rows.select(
        who.alias("sample"),
        f[0].alias("chrom"),
        f[1].try_cast("bigint").alias("pos"),
        f[2].alias("id"),
        f[3].alias("ref"),
        F.filter(F.split(f[4], ","), lambda a: a != "").alias("alts"),
        X.as_double(f[5]).alias("qual"),
        X.parse_filters(f[6]).alias("filters"),
        X.parse_info(f[7]).alias("info"),
        X.parse_format(F.get(f, F.lit(8)), F.col("_cell")).alias("fmt"),
        "rec_no",
    )


def read_vcf(spark: SparkSession, paths: Paths, sample: str | None = None) -> DataFrame:
    return parse_vcf(_lines(spark, paths), sample)


def parse_vcf_header(lines: DataFrame) -> DataFrame:
    """Header definitions (file, kind, id, number, type, description, length, ord); the first of an id wins."""
    line = F.col("value")

    def part(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))

    rows = lines.filter(line.startswith("##") & line.rlike("^##[A-Za-z]+=<"))
    parsed = rows.select(
        "file",
        F.regexp_extract(line, "^##([A-Za-z]+)=<", 1).alias("kind"),
        part(r"[<,]ID=([^,>]+)").alias("id"),
        part(r"[<,]Number=([^,>]+)").alias("number"),
        part(r"[<,]Type=([^,>]+)").alias("type"),
        F.regexp_replace(part(r'[<,]Description="((?:[^"\\]|\\.)*)"'), r'\\(["\\])', "$1").alias("description"),
        part(r"[<,]length=(\d+)").try_cast("bigint").alias("length"),
        F.col("rec_no").alias("ord"),
    ).filter(F.col("id").isNotNull() & ((F.col("kind") != "contig") | (F.col("length") > 0)))
    first = F.min_by(F.struct("number", "type", "description", "length"), "ord")
    return parsed.groupBy("file", "kind", "id").agg(first.alias("_d"), F.min("ord").alias("ord")).select("file", "kind", "id", "_d.*", "ord")


def read_vcf_header(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_vcf_header(_lines(spark, paths))


def read_file_list(spark: SparkSession, path: str) -> list[str]:
    """Paths of a list file: blank and comment lines skipped, ``~`` expanded."""
    import os

    lines = _lines(spark, path).select(F.trim("value").alias("v"), "rec_no").filter("v <> '' AND NOT startswith(v, '#')").orderBy("rec_no")
    return [os.path.expanduser(r["v"]) for r in lines.toLocalIterator()]


# --- SAM -----------------------------------------------------------------------------------


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment records of SAM text; lines with fewer than 11 fields are dropped."""
    f = F.col("_f")
    rows = lines.filter(~F.col("value").rlike(r"^@[A-Z]{2}(\t|$)")).withColumn("_f", F.split("value", "\t")).filter(F.size("_f") >= 11)
    tags = F.filter(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda t: t.rlike("^..:.:"))
    keys = F.transform(tags, lambda t: F.substring(t, 1, 2))
    values = F.transform(tags, lambda t: F.regexp_replace(t, "^..:.:", ""))
    return rows.select(
        "file",
        f[0].alias("qname"),
        f[1].cast("int").alias("flag"),
        f[2].alias("rname"),
        f[3].cast("bigint").alias("pos"),
        f[4].cast("int").alias("mapq"),
        f[5].alias("cigar"),
        f[6].alias("rnext"),
        f[7].cast("bigint").alias("pnext"),
        f[8].cast("int").alias("tlen"),
        f[9].alias("seq"),
        f[10].alias("qual"),
        X._map_last_wins(keys, values).alias("tags"),
        "rec_no",
    )


def read_sam(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_sam(_lines(spark, paths))


def parse_sam_header(lines: DataFrame) -> DataFrame:
    """Header lines (file, kind, tags MAP, ord), e.g. kind ``SQ`` with tags SN and LN."""
    rows = lines.filter(F.col("value").rlike(r"^@[A-Z]{2}\t"))
    parts = F.filter(F.split("value", "\t"), lambda p: p.rlike("^[A-Za-z][A-Za-z0-9]:"))
    tags = X._map_last_wins(F.transform(parts, lambda p: F.substring(p, 1, 2)), F.transform(parts, lambda p: F.regexp_replace(p, "^..:", "")))
    return rows.select("file", F.substring("value", 2, 2).alias("kind"), tags.alias("tags"), F.col("rec_no").alias("ord"))


def read_sam_header(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_sam_header(_lines(spark, paths))


# --- intervals, features, blocks ---------------------------------------------------------------


def parse_bed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Half-open intervals; bad rows are an error, or dropped unless ``strict``. Empty intervals are dropped."""
    f = F.col("_f")
    rows = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("_f", F.split("value", "\t"))
    start, end = F.get(f, F.lit(1)).try_cast("bigint"), F.get(f, F.lit(2)).try_cast("bigint")
    good = start.isNotNull() & end.isNotNull() & (start >= 0) & (end >= start)
    if strict:
        checked = F.when(F.coalesce(good, F.lit(False)), start).otherwise(F.raise_error(F.concat(F.lit("invalid BED row: "), "value")).cast("bigint"))
    else:
        rows, checked = rows.filter(good), start
    return rows.select(f[0].alias("contig"), checked.alias("start"), end.alias("end"), F.get(f, F.lit(3)).alias("name")).filter(F.col("end") > F.col("start"))


def read_bed(spark: SparkSession, paths: Paths, strict: bool = True) -> DataFrame:
    return parse_bed(_lines(spark, paths), strict)


def parse_gff(lines: DataFrame, feature_type: str | None = None, all_types: bool = False) -> DataFrame:
    """GFF3 features (1-based closed gff_start/gff_end and half-open start/end) of one type: the given or the first seen."""
    f = F.col("_f")
    rows = lines.filter(~F.col("value").startswith("#")).withColumn("_f", F.split("value", "\t")).filter(F.size("_f") == 9)
    a = X.parse_pairs(f[8], flags=False)
    start, end = f[3].try_cast("bigint"), f[4].try_cast("bigint")
    valid = F.coalesce((start >= 1) & (end >= start), F.lit(False))
    first = F.when(valid, start).otherwise(F.raise_error(F.concat(F.lit("invalid GFF interval: "), "value")).cast("bigint"))
    out = rows.select(
        f[0].alias("contig"), f[1].alias("source"), f[2].alias("type"), first.alias("gff_start"), end.alias("gff_end"), (start - 1).alias("start"),
        end.alias("end"), f[5].alias("score"), f[6].alias("strand"), f[7].alias("phase"), a.alias("attributes"), F.col("rec_no").alias("feature_no"),
    )
    if not all_types:
        wanted = F.lit(feature_type) if feature_type is not None else rows.agg(F.min_by(f[2], "rec_no").alias("t")).scalar()
        out = out.filter(F.col("type") == wanted)

    def attr(name: str) -> Column:
        return F.nullif(F.try_element_at("attributes", F.lit(name)), F.lit(""))

    place = F.format_string("%s:%d-%d", "contig", "gff_start", "gff_end")
    return out.withColumn("feature_id", F.coalesce(attr("ID"), attr("Name"), attr("gene"), attr("locus_tag"), place))


def read_gff(spark: SparkSession, paths: Paths, feature_type: str | None = None, all_types: bool = False) -> DataFrame:
    return parse_gff(_lines(spark, paths), feature_type, all_types)


def parse_paf(lines: DataFrame) -> DataFrame:
    """PAF blocks on the target (contig, start, end) with a tags MAP."""
    f = F.col("_f")
    rows = lines.withColumn("_f", F.split("value", "\t")).filter(F.size("_f") >= 12)
    tags = F.filter(F.slice(f, 13, F.greatest(F.size(f) - 12, F.lit(0))), lambda t: t.rlike("^[^:]+:[^:]*:"))
    keys = F.transform(tags, lambda t: F.substring_index(t, ":", 1))
    values = F.transform(tags, lambda t: F.regexp_replace(t, "^[^:]*:[^:]*:", ""))
    number = {"qlen": 1, "qstart": 2, "qend": 3, "tlen": 6, "start": 7, "end": 8, "nmatch": 9, "blen": 10, "mapq": 11}
    return rows.select(
        f[0].alias("qname"), f[4].alias("strand"), f[5].alias("contig"), *[f[i].cast("bigint").alias(n) for n, i in number.items()], X._map_last_wins(keys, values).alias("tags")
    )


def read_paf(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_paf(_lines(spark, paths))


def parse_coords(lines: DataFrame) -> DataFrame:
    """Tab-separated show-coords rows (contig, s1, e1): 13 fields or more, the contig is the last but one."""
    f = F.col("_f")
    rows = lines.withColumn("_f", F.split(F.trim("value"), "\t")).filter(F.size("_f") >= 13)
    return rows.select(F.element_at(f, -2).alias("contig"), f[0].cast("bigint").alias("s1"), f[1].cast("bigint").alias("e1"))


def read_coords(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_coords(_lines(spark, paths))


def parse_delta(text: DataFrame) -> DataFrame:
    """Alignment blocks with their signed offsets; one text record (value) per contig pair, blocks end with ``0``.

    Text before the first pair must name the NUCMER program; an offset of a block
    that continues a run before any indel began is an error in the text.
    """
    text = text.withColumn(
        "value",
        F.when(
            ~F.col("value").rlike(r"^>?\S+ \S+ \d+ \d+\r?\n") & ~F.col("value").rlike(r"^[^\n]*\n\s*NUCMER\s*$"),
            F.raise_error(F.lit("delta text without a NUCMER header")).cast("string"),
        ).otherwise(F.col("value")),
    )
    pair = text.select(F.regexp_replace("value", "\r", "").alias("v")).filter(F.col("v").rlike(r"^\S+ \S+ \d+ \d+\n"))
    head = F.split(F.substring_index("v", "\n", 1), r"\s+")
    body = F.regexp_replace(F.regexp_replace("v", r"^[^\n]*\n", ""), r"\s+$", "")
    blocks = pair.select(head[0].alias("ref"), head[1].alias("qry"), F.explode(F.split(body, r"(?m)\n0$\n?")).alias("b")).filter(F.trim("b") != "")
    lines = F.filter(F.transform(F.split("b", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    blocks = blocks.withColumn("_l", lines).withColumn("_h", F.split(F.col("_l")[0], r"\s+")).filter(F.size("_h") == 7)
    n = F.transform("_h", lambda x: x.try_cast("int"))
    offsets = F.transform(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), lambda x: x.cast("int"))
    starts_inside = F.abs(F.get(offsets, F.lit(0))) == 1
    offsets = F.when(starts_inside, F.raise_error(F.lit("delta block begins with a continued indel")).cast("array<int>")).otherwise(offsets)
    return blocks.select("ref", "qry", n[0].alias("ref_start"), n[1].alias("ref_end"), n[2].alias("qry_start"), n[3].alias("qry_end"), n[4].alias("errors"), offsets.alias("offsets"))


def read_delta(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_delta(spark.read.option("lineSep", "\n>").text(paths))


# --- sequences and reads ----------------------------------------------------------------------


def read_fasta(spark: SparkSession, paths: Paths, upper: bool = False) -> DataFrame:
    row = F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)
    order = F.shiftleft(F.floor(F.col("_metadata.file_block_start") / _SPLIT_UNIT).cast("long"), _ROW_BITS) + row
    return parse_fasta(spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("file"), order.alias("ord")), upper)


def parse_fasta(text: DataFrame, upper: bool = False) -> DataFrame:
    """One row per record (file, contig, description, seq, ord) of texts (value, file, ord); the id is the first word."""
    text = text.select(F.regexp_replace("value", "^>|\r", "").alias("v"), "file", "ord")
    head = F.trim(F.substring_index("v", "\n", 1))
    seq = F.regexp_replace(F.when(F.contains("v", F.lit("\n")), F.regexp_replace("v", r"^[^\n]*\n", "")).otherwise(""), r"\s", "")
    records = text.filter(head != "").select(
        "file", F.substring_index(F.regexp_replace(head, r"\s", " "), " ", 1).alias("contig"), head.alias("description"), (F.upper(seq) if upper else seq).alias("seq"), "ord"
    )
    return records


def parse_fastq(lines: DataFrame, mate: int = 1) -> DataFrame:
    """Reads (file, read_id, mate, seq, qual) of numbered lines, framed by line number, never by the ``@`` sign."""
    lines = lines.withColumn("_no", F.expr("line div 4")).withColumn("_role", F.col("line") % 4)
    role = lambda i: F.max(F.when(F.col("_role") == i, F.col("value")))
    rows = lines.groupBy("file", "_no").agg(role(0).alias("_h"), role(1).alias("seq"), role(3).alias("qual"))
    head = F.regexp_extract("_h", r"^@(\S*)", 1)
    return rows.filter(F.col("_h").startswith("@")).select("file", F.regexp_replace(head, "/[12]$", "").alias("read_id"), F.lit(mate).alias("mate"), "seq", "qual", F.col("_no").alias("ord"))


def read_fastq(spark: SparkSession, r1: Paths, r2: Paths | None = None) -> DataFrame:
    reads = parse_fastq(numbered_lines(spark, r1), 1)
    return reads if r2 is None else reads.unionByName(parse_fastq(numbered_lines(spark, r2), 2))


def parse_fai(lines: DataFrame) -> DataFrame:
    """Contig names and lengths of a FASTA index, in file order; rows without a numeric length are skipped."""
    f = F.split("value", "\t")
    rows = lines.select(f[0].alias("contig"), F.get(f, F.lit(1)).try_cast("bigint").alias("length"), F.col("rec_no").alias("ord"))
    return rows.filter(F.col("length").isNotNull())


def read_fai(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_fai(_lines(spark, paths))


# --- tool tables -------------------------------------------------------------------------------


def read_depth(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.csv(paths, sep="\t", comment="#", schema="contig string, pos bigint, depth bigint", mode="FAILFAST")


def parse_mpileup(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.filter(F.size(f) >= 5).select(f[0].alias("contig"), f[1].cast("bigint").alias("pos"), f[2].alias("ref"), f[4].alias("bases"))


def read_mpileup(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_mpileup(_lines(spark, paths))


# Columns of the coverage table.
_COVERAGE = ("rname", "startpos", "endpos", "numreads", "covbases", "coverage", "meandepth", "meanbaseq", "meanmapq")


def parse_coverage(lines: DataFrame) -> DataFrame:
    """Per-contig coverage, by header names or in the usual column order."""
    lines = lines.filter(F.col("value") != "")
    head = lines.filter(F.col("value").startswith("#")).groupBy("file").agg(F.min("value").alias("_h"))
    named = head.select("file", F.split(F.regexp_replace("_h", "^#+", ""), "\t").alias("_names"))
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).join(named, "file", "left")
    names = F.coalesce("_names", F.array(*[F.lit(c) for c in _COVERAGE]))
    width = F.least(F.size(names), F.size(f))
    cells = F.map_from_arrays(F.slice(names, 1, width), F.slice(f, 1, width))
    rows = rows.select(cells.alias("_c"), "rec_no")
    first = F.coalesce(F.col("_c")["startpos"].try_cast("bigint"), F.lit(1).cast("bigint"))
    return rows.select(
        F.col("_c")["rname"].alias("contig"),
        (F.col("_c")["endpos"].cast("bigint") - first + 1).alias("length"),
        *[F.try_element_at("_c", F.lit(c)).try_cast("double").alias(c) for c in _COVERAGE[3:]],
        F.col("rec_no").alias("ord"),
    )


def read_coverage(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_coverage(_lines(spark, paths))


# Line endings of the flagstat text.
_FLAGSTAT = {
    "total": r"in total", "primary": r"primary$", "secondary": r"secondary$", "supplementary": r"supplementary$", "duplicates": r"duplicates$",
    "mapped": r"mapped \(", "properly_paired": r"properly paired \(",
}


def parse_flagstat(lines: DataFrame) -> DataFrame:
    """One row per file of a samtools flagstat text."""
    line = F.col("value")
    count = F.regexp_extract(line, r"^(\d+) \+ \d+ ", 1).try_cast("bigint")
    rest = F.regexp_replace(line, r"^\d+ \+ \d+ ", "")
    share = F.regexp_extract(line, r"\(([0-9.]+)%", 1).try_cast("double")
    aggs = []
    for name, pattern in _FLAGSTAT.items():
        hit = rest.rlike("^" + pattern)
        aggs.append(F.max(F.when(hit, count)).alias(name))
        if name in ("mapped", "properly_paired"):
            aggs.append(F.max(F.when(hit, share)).alias(f"{name}_percent"))
    return lines.groupBy("file").agg(*aggs)


def read_flagstat(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_flagstat(_lines(spark, paths))


# Labels of the summary numbers.
_SAMSTATS = {
    "reads mapped": "reads_mapped", "reads unmapped": "reads_unmapped", "bases mapped": "bases_mapped", "error rate": "error_rate",
    "average length": "average_length", "average quality": "average_quality", "insert size average": "insert_size_average",
}


def parse_samstats(lines: DataFrame) -> DataFrame:
    """One row per file of the SN section of samtools stats."""
    f = F.split("value", "\t")
    rows = lines.filter(F.col("value").startswith("SN\t") & (F.size(f) >= 3))
    label, value = F.regexp_replace(f[1], ":$", ""), f[2].try_cast("double")
    return rows.groupBy("file").agg(*[F.max(F.when(label == k, value)).alias(n) for k, n in _SAMSTATS.items()])


def read_samstats(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_samstats(_lines(spark, paths))


# --- sample tables -------------------------------------------------------------------------------


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """csv, tsv or json rows; every value is text."""
    if path.endswith(".json"):
        return spark.read.option("primitivesAsString", True).json(path, multiLine=True)
    return spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", multiLine=True)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample sheet: csv, tsv or a json object ``{"samples": {name: {...}}}``; blanks become NULL."""
    if path.endswith(".json"):
        doc = spark.read.text(path, wholetext=True)
        inner = F.coalesce(F.get_json_object("value", "$.samples"), F.col("value"))
        table = F.from_json(inner, "map<string,map<string,string>>")
        rows = doc.select(F.explode(table).alias("sample", "o"))
        keys = sorted({k for r in rows.select(F.map_keys("o").alias("k")).distinct().toLocalIterator() for k in r["k"]})
        out = rows.select("sample", *[F.try_element_at("o", F.lit(k)).alias(k) for k in keys])
    else:
        out = read_metadata(spark, path)
    return out.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in out.columns])


# --- file discovery ------------------------------------------------------------------------------

# Flags of unmapped, and of unmapped, secondary or supplementary records.
_UNMAPPED, _NOT_PRIMARY = 0x4, 0x904

_PEEK = "path string, length bigint, first_line string, header string, median_length int, error string"


def _stream_lines(handle) -> Iterator[bytes]:
    """Lines of a byte stream, read on demand in pieces of 64 KB."""
    parts: list[bytes] = []
    while data := handle.read(1 << 16):
        *ended, rest = data.split(b"\n")
        for line in ended:
            yield b"".join([*parts, line])
            parts = []
        parts.append(rest)
    if any(parts):
        yield b"".join(parts)


def _sam_records(lines: Iterable[bytes]) -> Iterator[tuple[int, bool, int]]:
    """(flag, mapped, bases) of SAM text; a line that is no record counts as unmapped."""
    for line in lines:
        cells = line.rstrip(b"\r").split(b"\t")
        if line.startswith(b"@"):
            continue
        if len(cells) < 6 or not cells[1].isdigit():
            yield _UNMAPPED, False, 0
        else:
            bases = len(cells[9]) if len(cells) >= 11 and cells[9] != b"*" else 0
            yield int(cells[1]), not int(cells[1]) & _UNMAPPED and cells[5] != b"*", bases


def _bam_records(handle) -> Iterator[tuple[int, bool, int]]:
    """(flag, mapped, bases) of BAM records, from where the reference list ends."""
    while len(head := handle.read(24)) == 24:
        size, _, _, _, _, _, operations, flag, bases = struct.unpack("<iiiBBHHHi", head)
        handle.read(size - 20)
        yield flag, not flag & _UNMAPPED and operations > 0, bases


def _bam_header(handle) -> str:
    """Header text of BAM after its magic number; the list of references is skipped."""
    (size,) = struct.unpack("<i", handle.read(4))
    text = handle.read(size).rstrip(b"\0").decode("utf-8", "replace")
    (references,) = struct.unpack("<i", handle.read(4))
    for _ in range(references):
        (size,) = struct.unpack("<i", handle.read(4))
        handle.read(size + 4)
    return text


def _median_of_lead(records: Iterator[tuple[int, bool, int]], n: int) -> int | None:
    """Upper median of bases of the first ``n`` usable records; NULL if the first record of all is unmapped."""
    first = next(records, None)
    if first is None or not first[1]:
        return None
    usable = (bases for flag, _, bases in itertools.chain([first], records) if bases and not flag & _NOT_PRIMARY)
    lengths = sorted(itertools.islice(usable, n))
    return lengths[len(lengths) // 2] if lengths else None


def _peek(handle, aligned: bool, n: int) -> tuple[str | None, str | None, int | None]:
    """(first line, header, median length) from the beginning of an unpacked stream."""
    magic = handle.read(4) if aligned else b""
    if magic == b"BAM\1":
        return None, _bam_header(handle), _median_of_lead(_bam_records(handle), n)
    if magic == b"CRAM":
        raise ValueError("CRAM is not read")
    lines = _stream_lines(_Resumed(magic, handle) if magic else handle)
    first = next(lines, b"")
    text = first.decode("utf-8", "replace").rstrip("\r")
    if not aligned:
        return text, None, None
    header = []
    for line in itertools.chain([first], lines):
        if not line.startswith(b"@"):
            lines = itertools.chain([line], lines)
            break
        header.append(line.decode("utf-8", "replace").rstrip("\r"))
    return text, "\n".join(header), _median_of_lead(_sam_records(lines), n)


class _Resumed:
    """A stream whose first bytes were read already."""

    def __init__(self, seen: bytes, handle) -> None:
        self._seen, self._handle = seen, handle

    def read(self, size: int) -> bytes:
        seen, self._seen = self._seen, b""
        return seen or self._handle.read(size)


class _Whole:
    """Reads until ``size`` bytes are there or the stream ends."""

    def __init__(self, handle) -> None:
        self._handle = handle

    def read(self, size: int) -> bytes:
        parts = []
        while size > 0 and (data := self._handle.read(min(size, 1 << 20))):
            parts.append(data)
            size -= len(data)
        return b"".join(parts)


def _peeks(open_row, n: int):
    """Function for ``mapInPandas``: ``open_row`` gives an unpacked stream for a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        suffix = re.compile(N.ALIGNMENT_SUFFIX)
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                aligned = bool(suffix.search(re.sub(r"(?i)\.gz$", "", row.path)))
                try:
                    with open_row(row) as handle:
                        found.append((row.path, row.length, *_peek(_Whole(handle), aligned, n), None))
                except (OSError, EOFError, ValueError, struct.error) as error:
                    found.append((row.path, row.length, None, None, None, str(error)))
            out = pd.DataFrame(found, columns=["path", "length", "first_line", "header", "median_length", "error"])
            yield out.astype({"median_length": "Int32"})

    return run


def _open_file(row):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(row.path)
    with system.open_input_stream(path, compression=None) as handle:
        zipped = handle.read(2) == b"\x1f\x8b"
    return system.open_input_stream(path, compression="gzip" if zipped else None)


def _open_content(row):
    content = row.content or b""
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def peek_contents(files: DataFrame, n: int = 1000) -> DataFrame:
    """What :func:`scan_files` finds, for files held in a table (path, content)."""
    rows = files.select("path", F.length("content").cast("long").alias("length"), "content")
    return rows.mapInPandas(_peeks(_open_content, n), _PEEK)


def scan_files(
    spark: SparkSession, root: str, max_depth: int = 4, exclude: str | None = None, exclude_files: list[str] | None = None, records: int = 1000
) -> DataFrame:
    """Files below ``root`` (path, length, first_line, header, median_length, error) up to ``max_depth`` folders deep.

    ``exclude`` is a regular expression or a glob on the file name. Contents are
    read up to the first line's end. Of alignments (SAM, plain or gzip, and BAM)
    the header is read and the first records, until ``records`` primary ones with
    bases are found: ``median_length`` is their upper median, NULL if the very
    first record is unmapped. A file that can't be read has an ``error``.
    """
    import fnmatch

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length").filter("length > 0")
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    inside = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rest = F.substr(inside, F.length(base) + 2, F.length(inside))
    files = files.filter(F.size(F.split(rest, "/")) - 1 <= max_depth)
    if exclude:
        try:
            re.compile(exclude)
            pattern = exclude
        except re.error:
            pattern = fnmatch.translate(exclude).replace(r"\z", r"\z").replace(r"\Z", r"\z")
        files = files.filter(~N.base_name(F.col("path")).rlike(pattern))
    if exclude_files:
        files = files.filter(~inside.isin(*exclude_files))
    return files.mapInPandas(_peeks(_open_file, records), _PEEK)
