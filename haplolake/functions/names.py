"""Patterns over file names, headers and accessions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and tokens with a meaning in file names.
COMPRESSION = r"(?i)\.(?:gz|xz|zstd)$"
EXTENSION = r"(?i)\.(?:fq|fastq|fa|fasta|fna|bam|cram|sam|vcf|bcf|gbk|genbank|gff)$"
DIRECTION = r"(?i)(?:_|^)(?:R?[12])(?:(?:[._-][A-Za-z0-9]+)*)$"
PAIR_TOKEN = r"(?i)(?:^|_)(R?[12])(?:_\d+)?(?:[._-][A-Za-z0-9]+)*$"
ONT_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ONT_KEY_VALUE = r"^\w+=\w+"
ALIGNMENT_SUFFIX = r"(?i)\.(?:bam|cram|sam)$"
LONG_PLATFORMS = ("ONT", "OXFORDNANOPORE", "NANOPORE", "PACBIO", "PACBI0")
SHORT_PLATFORMS = ("ILLUMINA", "BGISEQ", "MGISEQ", "DNBSEQ", "SOLID", "LS454")
LONG_PRESETS = ("lr:", "map-ont", "map-pb", "lr:hq")
SHORT_PRESETS = ("sr:", "short-read", "illumina")
ASSEMBLY_ACCESSION = r"^GC[AF]_\d{9}(?:\.\d+)?$"
SAMPLE_ACCESSION = r"^SAM[EDN][A-Z]?[0-9]+$"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    """Text before the last slash; '' when there is none."""
    return F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), r"^[^/]*$", "")


def strip_suffixes(name: Column) -> Column:
    """Remove one compression suffix, then one sequence-file extension."""
    return F.regexp_replace(F.regexp_replace(name, COMPRESSION, ""), EXTENSION, "")


def strip_direction(sample: Column) -> Column:
    return F.regexp_replace(sample, DIRECTION, "")


def mate_of(name: Column) -> Column:
    """``R1``, ``R2`` or NULL."""
    token = F.upper(F.regexp_extract(strip_suffixes(name), PAIR_TOKEN, 1))
    return F.when(token.isin("1", "R1"), "R1").when(token.isin("2", "R2"), "R2")


def is_ont_read_id(header: Column) -> Column:
    """A FASTQ header whose read id is a UUID or begins with key=value."""
    read_id = F.regexp_extract(header, r"^@(\S+)", 1)
    return read_id.rlike(ONT_UUID) | read_id.rlike(ONT_KEY_VALUE)


def accession_kind(text: Column) -> Column:
    return F.when(text.rlike(ASSEMBLY_ACCESSION), "assembly").when(text.rlike(SAMPLE_ACCESSION), "sample")


def reference_format(first_line: Column, path: Column) -> Column:
    """Format from the first line, else from the suffix."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(path, r"(?i)\.gz$", ""), r"(\.[^./]+)$", 1))
    return (
        F.when(F.coalesce(first_line, F.lit("")) == "", F.lit(None))
        .when(first_line.startswith("LOCUS"), "genbank")
        .when(first_line.startswith("ID "), "embl")
        .when(first_line.startswith(">"), "fasta")
        .when(suffix.isin(".fa", ".fna", ".fasta"), "fasta")
        .when(suffix.isin(".gb", ".gbk", ".gbff", ".genbank"), "genbank")
        .when(suffix == ".embl", "embl")
    )
