"""Tables back to text formats. Parquet is the native form; these are exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions import fields as X
from haplolake.functions.numbers import human_size
from haplolake.operators.intervals import merge_intervals

__all__ = [
    "bed_lines", "fasta_lines", "file_manifest", "phylip_lines", "report_json", "report_lines", "tsv_cells", "vcf_lines", "write_bed", "write_fasta", "write_phylip",
    "write_tsv", "write_vcf",
]

# Definitions written when the header lacks them.
DEFINITIONS = {
    ("ALT", "DEL"): '##ALT=<ID=DEL,Description="Deletion">',
    ("FILTER", "LowQual"): '##FILTER=<ID=LowQual,Description="Low-quality variant call">',
    ("FILTER", "LowDepth"): '##FILTER=<ID=LowDepth,Description="Read depth below threshold">',
    ("FILTER", "MixedSite"): '##FILTER=<ID=MixedSite,Description="Heterozygous genotype">',
    ("FILTER", "StrandBias"): '##FILTER=<ID=StrandBias,Description="Strand-bias p-value below threshold">',
    ("FORMAT", "GT"): '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    ("FORMAT", "DP"): '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read Depth">',
    ("INFO", "END"): '##INFO=<ID=END,Number=1,Type=Integer,Description="End position of the variant">',
    ("INFO", "SVTYPE"): '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
    ("INFO", "SVLEN"): '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length of structural variant">',
    ("INFO", "TYPE"): '##INFO=<ID=TYPE,Number=A,Type=String,Description="Allele type">',
    ("FORMAT", "AO"): '##FORMAT=<ID=AO,Number=A,Type=Integer,Description="Alternate allele observations">',
    ("FORMAT", "SB"): '##FORMAT=<ID=SB,Number=1,Type=Float,Description="Share of alternate reads on the forward strand">',
    ("INFO", "BCSQ"): '##INFO=<ID=BCSQ,Number=.,Type=String,Description="Consequence annotation">',
    **{
        ("INFO", name): f'##INFO=<ID={name},Number=1,Type={kind},Description="{text}">'
        for name, kind, text in (
            ("CONTEXT_LOCAL_SNPS", "Integer", "SNPs within the window"),
            ("CONTEXT_INDEL_DIST", "Integer", "Distance to the nearest indel"),
            ("CONTEXT_LOWQUAL_REASON", "String", "Context rules that fired"),
            ("ASM_MAPQ", "Integer", "Mapping quality of the assembly block"),
            ("ASM_TP", "String", "Type of the assembly block"),
            ("ASM_S1", "Integer", "Chaining score"),
            ("ASM_S2", "Integer", "Chaining score of the best secondary chain"),
            ("ASM_CM", "Integer", "Minimizers on the chain"),
            ("ASM_AS", "Integer", "Alignment score"),
            ("ASM_DV", "Float", "Approximate divergence"),
            ("ASM_DE", "Float", "Gap-compressed divergence"),
            ("ASM_RL", "Integer", "Length of repetitive query seeds"),
            ("ASM_S2_RATIO", "Float", "Secondary to primary chaining score"),
            ("ASM_CM_PER_KB", "Float", "Minimizers per kilobase"),
            ("ASM_RL_FRAC", "Float", "Share of repetitive query seeds"),
            ("ASM_EDGE_DIST", "Integer", "Distance to the block's edge"),
            ("ASM_LOWQUAL_REASON", "String", "Assembly rules that fired"),
            ("MUMMER_BLEN", "Integer", "Length of the alignment block"),
            ("MUMMER_ERR", "Integer", "Errors of the alignment block"),
            ("MUMMER_IDENTITY", "Float", "Identity of the alignment block"),
            ("MUMMER_VAR_KB", "Float", "Variants per kilobase of the block"),
            ("MUMMER_EDGE_DIST", "Integer", "Distance to the block's edge"),
            ("SB_REF_FWD", "Integer", "Reference reads on the forward strand"),
            ("SB_REF_REV", "Integer", "Reference reads on the reverse strand"),
            ("SB_ALT_FWD", "Integer", "Alternate reads on the forward strand"),
            ("SB_ALT_REV", "Integer", "Alternate reads on the reverse strand"),
            ("SB_ALT_FWD_FRAC", "Float", "Share of alternate reads on the forward strand"),
            ("SB_PVALUE", "Float", "Strand-bias p-value"),
            ("SB_PHRED", "Float", "Strand-bias p-value, phred-scaled"),
            ("SB_METHOD", "String", "Test of the strand bias"),
        )
    },
    ("INFO", "ZERODEPTH"): '##INFO=<ID=ZERODEPTH,Number=0,Type=Flag,Description="No read covers this interval">',
}


def _number(value: Column) -> Column:
    """Shortest text of a double: whole numbers without a fraction."""
    whole = value == F.floor(value)
    return F.when(value.isNull(), ".").when(whole, F.floor(value).cast("string")).otherwise(value.cast("string"))


def vcf_lines(v: DataFrame, contigs: DataFrame, samples: list[str], definitions: list[str] | None = None) -> DataFrame:
    """Text lines with the keys (ord, chrom, pos, rec_no) that sort them; header lines first.

    ``definitions`` are meta lines to keep; missing standard ones are added once.
    """
    meta = [d for d in (definitions or []) if not d.startswith(("##fileformat", "##contig"))]
    meta += [text for (kind, name), text in DEFINITIONS.items() if not any(m.startswith(f"##{kind}=<ID={name},") for m in meta)]
    head = ["##fileformat=VCFv4.2", *meta, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]
    spark = v.sparkSession
    # lines before and after the contig list
    order = F.posexplode(F.array(*[F.lit(h) for h in head])).alias("_i", "value")
    fixed = spark.range(1).select(order).select(F.when(F.col("_i") == len(head) - 1, -1).when(F.col("_i") == 0, -4).otherwise(-3).cast("bigint").alias("ord"), F.col("_i").cast("bigint").alias("pos"), "value")
    listed = contigs.select(F.lit(-2).cast("bigint").alias("ord"), F.col("ord").cast("bigint").alias("pos"), F.format_string("##contig=<ID=%s,length=%d>", "contig", "length").alias("value"))
    header = fixed.unionByName(listed).withColumns({"chrom": F.lit(""), "rec_no": F.lit(0).cast("bigint")})
    keys = ["chrom", "pos", "rec_no", "id", "ref", "_alt", "_qual", "_filter", "_info"]
    rows = v.withColumns({"_alt": F.array_join("alts", ","), "_qual": _number(F.col("qual")), "_filter": X.format_filters(F.col("filters")), "_info": X.format_info(F.col("info"))})
    present = F.flatten(F.array_agg(F.map_keys("fmt")))
    names = F.array_distinct(F.concat(F.filter(present, lambda k: k == "GT"), present))
    cells = rows.groupBy(*keys).agg(names.alias("_keys"), F.map_from_entries(F.array_agg(F.struct("sample", "fmt"))).alias("_by"))

    def cell(name: str) -> Column:
        mine = F.try_element_at("_by", F.lit(name))
        return F.array_join(F.transform("_keys", lambda k: F.coalesce(F.try_element_at(mine, k), F.lit("."))), ":")

    tail = [F.when(F.size("_keys") == 0, ".").otherwise(F.array_join("_keys", ":")), *[cell(s) for s in samples]] if samples else []
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "_alt", "_qual", "_filter", "_info", *tail)
    ranks = contigs.select(F.col("contig").alias("chrom"), F.col("ord").cast("bigint").alias("ord"))
    records = cells.select("chrom", F.col("pos").cast("bigint").alias("pos"), F.col("rec_no").cast("bigint").alias("rec_no"), line.alias("value")).join(ranks, "chrom", "left")
    last = F.lit((1 << 62)).cast("bigint")
    records = records.select(F.coalesce("ord", last).alias("ord"), "chrom", "pos", "rec_no", "value")
    return header.select("ord", "chrom", "pos", "rec_no", "value").unionByName(records)


def write_vcf(v: DataFrame, path: str, contigs: DataFrame, samples: list[str], definitions: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Sorted VCF text: part files in order, the header in the first. Range partitioning keeps the sort distributed."""
    lines = vcf_lines(v, contigs, samples, definitions)
    lines.orderBy("ord", "chrom", "pos", "rec_no", "value").select("value").write.mode(mode).text(path)


def bed_lines(df: DataFrame, merge: bool = True) -> DataFrame:
    """(contig, start, value) of BED text, merged first unless told otherwise."""
    rows = merge_intervals(df) if merge else df
    return rows.select("contig", "start", F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))


def write_bed(df: DataFrame, path: str, merge: bool = True, mode: str = "errorifexists") -> None:
    bed_lines(df, merge).orderBy("contig", "start", "value").select("value").write.mode(mode).text(path)


def fasta_lines(seqs: DataFrame, name: str = "sample") -> DataFrame:
    """``seqs`` with ``value``: the two lines of each record; a NULL sequence is an empty one."""
    return seqs.withColumn("value", F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.coalesce("seq", F.lit(""))))


def write_fasta(seqs: DataFrame, path: str, name: str = "sample", order: str | None = None, mode: str = "errorifexists") -> None:
    """Two lines per record."""
    rows = fasta_lines(seqs, name)
    (rows.orderBy(order) if order else rows).select("value").write.mode(mode).text(path)


# Number formats of the reports, and the decimals of those that have some.
FORMATS = {"two": "%.2f", "four": "%.4f", "six": "%.6f", "general": "%g"}
_DECIMALS = {"two": 2, "four": 4, "six": 6}


def tsv_cells(df: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """Every column as the text of its cell; ``formats`` names a number format per column, ties round to even, NULL stays."""

    def cell(name: str) -> Column:
        kind = (formats or {}).get(name)
        if not kind:
            return F.col(name).cast("string")
        value = F.bround(F.col(name), _DECIMALS[kind]) if kind in _DECIMALS else F.col(name)
        return F.when(F.col(name).isNotNull(), F.format_string(FORMATS[kind], value))

    return df.select(*[cell(c).alias(c) for c in df.columns])


def write_tsv(df: DataFrame, path: str, formats: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Tab-separated table with a header; NULL is blank, ``formats`` names a number format per column."""
    tsv_cells(df, formats).write.mode(mode).csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def phylip_lines(distances: DataFrame, names: list[str]) -> DataFrame:
    """(at, value) of a square matrix: the count at -1, then one line per name; a pair without a distance has 0.

    A line is filled from the cells that are there, ordered by place, so the plan
    does not grow with the names; the line itself does. Cells are gathered once, by
    line; the names, which the caller holds, are broadcast. Of repeated pairs the largest counts.
    """
    spark = distances.sparkSession
    places = spark.createDataFrame(list(enumerate(names)), "at bigint, name string")
    sides = [F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "distance") for x, y in (("a", "b"), ("b", "a"))]
    pairs = distances.select(F.explode(F.array(*sides)).alias("p")).select("p.*")
    b_places = places.select(F.col("name").alias("b"), F.col("at").alias("to"))
    lists = pairs.join(F.broadcast(b_places), "b").groupBy(F.col("a").alias("name")).agg(F.sort_array(F.collect_list(F.struct("to", "distance"))).alias("_all"))
    # the last of a place is its largest
    final = F.filter("_all", lambda c, i: ~F.coalesce(F.get("_all", i + 1)["to"] == c["to"], F.lit(False)))
    lists = lists.select("name", F.transform(final, lambda c: F.struct(c["to"].alias("to"), c["distance"].cast("string").alias("text"))).alias("_cells"))
    rows = places.join(lists, "name", "left").withColumn("_cells", F.coalesce("_cells", F.array().cast("array<struct<to:bigint,text:string>>")))
    # the zeros before each cell, up to the one before it
    before = F.concat(F.array(F.lit(-1).cast("bigint")), F.transform("_cells", lambda c: c["to"]))
    zeros = "\t0"
    filled = F.transform(
        "_cells", lambda c, i: F.concat(F.repeat(F.lit(zeros), (c["to"] - F.get("_before", i) - 1).cast("int")), F.lit("\t"), c["text"])
    )
    tail = F.repeat(F.lit(zeros), (F.lit(len(names)) - F.element_at("_before", -1) - 1).cast("int"))
    body = rows.withColumn("_before", before).select("at", F.concat("name", F.array_join(filled, ""), tail).alias("value"))
    count = spark.range(1).select(F.lit(-1).cast("bigint").alias("at"), F.lit(str(len(names))).alias("value"))
    return count.unionByName(body)


def write_phylip(distances: DataFrame, names: list[str], path: str, mode: str = "errorifexists") -> None:
    """Square matrix: the count, then one line per name."""
    phylip_lines(distances, names).orderBy("at").select("value").write.mode(mode).text(path)


def report_lines(table: DataFrame, sample_fields: list[str], info_fields: list[str], order: list[str]) -> DataFrame:
    """Lines of one JSON document ``{variants, sampleFields, infoFields}``: part, the order, text, copy, value.

    Sorted by part, the order, text and copy the lines are the document. Each variant but the first
    begins with its comma. Equal rows are counted and written out again, so that
    exactly one row is first.
    """
    text = F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})
    rows = table.select(*order, text.alias("value")).groupBy(*order, "value").agg(F.count("*").alias("_n"))
    sort_key = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order], F.col("value"))
    first = rows.agg(F.min(sort_key)).scalar()
    each = rows.withColumn("_first", sort_key == first).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    comma = F.when(F.col("_first") & (F.col("_i") == 1), "").otherwise(",")
    body = each.select(F.lit(1).alias("part"), *order, F.col("value").alias("text"), F.col("_i").alias("copy"), F.concat(comma, "value").alias("value"))
    names = [F.to_json(F.array(*[F.lit(f) for f in fields]).cast("array<string>")) for fields in (sample_fields, info_fields)]
    ends = F.array(
        F.struct(F.lit(0).alias("part"), F.lit('{"variants": [').alias("value")),
        F.struct(F.lit(2).alias("part"), F.concat(F.lit('], "sampleFields": '), names[0], F.lit(', "infoFields": '), names[1], F.lit("}")).alias("value")),
    )
    frame = table.sparkSession.range(1).select(F.explode(ends).alias("e")).select("e.*")
    return body.unionByName(frame, allowMissingColumns=True)


def report_json(table: DataFrame, sample_fields: list[str], info_fields: list[str], path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """One JSON document; its part files, read in the order of their names, are that document."""
    keys = order or [c for c in ("chrom", "pos") if c in table.columns] or table.columns[:1]
    lines = report_lines(table, sample_fields, info_fields, keys)
    lines.orderBy("part", *keys, "text", "copy").select("value").write.mode(mode).text(path)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """MD5 of each file, read in pieces of 1 MB; NULL where it can't be read."""
    from pyarrow import fs

    def digest(uri: str) -> str | None:
        md5 = hashlib.md5(usedforsecurity=False)
        try:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_stream(path, compression=None) as handle:
                while data := handle.read(1 << 20):
                    md5.update(data)
        except (OSError, ValueError):
            return None
        return md5.hexdigest()

    for batch in batches:
        yield batch.assign(md5=[digest(p) for p in batch["path"]])


def file_manifest(spark, paths: str | list[str], descriptions: dict[str, str] | None = None) -> DataFrame:
    """(path, size, bytes, md5, description) of output files of any size; contents are streamed, never held."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", F.col("length").alias("bytes"))
    label = F.lit("")
    for part, text in (descriptions or {}).items():
        label = F.when(F.contains("path", F.lit(part)), text).otherwise(label)
    hashed = files.mapInPandas(_digests, "path string, bytes bigint, md5 string")
    return hashed.select("path", human_size(F.col("bytes")).alias("size"), "bytes", "md5", label.alias("description"))
