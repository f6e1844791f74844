"""Named queries over the Parquet tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.functions import fields as X
from haplolake.plans.views import sql_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), ctes: str = ""):
    """Register a query; ``views`` and ``ctes`` become the WITH list of its check."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            heads = [h for h in (sql_views(*views) if views else "", ctes.strip()) if h]
            recursive = "RECURSIVE " if "RECURSIVE" in ctes else ""
            body = ", ".join(heads).replace("RECURSIVE ", "")
            ORACLE[name] = (f"WITH {recursive}{body} {sql}" if heads else sql).strip()
        return fn

    return register


def strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """v_variants as variant records."""
    v = view(spark, folder, "v_variants")
    info = F.when(F.col("csq") != "", F.create_map(F.lit("BCSQ"), F.col("csq"))).otherwise(X.empty_map())
    fmt = F.create_map(F.lit("GT"), F.col("gt"), F.lit("DP"), F.col("dp").cast("string"), F.lit("AO"), (F.col("dp") - 1).cast("string"))
    return v.select(
        "sample", "chrom", "pos", F.lit(".").alias("id"), "ref", F.array("alt").alias("alts"), "qual",
        strings().alias("filters"), info.alias("info"), fmt.alias("fmt"), F.lit(0).cast("long").alias("rec_no"),
    )


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "v_intervals").withColumnsRenamed({"start_": "start", "end_": "end"})


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    """v_alignments with read text."""
    a = view(spark, folder, "v_alignments")
    seq = F.substr(F.lit("ACGT" * 26), F.col("shift") + 1, F.col("seq_len"))
    qual = F.substr(F.lit("5?IF" * 26), F.col("shift") + 1, F.col("seq_len"))
    return a.select(
        "qname", "flag", "rname", "pos", "mapq", "cigar", F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"),
        seq.alias("seq"), qual.alias("qual"), F.create_map(F.lit("NM"), (F.col("mapq") % 5).cast("string")).alias("tags"),
    )


def contigs(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "v_contigs")


def keys_of(v: DataFrame, *more: Column) -> DataFrame:
    """Record key columns with the single ALT as text."""
    return v.select("sample", "chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), *more)
