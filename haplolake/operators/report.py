"""Variant table of a sample report: typed INFO and FORMAT columns and consequence parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.functions import fields as X
from haplolake.operators.variants import consequence_fields, report_scope

_TYPES = {"Integer": "bigint", "Float": "double"}


def discovered_keys(v: DataFrame, column: str) -> DataFrame:
    """Keys used in INFO or FORMAT, in order of first use."""
    return v.select("rec_no", F.posexplode(F.map_keys(column)).alias("_i", "key")).groupBy("key").agg(F.min(F.struct("rec_no", "_i")).alias("first"))


def typed(value: Column, kind: str | None, number: str | None, present: Column) -> Column:
    """Value by its declared type; lists stay text, a flag is whether it is there."""
    if kind == "Flag":
        return present
    if kind in _TYPES and number == "1":
        return X.blank_to_null(value).try_cast(_TYPES[kind])
    return X.blank_to_null(value)


def report_table(v: DataFrame, header: DataFrame, scope: str = "all") -> DataFrame:
    """Wide table (sample, chrom, pos, ..., info_<key>, fmt_<key>, consequence parts).

    Columns follow the definitions of the header, then keys the records use
    without one; both lists are as long as a VCF header, not as the data.
    """
    rows = report_scope(v, scope)
    declared = {"INFO": {}, "FORMAT": {}}
    for r in header.filter(F.col("kind").isin("INFO", "FORMAT")).groupBy("kind", "id").agg(F.min_by(F.struct("type", "number"), "ord").alias("d"), F.min("ord").alias("o")).orderBy("o").collect():
        declared[r["kind"]][r["id"]] = (r["d"]["type"], r["d"]["number"])
    columns = []
    for kind, source, prefix in (("INFO", "info", "info_"), ("FORMAT", "fmt", "fmt_")):
        used = [r["key"] for r in discovered_keys(rows, source).orderBy("first").collect()]
        for key in [*[k for k in declared[kind] if k in used], *[k for k in used if k not in declared[kind]]]:
            if key == "BCSQ":
                continue
            t, n = declared[kind].get(key, (None, None))
            columns.append(typed(F.try_element_at(source, F.lit(key)), t, n, F.map_contains_key(source, key)).alias(prefix + key))
    return rows.select(
        "sample", "chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alt"), "qual", X.format_filters(F.col("filters")).alias("filter"),
        *columns, *consequence_fields(F.try_element_at("info", F.lit("BCSQ"))),
    )
