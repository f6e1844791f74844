"""CIGAR strings as arrays of (len, op) (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which operations consume reference and query bases.
REFERENCE_OPS = ("M", "D", "N", "=", "X")
QUERY_OPS = ("M", "I", "S", "=", "X")
ALIGNED_OPS = ("M", "=", "X")
EDGE_OPS = ("D", "N", "P")

_VALID = r"^(\d+[MIDNSHP=X])+$"
_PLACED = "array<struct<len:int,op:string,ref:bigint,query:int>>"


def ops(cigar: Column) -> Column:
    """Array of struct(len, op); NULL for ``*`` and for text that does not round-trip."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    codes = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    zipped = F.zip_with(lengths, codes, lambda n, o: F.struct(n.cast("int").alias("len"), o.alias("op")))
    return F.when(cigar.rlike(_VALID), zipped)


def consumed(parts: Column, codes: tuple[str, ...]) -> Column:
    """Bases consumed by the given operations."""
    return F.aggregate(
        parts, F.lit(0), lambda acc, p: acc + F.when(p["op"].isin(*codes), p["len"]).otherwise(F.lit(0))
    )


def reference_length(cigar: Column) -> Column:
    single = F.regexp_extract(cigar, r"^(\d+)M$", 1).try_cast("int")
    return F.when(cigar.rlike(r"^\d+M$"), single).otherwise(F.coalesce(consumed(ops(cigar), REFERENCE_OPS), F.lit(0)))


def query_length(cigar: Column) -> Column:
    """Read length before hard clipping."""
    return F.coalesce(consumed(ops(cigar), QUERY_OPS + ("H",)), F.lit(0))


def end_clips(cigar: Column) -> tuple[Column, Column]:
    """Soft plus hard clipping at the left and the right end."""

    def number(pattern: str, group: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, group), F.lit("")).cast("int"), F.lit(0))

    left = r"^(?:(\d+)H)?(?:(\d+)S)?"
    right = r"(?:(?<!\d)(\d+)S)?(?:(?<!\d)(\d+)H)?$"
    return number(left, 1) + number(left, 2), number(right, 1) + number(right, 2)


def placed(cigar: Column, start: Column) -> Column:
    """Operations with the 0-based reference and query offset at which each begins."""
    state = F.struct(
        start.cast("long").alias("ref"), F.lit(0).alias("query"), F.array().cast(_PLACED).alias("out")
    )

    def step(s: Column, p: Column) -> Column:
        item = F.struct(p["len"].alias("len"), p["op"].alias("op"), s["ref"].alias("ref"), s["query"].alias("query"))
        return F.struct(
            (s["ref"] + F.when(p["op"].isin(*REFERENCE_OPS), p["len"]).otherwise(F.lit(0))).alias("ref"),
            (s["query"] + F.when(p["op"].isin(*QUERY_OPS), p["len"]).otherwise(F.lit(0))).alias("query"),
            F.concat(s["out"], F.array(item)).alias("out"),
        )

    whole = F.struct(
        F.regexp_extract(cigar, r"^(\d+)M$", 1).try_cast("int").alias("len"), F.lit("M").alias("op"), start.cast("long").alias("ref"), F.lit(0).alias("query")
    )
    general = F.aggregate(ops(cigar), state, step, lambda s: s["out"])
    # most reads match in one piece and skip the fold
    return F.when(cigar.rlike(r"^\d+M$"), F.array(whole).cast(_PLACED)).otherwise(general)


def aligned_text(cigar: Column, text: Column) -> Column:
    """Query text (bases or qualities) under aligned operations, in one piece; NULL for a missing text (``*``)."""
    runs = F.filter(placed(cigar, F.lit(0)), lambda p: p["op"].isin(*ALIGNED_OPS))
    cut = F.array_join(F.transform(runs, lambda p: F.substr(text, p["query"] + 1, p["len"])), "")
    return F.when(text != "*", F.when(cigar.rlike(r"^\d+M$"), text).otherwise(cut))


def text(parts: Column) -> Column:
    """CIGAR text; non-positive lengths are dropped and equal neighbours fused."""
    kind = "array<struct<len:int,op:string>>"

    def step(out: Column, p: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        item = F.struct(p["len"].alias("len"), p["op"].alias("op"))
        fused = F.struct((last["len"] + p["len"]).alias("len"), p["op"].alias("op"))
        return (
            F.when(p["len"] <= 0, out)
            .when(last["op"] == p["op"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(fused)))
            .otherwise(F.concat(out, F.array(item)))
        )

    packed = F.aggregate(parts, F.array().cast(kind), step)
    return F.array_join(F.transform(packed, lambda p: F.concat(p["len"].cast("string"), p["op"])), "")
