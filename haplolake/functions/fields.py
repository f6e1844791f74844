"""INFO, FORMAT, FILTER and genotype columns (Column -> Column)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that may hold a distance to an alignment edge, in lookup order.
EDGE_DISTANCE_KEYS = ("CONTEXT_EDGE_DIST", "EDGE_DIST", "ASM_EDGE_DIST", "MUMMER_EDGE_DIST")

# Genotype spellings.
HET_GENOTYPES = ("0/1", "1/0", "0|1", "1|0")
HOM_REF_GENOTYPES = ("0/0", "0|0")
HOM_ALT_GENOTYPES = ("1/1", "1|1")

_TEXT_MAP = "map<string,string>"


def blank_to_null(value: Column) -> Column:
    """``.`` and the empty string are missing."""
    return F.when(value.isin("", "."), F.lit(None)).otherwise(value)


def as_int(value: Column) -> Column:
    return blank_to_null(value).try_cast("int")


def as_double(value: Column) -> Column:
    return blank_to_null(value).try_cast("double")


def _map_last_wins(keys: Column, values: Column) -> Column:
    """Map from parallel arrays; a repeated key keeps its last value."""
    unique = F.array_distinct(keys)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.transform(
        unique,
        lambda key: F.element_at(F.filter(pairs, lambda p: p["k"] == key), -1)["v"],
    )
    plain = F.map_from_arrays(keys, values)
    return F.when(F.size(unique) == F.size(keys), plain).otherwise(F.map_from_arrays(unique, last))


def parse_pairs(text: Column, item_sep: str = ";", flags: bool = True) -> Column:
    """``k=v;flag`` text to a map; a flag has the value ''. NULL text gives an empty map."""
    items = F.filter(F.split(F.coalesce(text, F.lit("")), item_sep), lambda i: (i != "") & (i != "."))
    if not flags:
        items = F.filter(items, lambda i: F.contains(i, F.lit("=")))
    keys = F.transform(items, lambda i: F.substring_index(i, "=", 1))
    values = F.transform(
        items,
        lambda i: F.when(F.contains(i, F.lit("=")), F.regexp_replace(i, "^[^=]*=", "")).otherwise(F.lit("")),
    )
    return _map_last_wins(keys, values)


def parse_info(text: Column) -> Column:
    return parse_pairs(text)


def format_info(info: Column) -> Column:
    """Inverse of :func:`parse_info`; an empty map is ``.``."""
    parts = F.transform(
        F.map_entries(info),
        lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])),
    )
    return F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, ";"))


def put(entries: Column, key: str, value: Column) -> Column:
    """Set one key of a string map; NULL leaves the map alone."""
    value = value.cast("string")
    kept = F.map_filter(entries, lambda k, _v: k != key)
    return F.when(value.isNull(), entries).otherwise(F.map_concat(kept, F.create_map(F.lit(key), value)))


def put_all(entries: Column, values: dict[str, Column]) -> Column:
    """Set several keys at once; NULL values leave their key alone."""
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]),
        lambda p: p["value"].isNotNull(),
    )

    def replaced(key: Column) -> Column:
        return reduce(or_, [(key == k) & v.isNotNull() for k, v in values.items()], F.lit(False))

    kept = F.map_filter(entries, lambda k, _v: ~replaced(k))
    return F.map_concat(kept, F.map_from_entries(pairs))


def empty_map() -> Column:
    return F.create_map().cast(_TEXT_MAP)


def parse_format(keys: Column, values: Column) -> Column:
    """FORMAT and sample text to a map; the shorter side decides."""
    k = F.split(keys, ":")
    v = F.split(values, ":")
    n = F.least(F.size(k), F.size(v))
    missing = keys.isNull() | values.isNull() | keys.isin("", ".") | values.isin("", ".")
    return F.when(missing, empty_map()).otherwise(_map_last_wins(F.slice(k, 1, n), F.slice(v, 1, n)))


def parse_filters(text: Column) -> Column:
    return F.when(text.isNull() | text.isin("", "."), F.array().cast("array<string>")).otherwise(F.split(text, ";"))


def format_filters(filters: Column) -> Column:
    return F.when(F.size(filters) == 0, F.lit(".")).otherwise(F.array_join(filters, ";"))


def is_exact_pass(filters: Column) -> Column:
    """FILTER is ``.`` or exactly PASS."""
    return (F.size(filters) == 0) | (F.array_join(filters, ";") == "PASS")


def add_labels(filters: Column, labels: Column) -> Column:
    """Append labels; an empty or PASS-only FILTER is replaced, nothing is repeated."""
    base = F.when(is_exact_pass(filters), F.array().cast("array<string>")).otherwise(filters)
    return F.when(F.size(labels) == 0, filters).otherwise(F.array_union(base, labels))


def add_reasons(info: Column, key: str, reasons: Column) -> Column:
    """Append to a comma set held in an INFO key."""
    old = F.filter(F.split(F.coalesce(F.try_element_at(info, F.lit(key)), F.lit("")), ","), lambda r: r != "")
    joined = F.array_join(F.array_union(old, reasons), ",")
    return F.when(F.size(reasons) == 0, info).otherwise(put(info, key, joined))


def compact(*values: Column) -> Column:
    """Array of the non-NULL values."""
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def edge_distance(info: Column) -> Column:
    """First present edge-distance key as a truncated integer; NULL if it does not parse."""
    first = F.coalesce(*[F.try_element_at(info, F.lit(k)) for k in EDGE_DISTANCE_KEYS])
    return first.try_cast("double").try_cast("int")


def has_alt(gt: Column) -> Column:
    """Some allele index of the genotype is above zero."""
    alleles = F.split(F.coalesce(gt, F.lit(".")), r"[/|]")
    return F.exists(alleles, lambda a: F.coalesce(a.try_cast("int") > 0, F.lit(False)))


def collapse_genotype(gt: Column) -> Column:
    """Diploid spelling to haploid: hom-ref 0, hom-alt 1, heterozygous ``.``; others stay."""
    return (
        F.when(gt.isin(*HOM_REF_GENOTYPES), "0")
        .when(gt.isin(*HOM_ALT_GENOTYPES), "1")
        .when(gt.isin(*HET_GENOTYPES), ".")
        .otherwise(gt)
    )


def depth_of(fmt: Column, info: Column) -> Column:
    """DP of the sample, else of INFO."""
    return F.coalesce(
        as_double(F.try_element_at(fmt, F.lit("DP"))), as_double(F.try_element_at(info, F.lit("DP")))
    )


def allele_fraction(fmt: Column, info: Column, depth: Column) -> Column:
    """AF of the sample, else of INFO, else the sum of AO over depth."""
    parts = F.filter(F.split(F.try_element_at(fmt, F.lit("AO")), ","), lambda x: ~x.isin("", "."))
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)
    from_ao = F.when((F.size(parts) > 0) & (depth != 0), total / F.nullif(depth, F.lit(0.0)))
    return F.coalesce(
        as_double(F.try_element_at(fmt, F.lit("AF"))), as_double(F.try_element_at(info, F.lit("AF"))), from_ao
    )


def json_first(document: Column, *paths: str) -> Column:
    """First non-null JSON path, trimmed and lower-cased."""
    return F.lower(F.trim(F.coalesce(*[F.get_json_object(document, p) for p in paths])))
