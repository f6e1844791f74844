"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows get global numbers 0..n-1, a keyed permutation of those numbers is computed
per row, and shard and slot follow from the permuted number by division. No
global sort runs: numbers are ranks inside hash cells plus the cells' offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplolake.session import stage

ROUNDS = 4
WALK = 16
CELL = 4096
CHUNK = 65_536


def feistel(number: Column, n: int, seed: int) -> Column:
    """Permuted number in [0, n).

    The domain is a rectangle of a x b cells with a the square root of ``n``
    rounded up, so fewer than ``a`` of its numbers lie outside [0, n). A number
    that lands there is permuted again. ``WALK`` + 1 steps always suffice up to
    256 rows; beyond that a longer walk has a chance under 1e-15 and is an error,
    never a wrong number.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))

    def step(x: Column) -> Column:
        left, right = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b).cast("long"))
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(r)), F.lit(a).cast("long")), F.lit(a).cast("long"))
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(r)), F.lit(b).cast("long")), F.lit(b).cast("long"))
        return left * F.lit(b).cast("long") + right

    walked = F.aggregate(
        F.sequence(F.lit(0), F.lit(WALK)),
        F.struct(number.cast("long").alias("x"), F.lit(True).alias("out")),
        lambda s, _: F.when(s["out"], walk_state(step(s["x"]), n)).otherwise(s),
    )
    return F.when(walked["out"], F.raise_error(F.lit("cycle walk too long")).cast("long")).otherwise(walked["x"])


def walk_state(x: Column, n: int) -> Column:
    """The number, and whether it still lies outside [0, n)."""
    return F.struct(x.alias("x"), (x >= F.lit(n)).alias("out"))


def number_rows(df: DataFrame, keys: list[str], cell: int = CELL) -> tuple[DataFrame, int]:
    """Distinct ``keys`` with their ``copies`` and the global number of the ``first`` copy; and the number of rows.

    Repeated rows are counted before anything is dealt out, so a hot key is one
    row. Keys fall into cells by hash; cells hold about ``cell`` keys each, are
    ranked alone, and one row per cell carries the offsets.
    """
    counted = stage(df.groupBy(*keys).agg(F.count("*").alias("copies")).withColumn("_hash", F.xxhash64(*keys)))
    distinct = counted.count()
    cells = max(1, -(-distinct // cell))
    placed = counted.withColumn("_cell", F.pmod(F.col("_hash"), F.lit(cells)))
    totals = placed.groupBy("_cell").agg(F.sum("copies").alias("_rows"))
    # one row per cell: 1/4096 of the keys, ranked by blocks of cells and then by block
    block = F.floor(F.col("_cell") / CELL)
    per_block = totals.groupBy(block.alias("_block")).agg(F.sum("_rows").alias("_n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    block_start = per_block.select("_block", F.coalesce(F.sum("_n").over(before.orderBy("_block")), F.lit(0)).alias("_b"))
    inner = F.coalesce(F.sum("_rows").over(before.partitionBy("_block").orderBy("_cell")), F.lit(0))
    starts = totals.withColumn("_block", block).withColumn("_c", inner).join(block_start, "_block").select("_cell", (F.col("_b") + F.col("_c")).alias("_start"))
    rank = F.coalesce(F.sum("copies").over(before.partitionBy("_cell").orderBy("_hash", *keys)), F.lit(0))
    numbered = placed.withColumn("_rank", rank).join(starts, "_cell")
    rows = counted.agg(F.sum("copies")).first()[0] or 0
    return numbered.select(*keys, "copies", (F.col("_start") + F.col("_rank")).alias("first")), rows


def shard_rows(df: DataFrame, keys: list[str], shards: int = 8, seed: int = 17, cell: int = CELL) -> DataFrame:
    """Every row's ``shard`` and ``slot``; ``keys`` are the columns that tell rows apart.

    Shard sizes differ by one row at most, slots run from 0 without a gap, and
    the result depends on the keys' values, the seed and the number of shards
    only. Rows that agree in all keys get a place each. NULL keys are values like
    any other; an empty table gives an empty result. Other columns are not kept:
    join on the keys, or name them as keys.
    """
    numbered, n = number_rows(df.select(*keys), keys, cell)
    # a hot key's copies are unfolded in chunks that Spark may deal out
    chunks = numbered.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(CHUNK).cast("long"))))
    copy = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("copies")) - 1))
    rows = chunks.withColumn("_copy", copy).withColumn("_to", feistel(F.col("first") + F.col("_copy"), n, seed))
    return rows.select(*keys, F.pmod("_to", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_to") / shards).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size and text_crc32 of every document with its shard and slot.

    A NULL text has size 1 and the checksum of the empty text. Documents that
    agree in all three columns are told apart by nothing else and get a place each.
    """
    bytes_ = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    keyed = docs.select("doc_id", (F.octet_length(bytes_).cast("long") + 1).alias("size"), F.crc32(bytes_).cast("long").alias("text_crc32"))
    return shard_rows(keyed, ["doc_id", "size", "text_crc32"], shards, seed)
