"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words are runs of anything but these six bytes.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# Fold of A to Z alone, as the word contracts ask; other letters stay as they are.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# What str.split() also treats as white space, beyond the six.
_OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_SIX = re.compile("[ \t\n\x0b\x0c\r]+")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def split_words(text: str | None) -> list[str]:
    """The words of a text; str.split() where it means the same, as it is much faster."""
    if not text:
        return []
    if _OTHER_SPACES.search(text):
        return [w for w in _SIX.split(text) if w]
    return text.split()


def remainder_of(key: Column, modulus: int = 5) -> Column:
    """crc32 of the key as text, modulo ``modulus``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class Remember(dict):
    """A memo that starts anew when it is full, so that a worker's memory stays bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of tasks that deal ``rows`` out at ``per_task`` each, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


def sums_before(df: DataFrame, group: list[str], order: list[str], value: str, name: str, rows: int, cell: int = 2048) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows that sort before by ``order``.

    ``order`` starts with a hash of 63 bits. Its leading bits cut
    each group into cells of about ``cell`` rows and blocks of 4096 cells; rows
    are ranked inside their cell alone, and one row per cell and per block
    carries the sums, so a group of any share of the rows is spread out.
    ``df`` is read twice; stage it first.
    """
    bits = max(1, (max(1, rows) // cell).bit_length())
    placed = df.withColumn("_cell", F.shiftrightunsigned(order[0], 63 - bits)).withColumn("_block", F.shiftrightunsigned("_cell", 12))
    first = Window.rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str, by: list[str], within: list[str]) -> Column:
        return F.coalesce(F.sum(column).over(first.partitionBy(*[F.col(w) for w in within]).orderBy(*by)), F.lit(0))

    cells = placed.groupBy(*group, "_block", "_cell").agg(F.sum(value).alias("_v"))
    blocks = cells.groupBy(*group, "_block").agg(F.sum("_v").alias("_w")).withColumn("_in_blocks", before("_w", ["_block"], group))
    cells = cells.withColumn("_in_cells", before("_v", ["_cell"], [*group, "_block"])).join(blocks.drop("_w"), [*group, "_block"])
    ranked = placed.withColumn("_in_cell", before(value, order, [*group, "_cell"]))
    joined = ranked.join(cells.select(*group, "_cell", "_in_cells", "_in_blocks"), [*group, "_cell"])
    return joined.select(*df.columns, (F.col("_in_blocks") + F.col("_in_cells") + F.col("_in_cell")).alias(name))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
