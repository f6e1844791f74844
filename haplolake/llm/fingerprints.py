"""Document fingerprints by one-permutation MinHash with optimal densification.

Every shingle is hashed once; the leading bits choose a bin, and each bin keeps
its smallest hash. An empty bin copies the bin that a fixed hash of (bin,
attempt) points at, trying until it meets a filled one. Only the lowest bits of
each bin are stored, and the likeness corrects for chance agreement.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplolake.llm.common import partitions_for
from haplolake.llm.shingles import mix, shingle_set
from haplolake.session import stage

BINS, BITS, SHINGLE = 256, 4, 5
ATTEMPTS = 64
ROWS_PER_CELL, MOST_CELLS = 512, 65_536

_probe = (mix(np.arange(BINS * ATTEMPTS, dtype=np.uint64) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64).reshape(ATTEMPTS, BINS)


def densified(minima: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Minima with every empty bin copied from a filled one."""
    out, donor = minima.copy(), np.where(filled, np.arange(BINS), -1)
    for tries in _probe:
        empty = donor < 0
        if not empty.any():
            break
        found = empty & filled[tries]
        donor[found] = tries[found]
    else:  # so few filled bins that no attempt met one: the next filled bin in a circle
        where = np.flatnonzero(filled)
        empty = np.flatnonzero(donor < 0)
        donor[empty] = where[np.searchsorted(where, empty) % len(where)]
    return out[donor]


def fingerprint(text: str | None, size: int = SHINGLE) -> str:
    """Hexadecimal digits, one per bin; empty for a text without words."""
    shingles = shingle_set(text, size)
    if not len(shingles):
        return ""
    width = np.uint64(64 - BINS.bit_length() + 1)
    edges = np.arange(BINS, dtype=np.uint64) << width
    first = np.searchsorted(shingles, edges)
    last = np.append(first[1:], len(shingles))
    filled = last > first
    minima = np.where(filled, shingles[np.minimum(first, len(shingles) - 1)], np.uint64(0))
    low = (densified(minima, filled) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << BITS | low[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated resemblance of two fingerprints, from 0 to 1; texts without words resemble each other only."""
    if not a or not b:
        return float(a == b)
    same = np.mean(np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8))
    chance = 0.5**BITS
    return max(0.0, float((same - chance) / (1 - chance)))


def _row(doc_id, text: str, mark: str, after: str, after_mark: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    edited_mark = mark if edited == text else fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each row with the one behind it in its cell; copies of the next cell's first row end a cell."""
    waiting = None
    for batch in batches:
        out = []
        for cell, copy, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("_cell", "_copy", "doc_id", "text")), strict=True):
            mark = fingerprint(text)
            if waiting is not None and waiting[0] == cell:
                out.append(_row(*waiting[1:], text, mark))
            waiting = None if copy else (cell, doc_id, text, mark)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def fingerprint_documents(docs: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and that to the next document.

    Documents follow each other by doc_id (NULL first), documents of one id by
    their text's hash; behind the last comes the first. NULL texts count as
    empty. Repeated rows are neighbours of each other. An empty table gives an
    empty result. Other columns are not kept.

    Texts are shuffled once, to cells of neighbouring ids of about
    ``rows_per_cell`` rows; the first row of each cell also goes to the cell
    before. Cell bounds are quantiles, 65 536 at most, so their size is fixed.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark, rows = docs.sparkSession, d.count()
    cells = max(1, min(MOST_CELLS, -(-rows // rows_per_cell)))
    bounds = []
    if cells > 1:
        cuts = [i / cells for i in range(1, cells)]
        bounds = d.select(F.percentile_approx("doc_id", cuts, 10 * cells).alias("q")).first().q or []
    edges = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def cell_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), side="right") + 1, dtype="int32")

    # NULL ids have a cell in front of all others
    cell = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(cell_of(F.coalesce("doc_id", F.lit(0))))
    placed = d.withColumn("_cell", cell).withColumn("_hash", F.xxhash64("text"))
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("_hash").alias("h"))
    # one row per cell, 65 537 at most
    firsts = stage(placed.groupBy("_cell").agg(F.min(key).alias("_first")))
    order = Window.orderBy("_cell")
    back = F.coalesce(F.lag("_cell").over(order), F.max("_cell").over(Window.partitionBy()))
    firsts = stage(firsts.withColumn("_before", back))
    copies = F.when(key == F.col("_first"), F.array(F.struct(F.col("_cell").alias("c"), F.lit(0).alias("x")), F.struct(F.col("_before").alias("c"), F.lit(1).alias("x"))))
    copies = copies.otherwise(F.array(F.struct(F.col("_cell").alias("c"), F.lit(0).alias("x"))))
    sent = placed.join(F.broadcast(firsts), "_cell").withColumn("_to", F.explode(copies))
    sent = sent.select(F.col("_to.c").alias("_cell"), F.col("_to.x").alias("_copy"), "doc_id", "_hash", "text")
    dealt = sent.repartition(partitions_for(spark, rows, 4 * rows_per_cell), "_cell")
    ordered = dealt.sortWithinPartitions("_cell", "_copy", "doc_id", "_hash")
    return ordered.select("_cell", "_copy", "doc_id", "text").mapInArrow(_walk, _RESULT)
