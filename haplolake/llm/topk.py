"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates and queries are dealt into blocks of bounded size. In each cell (one
block of either) the candidates become postings by dimension; every query term
scatters its weighted postings into a dense array of integer scores; a partition
selection keeps each query's best; the cells' lists are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 4096, 512


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, as LONG."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def usable(vector: Column) -> Column:
    """True for a vector without NULL, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & fine


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each query's k best, ties to the smaller id; ``ids`` ascend. Its own row is left out."""
    for q in range(scores.shape[0]):
        row = scores[q]
        open_ = np.flatnonzero(ids != own[q])
        if len(open_) > k:
            part = row[open_]
            least = np.partition(part, len(part) - k)[len(part) - k]
            open_ = open_[part >= least]
        order = np.lexsort((ids[open_], -row[open_]))[:k]
        yield q, open_[order]


def _cell(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    c, q = candidates.sort_values("vec_id", kind="stable"), queries.sort_values("vec_id", kind="stable")
    names, first = np.unique(c["vec_id"].to_numpy(), return_index=True)
    postings: dict[int, tuple[list[int], list[int]]] = {}
    lengths = c["ints"].map(len).to_numpy()
    row = np.repeat(np.arange(len(c)), lengths)
    term = np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else np.empty(0, np.int64)
    weight = np.concatenate(list(c["ints"])).astype(np.int64) if len(row) else np.empty(0, np.int64)
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order][weight[order] != 0], term[order][weight[order] != 0], weight[order][weight[order] != 0]
    starts = np.searchsorted(term, np.arange(int(term.max()) + 2 if len(term) else 1))
    postings = {d: (row[a:b], weight[a:b]) for d, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if b > a}
    scores = np.zeros((len(q), len(c)), np.int64)
    for i, ints in enumerate(q["ints"]):
        ints = np.asarray(ints, np.int64)
        for d in np.flatnonzero(ints):
            if (posting := postings.get(int(d))) is not None:
                scores[i, posting[0]] += ints[d] * posting[1]
    if len(first) < len(c):  # several vectors under one id: the best of them counts
        scores = np.maximum.reduceat(scores, first, axis=1)
    asked = q["vec_id"].to_numpy()
    out = [(int(asked[i]), int(names[j]), int(scores[i, j])) for i, best in _best(scores, names, asked, k) for j in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, candidate_block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """Each query's ``k`` highest inner products over (vec_id, ints) rows, ties to the smaller vec_id.

    The query's own id is no candidate. Repeated rows count once; several vectors
    under one id are one item whose best score counts. Missing trailing
    components are zero. Rows with a NULL id take no part. Empty tables give an
    empty result; a query with fewer than ``k`` candidates gets them all.
    """
    spark = candidates.sparkSession
    c = candidates.select("vec_id", "ints").where("vec_id IS NOT NULL").distinct()
    q = queries.select("vec_id", "ints").where("vec_id IS NOT NULL").distinct()
    c_blocks, q_blocks = (max(1, -(-d.count() // n)) for d, n in ((candidates, candidate_block), (queries, query_block)))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("cb", block(c_blocks)).withColumn("qb", every(q_blocks))
    q = q.withColumn("qb", block(q_blocks)).withColumn("cb", every(c_blocks))
    tasks = min(c_blocks * q_blocks, 4096)
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = (
        c.repartition(tasks, "cb", "qb").groupBy("cb", "qb").cogroup(q.repartition(tasks, "cb", "qb").groupBy("cb", "qb"))
        .applyInPandas(lambda a, b: _cell(a, b, k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return merged.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
