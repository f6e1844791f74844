"""Labelled texts for fitting models: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.llm.common import remainder_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held_out: int = 0) -> DataFrame:
    """``text`` and ``y`` of up to ``per_class`` labelled documents of each class.

    Rows whose crc32 remainder by 5 is ``held_out`` take no part. The sample is
    that of the smallest hashes of doc_id, so it does not depend on row order,
    and its size is the bound: 2 * per_class ids are broadcast, never more.
    NULL labels and NULL ids take no part; an id that is labelled twice counts once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & (remainder_of(F.col("doc_id")) != held_out))
    picked = None
    for y in (0, 1):
        ids = known.where(F.col(label) == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = ids.select("doc_id", F.lit(y).alias("y"))
        picked = ids if picked is None else picked.unionByName(ids)
    one = picked.groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(one), "doc_id").select("doc_id", "text", "y")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, held_out: int = 0, tasks: int | None = None) -> DataFrame:
    """``doc_id``, ``text`` and ``y`` of every labelled document outside the held-out fold; an id with both labels counts as 1.

    With ``tasks`` both sides are dealt by doc_id into so many partitions, which
    the join keeps: texts are shuffled once, however large the labels are.
    """
    used = F.col("doc_id").isNotNull() & (remainder_of(F.col("doc_id")) != held_out)
    known = labels.where(used & F.col(label).isin(0, 1)).select("doc_id", label)
    texts = docs.where(used).select("doc_id", "text")
    if tasks is not None:
        known, texts = known.repartition(tasks, "doc_id"), texts.repartition(tasks, "doc_id")
    return texts.join(known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")), "doc_id")
