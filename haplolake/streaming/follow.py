"""Filters that act on single records, run over a folder in which files keep landing.

Only operators without state belong here: each record is decided by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from haplolake.operators.alignments import clip_filter
from haplolake.operators.variants import short_read_filters


def _follow(source: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    return work(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_clip_filter(
    spark: SparkSession, folder: str, schema: str, contigs: DataFrame, target: str, checkpoint: str, max_clip: int = 10
) -> StreamingQuery:
    """Clip-filter alignment tables (Parquet) as they land; mates are not looked at."""
    arriving = spark.readStream.schema(schema).parquet(folder)
    return _follow(arriving, lambda a: clip_filter(a, contigs, max_clip, fix_mate=False), target, checkpoint)


def follow_soft_filters(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, min_qual: float = 100.0, min_depth: int = 10) -> StreamingQuery:
    """Soft-filter variant tables (Parquet) as they land."""
    arriving = spark.readStream.schema(schema).parquet(folder)
    return _follow(arriving, lambda v: short_read_filters(v, min_qual, min_depth).withColumn("filter", F.array_join("filters", ";")), target, checkpoint)
