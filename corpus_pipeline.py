"""A training corpus from raw documents: quality, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.llm import bpe, mixing, neardup, pii, quality
from haplolake.llm.common import documents, labels
from haplolake.session import stage

TOKENIZER = "word_bpe_49k.json"


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    model = quality.fit_quality(docs, labels(spark, sf_dir))
    scored = docs.withColumn("_quality", quality.quality_score(F.col("text"), model))
    return scored.where(F.col("_quality") >= quality.CUT).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity from 0.8 on)."""
    return neardup.survivors(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind; ``n_chars`` follows the new text."""
    # the row travels as one column, so that columns of any name survive
    rows = docs.select("text", F.struct(*docs.columns).alias("_row"))
    clean = pii.find_pii(rows, pii.fit_pii(docs)).withColumn("_clean", pii.masked(F.col("text"), F.col("spans")))
    size = F.when(F.size("spans") > 0, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars"))
    return clean.select(F.col("_row").withField("text", F.col("_clean")).withField("n_chars", size).alias("_row")).select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take are gone."""
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    mixed = mixing.mix_documents(rows).where("copies > 0")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text they decode to."""
    return bpe.encode_and_decode(docs, public_tokenizers.path(TOKENIZER), ["doc_id", "lang", "source"])


STAGES = [("quality", accept), ("near_duplicates", deduplicate), ("personal_data", mask), ("mixing", mix), ("encoding", encode)]

# The trained scores and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
