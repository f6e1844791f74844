"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplolake.llm import bpe, decontam, fingerprints, manifest, mixing, neardup, negatives, pii, quality, sharding, suffix, topk, toxicity
from haplolake.llm.common import documents, labels, remainder_of

TOKENIZER = "word_bpe_49k.json"


def _held_out():
    return (remainder_of(F.col("doc_id")) == 0).alias("held_out")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, folder))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.classify_quality(documents(spark, folder).select("doc_id", "text"), labels(spark, folder))
    return scored.select("doc_id", _held_out(), "score", "predicted")


def op3_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder), 4, 80)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_documents(documents(spark, folder).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(documents(spark, folder).select("doc_id", "text"))
    numbers = [pii.count_of("base", k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *numbers, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, folder))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.classify_toxicity(documents(spark, folder).select("doc_id", "text"), labels(spark, folder))
    return scored.select("doc_id", _held_out(), "score", "predicted")


def op6_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/embeddings.parquet").where(topk.usable(F.col("embedding")))
    e = e.select("vec_id", topk.scaled(F.col("embedding")).alias("ints"))
    return topk.top_k(e, e.where("vec_id % 50 = 0"), 5)


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    d = documents(spark, folder).select("doc_id", bpe.round_trip(F.col("text"), path).alias("r"))
    return d.select("doc_id", "r.*")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, folder), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.decontaminate(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/embeddings.parquet").where(topk.usable(F.col("embedding")) & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.select("vec_id", label.alias("label"), topk.scaled(F.col("embedding")).alias("ints"))
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.verified_manifest(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_neardup": op3_neardup,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_exact_topk": op6_exact_topk,
    "op7_fingerprints": op7_fingerprints,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
    "op11_decontamination": op11_decontamination,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_manifest": op13_manifest,
}


def _leaf_sql(text: str) -> str:
    fields = (f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text))
    return " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields)


ORACLE: dict[str, str] = {
    "op6_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda x: coalesce(x[1], 0) * coalesce(x[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op11_decontamination": r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p), d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT p FROM pattern)) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT p FROM pattern)) AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM win), pos AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)
), met AS (SELECT pos.r, pos.i, pos.k, win.item_id FROM pos JOIN win USING (win, k)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + k - 1)) AS j FROM met) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.ints, c.ints), lambda x: coalesce(x[1], 0) * coalesce(x[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS k
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10""",
    "op13_manifest": f"""
WITH RECURSIVE crc AS (
  SELECT *, row_number() OVER () AS r, coalesce('s' || source, '') AS k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 2 = 0 AS even
  FROM documents
), d AS (
  SELECT r, k, doc_id, sha256({_leaf_sql("text")}) AS leaf,
    sha256({_leaf_sql("(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")}) AS copy FROM crc
), leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d),
nodes AS (
  SELECT k, 0 AS l, idx, leaf AS d FROM leaves
  UNION ALL SELECT k, l + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM nodes) WHERE c > 1 GROUP BY k, l, idx // 3
), heights AS (SELECT k, max(l) AS h FROM nodes GROUP BY k),
subroots AS (SELECT k, d, row_number() OVER (ORDER BY k) - 1 AS idx FROM nodes JOIN heights USING (k) WHERE l = h),
tops AS (
  SELECT 0 AS l, idx, d FROM subroots
  UNION ALL SELECT l + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY l, idx // 3
), top AS (SELECT max(l) AS h FROM tops), root AS (SELECT d AS root FROM tops, top WHERE l = h),
fold AS (
  SELECT r, k, idx, 0 AS l, copy AS cur, '' AS proof FROM leaves
  UNION ALL SELECT f.r, f.k, f.idx // 3, f.l + 1, sha256(string_agg(CASE WHEN n.idx = f.idx THEN f.cur ELSE n.d END, '' ORDER BY n.idx)),
    f.proof || string_agg(CASE WHEN n.idx = f.idx THEN '' ELSE n.d END, '' ORDER BY n.idx)
  FROM fold f JOIN heights h ON h.k = f.k AND f.l < h.h JOIN nodes n ON n.k = f.k AND n.l = f.l AND n.idx // 3 = f.idx // 3 GROUP BY f.r, f.k, f.idx, f.l, f.cur, f.proof
), sub AS (SELECT f.* FROM fold f JOIN heights h ON h.k = f.k AND f.l = h.h),
above AS (
  SELECT s.r, t.idx, 0 AS l, s.cur, s.proof FROM sub s JOIN subroots t USING (k)
  UNION ALL SELECT f.r, f.idx // 3, f.l + 1, sha256(string_agg(CASE WHEN n.idx = f.idx THEN f.cur ELSE n.d END, '' ORDER BY n.idx)),
    f.proof || string_agg(CASE WHEN n.idx = f.idx THEN '' ELSE n.d END, '' ORDER BY n.idx)
  FROM above f JOIN top ON f.l < top.h JOIN tops n ON n.l = f.l AND n.idx // 3 = f.idx // 3 GROUP BY f.r, f.idx, f.l, f.cur, f.proof
)
SELECT doc_id, leaf, s.d AS subroot, root, sha256(a.proof) AS proof_sha256, a.cur AS folded_root, a.cur = root AS verified
FROM leaves JOIN subroots s USING (k) JOIN above a USING (r) JOIN top ON a.l = top.h, root""",
}
