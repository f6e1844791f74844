"""Sharding, search and encoding against brute force, and their edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haplolake.llm import bpe, sharding, topk

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 50, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = spark.range(n).select(sharding.feistel(F.col("id"), n, 3).alias("x")).collect()
    assert sorted(r.x for r in got) == list(range(n))


def test_shards_of_all_rows(spark):
    data = [(i, "t" * (i % 5)) for i in range(300)] + [(7, "hot")] * 200 + [(None, None), (None, None), (9, "é" * 1000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_rows(df, ["doc_id", "text"], 8, cell=16).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((a or -1, b or "") for a, b in data)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_rows(df.repartition(5), ["doc_id", "text"], 8, cell=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    docs = {(r.doc_id, r.size, r.text_crc32) for r in sharding.shard_documents(df).collect()}
    assert (None, 1, 0) in docs and (9, 2001, zlib.crc32(("é" * 1000).encode())) in docs
    assert sharding.shard_documents(df.limit(0)).count() == 0


def _brute(rows, k):
    best = {}
    for v, x in rows:
        if v is None or v % 50 or x is None:
            continue
        scores = {}
        for w, y in rows:
            if w is not None and w != v and y is not None:
                s = sum(a * b for a, b in zip(x, y, strict=False))
                scores[w] = max(scores.get(w, s), s)
        best[v] = sorted(((-s, w) for w, s in scores.items()))[:k]
    return sorted((v, i + 1, w, -s) for v, b in best.items() for i, (s, w) in enumerate(b))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(220)] + [(3, [1, 1, 1, 1, 1, 1])] * 3 + [(None, [1]), (400, []), (401, [2, 2])]
    df = spark.createDataFrame(rows, "vec_id long, ints array<long>").withColumn("score", F.lit(1))
    for c, q in ((4096, 512), (16, 2)):
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, c, q).collect()
        assert sorted(map(tuple, got)) == _brute(rows, 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    bad = spark.createDataFrame([([1.0, None],), (None,), ([float("nan")],), ([float("inf")],), ([0.5, -0.001],)], "e array<float>")
    assert [r.i for r in bad.where(topk.usable(F.col("e"))).select(topk.scaled(F.col("e")).alias("i")).collect()] == [[128, -1]]


def test_bpe_equals_the_library(spark):
    rng = np.random.default_rng(2)
    letters = list("abcdefghi thein  '.,é\x1c\xa0 İẞßσςΣ123٣語日本é😀")
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(400)]
    texts += ["".join(rng.choice(list("abceinrst"), rng.integers(1, 60))) for _ in range(1500)]
    texts += ["", None, "x<|endoftext|>y <|startoftext|>", "ab" * 40_000, "'s's'll x'd", " \n\t ", "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    library = Tokenizer.from_file(PATH)
    for r, text in zip(got, texts, strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want
        assert (r.n_tokens, r.decoded) == (len(want), library.decode(want, skip_special_tokens=False))
    assert bpe.encode(df.limit(0), PATH).count() == 0
