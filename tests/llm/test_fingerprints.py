"""Fingerprints against exact resemblance, and neighbours against a plain loop."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from haplolake.llm import fingerprints as P
from haplolake.llm.shingles import shingle_set


def test_likeness_is_near_the_resemblance():
    rng = random.Random(2)
    errors = []
    for _ in range(150):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([12, 40, 300, 2000]))]
        other = list(words)
        for _ in range(rng.choice([0, 1, 3, 20])):
            other[rng.randrange(len(other))] = "edit"
        a, b = shingle_set(" ".join(words), 5), shingle_set(" ".join(other), 5)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(P.likeness(P.fingerprint(" ".join(words)), P.fingerprint(" ".join(other))) - true)
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.08


def test_densification_fills_every_bin():
    for filled_at in ([0], [255], [3, 200]):
        filled = np.zeros(P.BINS, bool)
        filled[filled_at] = True
        out = P.densified(np.where(filled, np.arange(1, 257, dtype=np.uint64), np.uint64(0)), filled)
        assert set(out.tolist()) == {i + 1 for i in filled_at}


def test_neighbours(spark):
    rng = random.Random(5)
    rows = [(i * 3, " ".join(rng.choice(["a", "é", "cc", "ddd", "😀"]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(9, "same id"), (9, "same id"), (5, None), (7, "x" * 300_000), (2**60 + 1, "far"), (None, "no id")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)).withColumn("_cell", F.lit(1))
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r]))
    want = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(P.fingerprint, (t, edited, after))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, P.likeness(a, b), P.likeness(a, c)))
    for size in (512, 16):
        got = P.fingerprint_documents(df, size).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    one = P.fingerprint_documents(df.where("doc_id = 5 OR text = 'far'").limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert P.fingerprint_documents(df.limit(0)).count() == 0
