"""Wu-Manber search against a search word by word."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from haplolake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, size=10):
    out = []
    windows = {}
    for item, text in items:
        w = words_of(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w = words_of(text)
        hit, ids = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    ids |= windows[tuple(w[i : i + k])]
        names = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _tables():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "bb", "Zé", "x1", "the", "longerword", "日本", "0"]) + rng.choice(["", "", "q"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", " \x00"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(40)]
    items += [(100, None), (101, ""), (102, " ,. "), (103, items[3][1]), (3, text(12)), (None, text(15)), (104, "W" * 5000 + " end"), (105, items[39][1].upper())]
    docs = [(i, text(rng.choice([1, 5, 40, 300]))) for i in range(150)]
    for i in range(150, 260):
        docs.append((i, text(rng.randrange(20)) + " " + str(rng.choice(items)[1]) + " " + text(rng.randrange(20))))
    docs += [(900, None), (901, ""), (902, "!!"), (None, items[4][1]), (None, items[5][1]), (5, docs[200][1]), (5, docs[200][1]), (903, "a " * 30_000), (904, "x" + "W" * 5000 + " end"), (905, "W" * 5000 + "-end")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 2500])
def test_against_every_position(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontam.occurrences, "__defaults__", (decontam.SIZE, block_bytes))
    docs, items = _tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = sorted((tuple(r) for r in decontam.decontaminate(d, b).collect()), key=str)
    assert got == brute(docs, items)
    clean = sorted(str(r.doc_id) for r in decontam.without_hits(d, b).collect())
    assert clean == sorted(str(r[0]) for r in got if not r[-1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert sorted(map(str, decontam.decontaminate(docs, items.limit(0)).select("n_words", "n_hit").collect())) == ["Row(n_words=0, n_hit=0)", "Row(n_words=2, n_hit=0)"]
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


def test_long_patterns_jump():
    rng = random.Random(8)
    names = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    patterns = [(" " + " ".join(names[i : i + 10]) + " ").encode() for i in range(0, 2000, 7)]
    found = decontam.tables(patterns)
    assert len(found) == 1 and found[0].shift.mean() > 0.8 * (found[0].least - 8)
    data = b"\0" * 8 + (" " + " ".join(rng.choice(names) for _ in range(500)) + patterns[5].decode() + " ".join(names)).encode() + b" "
    start, which = decontam.search(data, patterns, found)
    want = {(m.start() - 8, i) for i, p in enumerate(patterns) for m in re.finditer(b"(?=" + re.escape(p) + b")", data)}
    assert set(zip(start.tolist(), which.tolist(), strict=True)) == want and len(start) == len(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="tables are not here")
def test_query(spark):
    from haplolake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_decontamination"](spark, folder).collect()), key=str)
    assert got == brute(docs, items) and any(r[-1] for r in got)
