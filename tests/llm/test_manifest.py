"""The manifest against trees built on the whole list."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from haplolake.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def brute(rows):
    groups = {}
    for r in rows:
        text = r[4]
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups.setdefault(r[1], []).append((r[0], h(*map(field, r)), h(*map(field, (*r[:4], text)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (doc, leaf, copy) in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, at)
            node = copy
            for left, right in steps:
                node = h(left, node, right)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], h(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def _rows():
    rows = [(i, "hot", "en", i % 7, f"line {i}\nnext é" if i % 3 else f"plain {i}") for i in range(400)]
    for n, s in enumerate(["", None, "é", "z", "Z", "a", "aa", "s", "b c"]):
        rows += [(1000 * (n + 1) + i * 3, s, None if i % 2 else "de", None, None if i % 5 == 0 else "t\n" * (i % 4)) for i in range([1, 2, 3, 4, 27, 28, 81, 82, 10][n])]
    rows += [(None, "hot", None, None, None)] * 3 + [(None, "z", "x", 1, "a\nb"), (7, "hot", "en", 0, "again"), (7, "hot", "en", 0, "again"), (None, None, None, None, "long " * 100_000)]
    return rows


@pytest.mark.parametrize("n", [None, 1, 3, 4])
def test_against_whole_trees(spark, n, monkeypatch):
    monkeypatch.setattr(manifest, "PER_TASK", 50)
    rows = _rows()[:n]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("g", F.lit(1)).repartition(5)
    got = manifest.verified_manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_proofs_hold_and_break(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    got = manifest.manifest(df, ["doc_id", "text"], "source", "doc_id")
    right = manifest.root_from(F.col("leaf"), F.col("proof")) == F.col("root")
    wrong = manifest.root_from(F.sha2("leaf", 256), F.col("proof")) == F.col("root")
    assert {tuple(r) for r in got.select(right, wrong).collect()} == {(True, False)}
    assert manifest.verified_manifest(df.limit(0)).count() == 0


def test_height(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 9, 10, 27, 28, 3**20, 3**20 + 1)], "n long").select("n", manifest.height(F.col("n")).alias("h")).collect()
    assert [r.h for r in got] == [0, 1, 1, 2, 2, 3, 3, 4, 20, 21]
