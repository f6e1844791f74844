"""Suffix order and repeated windows against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from haplolake.llm import suffix


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 10, 31, 200, 1000])
@pytest.mark.parametrize("symbols", [1, 2, 5])
def test_suffix_order(n, symbols):
    text = np.random.default_rng(n).integers(1, symbols + 1, n)
    assert suffix.suffix_order(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def test_suffix_order_of_repeats():
    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(1, 4, 60)] * 5 + [rng.integers(1, 4, 100)] * 3 + [np.ones(200, np.int64)])
    assert suffix.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def brute(rows):
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        n_spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    common, copies = some(40), some(150)
    rows = [some(rng.randint(0, 120)) for _ in range(60)]
    rows += [some(20) + common[: rng.randint(90, len(common))] + some(30) for _ in range(120)]
    rows += [copies] * 30 + [copies[: rng.randint(50, len(copies))] + some(3) for _ in range(60)]
    for _ in range(40):
        edited = list(copies)
        edited[rng.randrange(len(edited))] = "#"
        rows.append("".join(edited))
    rows += ["x" * 99, "x" * 100, "x" * 101, "ab" * 400, "abc " * 300, "y" * 5000, some(30) * 6, None, "", copies.upper()]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("crowd", [(64, 256), (3, 5), (1000, 2), (1, 1)])
def test_against_brute_force(spark, monkeypatch, crowd):
    rows = _rows()
    expected = brute(rows)
    # the limits are read inside the workers, so the functions are tried here without Spark
    monkeypatch.setattr(suffix, "IN_BATCH", crowd[0])
    monkeypatch.setattr(suffix, "IN_GROUP", crowd[1])
    monkeypatch.setattr(suffix, "SORTED_BYTES", 30_000)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"doc": [d for d, _ in part], "text": pa.array([t for _, t in part], pa.string())}) for part in (rows[0::3], rows[1::3], rows[2::3])]
    found = pa.Table.from_batches(suffix._find(iter(batches)), suffix._ROW).sort_by([(c, "ascending") for c in ("anchor", "content", "doc", "at")])
    settled = [r for b in suffix._settle(iter(found.to_batches(max_chunksize=50))) for r in b.to_pylist()]
    texts = dict(rows)
    wanted = {}
    for r in settled:
        if r["kind"] in (suffix.CONTEXT, suffix.CROWDED):
            wanted.setdefault(r["doc"], []).append({k: r[k] for k in ("kind", "anchor", "at", "n")})
    again = pa.RecordBatch.from_pylist([{"doc": d, "text": texts[d], "wanted": w} for d, w in wanted.items()])
    cut = pa.Table.from_batches(suffix._cut(iter([again] if wanted else [])), suffix._BYTES)
    shared = cut.filter(pa.compute.is_valid(cut["bytes"])).sort_by("anchor")
    runs = [r for b in suffix._sort(iter(shared.to_batches(max_chunksize=40))) for r in b.to_pylist()]
    loose = cut.filter(pa.compute.is_null(cut["bytes"])).to_pylist()
    runs += [{"doc": r["doc"], "at": r["at"], "n": 1} for r in loose if r["anchor"] is None]
    windows = [(r["anchor"], r["content"], r["doc"], r["at"]) for r in loose if r["anchor"] is not None]
    windows += [(r["anchor"], r["content"], r["doc"], r["at"]) for r in settled if r["kind"] == suffix.WINDOW]
    earliest = {}
    for a, c, d, p in windows:
        earliest[a, c] = min(earliest.get((a, c), (d, p)), (d, p))
    runs += [{"doc": d, "at": p, "n": 1} for a, c, d, p in windows if earliest[a, c] != (d, p)]
    runs += [r for r in settled if r["kind"] == suffix.COPY]
    of = {}
    for r in runs:
        of.setdefault(r["doc"], []).append({"at": r["at"], "n": r["n"]})
    last = pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": pa.array(list(texts.values()), pa.string()), "runs": [of.get(d) for d in texts]})
    assert sorted((tuple(r.values()) for b in suffix._remove(iter([last])) for r in b.to_pylist()), key=str) == expected


def test_on_spark(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchor", F.lit("clash")).repartition(5)
    assert sorted(map(tuple, suffix.remove_repeats(df).collect()), key=str) == brute(rows)
    text = "0123456789" * 30
    odd = spark.createDataFrame([(None, text), (4, text), (4, text), (4, "other" + text)], "doc_id long, text string")
    got = suffix.remove_repeats(odd).collect()
    assert len(got) == 4 and {r.n_removed for r in got if r.doc_id is None} == {300}
    assert suffix.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_repeated_rows_are_one_document(spark, parts):
    rows = _rows()
    repeated = spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(parts)
    got = sorted(map(tuple, suffix.remove_repeats(repeated).collect()), key=str)
    assert got == sorted(brute(rows) * 3, key=str)


def test_lists_are_bounded_by_one_text(spark, monkeypatch):
    texts = [t for _, t in _rows()]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    tags = {t: r.tag for t, r in zip(texts, suffix._with_tag(df.coalesce(1)).select("tag").collect(), strict=True)}
    assert all(suffix._tag((t or "").encode()) >> suffix._OFFSET_BITS == tag for t, tag in tags.items())
    most, remove = spark.sparkContext.accumulator(0), suffix._remove

    def watched(batches):
        for batch in batches:
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                most.add(sum(r["at"] - suffix._tag((text or "").encode()) not in range(len((text or "").encode())) for r in runs or []))
            yield from remove(iter([batch]))

    monkeypatch.setattr(suffix, "_remove", watched)
    ordered = sorted(set(texts), key=lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42))
    got = {tuple(r)[1:] for r in suffix.remove_repeats(df).collect()}
    assert most.value == 0  # no row is given runs of another text
    assert got == {r[1:] for r in brute([(0, t) for t in ordered])}


def test_repeated_rows_in_a_crowd_and_in_one_sort():
    first = np.array([True, False, False, True, False])
    assert suffix._later(first, np.array([1, 1, 2, 3, 3]), np.array([5, 5, 5, 0, 9])).tolist() == [False, False, True, False, True]
    same = np.array([[1, 1, 1], [7, 7, 7], [4, 4, 5], [0, 0, 0]])
    earliest, later = suffix._earliest(same)
    assert earliest[2].tolist() == [4] and later[2].tolist() == [5]
    text = bytes(range(1, 121))
    own, off = suffix.repeated([text, text, text], np.array([4, 4, 5]), np.array([0, 0, 0]))
    assert len(own) == 21 and set(own.tolist()) == {2}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables are not here")
def test_query(spark):
    from haplolake.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = QUERIES["op1_suffix_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)


def test_texts_without_id_whose_tags_agree(spark):
    seen, pair = {}, None
    for i in range(400_000):
        text = f"{i} " + "".join(chr(97 + (i * k + k * k * 7) % 26) for k in range(20))
        at = suffix._tag((text * 12).encode())
        if at in seen:
            pair = seen[at] * 12, text * 12
            break
        seen[at] = text
    assert pair is not None
    rows = [(1, pair[0]), (None, pair[0]), (None, pair[1])]
    got = {(r.doc_id, r.kept_sha256): r.n_removed for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone = suffix.remove_repeats(spark.createDataFrame([(1, pair[1])], "doc_id long, text string")).first()
    assert got[None, alone.kept_sha256] == alone.n_removed and len(got) == 3
