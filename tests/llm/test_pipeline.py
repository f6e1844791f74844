"""The pipeline's stages against brute-force versions on the same input."""

import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from haplolake.llm import mixing, quality
from haplolake.llm.common import documents, labels
from haplolake.session import stage
from test_neardup import brute as near_brute
from test_pii import brute as pii_brute

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


def test_stages(spark):
    docs, kept = documents(spark, FOLDER), []
    columns = docs.columns
    for _, step in P.STAGES:
        kept.append(docs)
        docs = stage(step(spark, docs, FOLDER))
        assert step is P.encode or docs.columns == columns
    raw, good, single, masked, mixed, encoded = [d.collect() for d in [*kept, docs]]

    model = quality.fit_quality(documents(spark, FOLDER), labels(spark, FOLDER))
    accepted = {r.doc_id for r in raw if model.score(quality.features(r.text)[None])[0] >= quality.CUT}
    assert {r.doc_id for r in good} == accepted and 0.5 < len(good) / len(raw) < 1

    groups = near_brute([(r.doc_id, r.text) for r in good], 5, 80)
    assert sorted(r.doc_id for r in single) == sorted(d for d, n, _, keep in groups if keep or n == 0)

    before = {r.doc_id: r for r in single}
    assert len(masked) == len(single) and any(pii_brute(r.text) for r in single)
    for r in masked:
        assert not pii_brute(r.text) and r.n_chars == len(r.text)
        assert pii_brute(before[r.doc_id].text) or r.text == before[r.doc_id].text

    sizes = {}
    for r in masked:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    wanted, taken = mixing.targets(sizes), dict.fromkeys(sizes, 0)
    for r in mixed:
        taken[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in masked)
    assert all(abs(taken[s] - wanted[s]) <= longest / 2 + 1 for s in sizes)

    library = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    ids = {r.doc_id: r for r in encoded}
    assert len(encoded) == len(mixed)
    for r in mixed:
        want = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(ids[r.doc_id].token_ids, "<u4").tolist() == want and ids[r.doc_id].decoded == library.decode(want, skip_special_tokens=False)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "mail a@b.org now please do", "en", "a", 26),
            (3, "mail a@b.org now please do", "en", "a", 26), (None, "x" * 100_000, "en", "b", 100_000), (4, "word " * 30_000, "en", "a", 150_000)]
    docs = spark.createDataFrame(rows, schema)
    assert P.deduplicate(spark, docs, FOLDER).count() == 6
    texts = {r.text for r in P.mask(spark, docs, FOLDER).collect()}
    assert "mail [EMAIL] now please do" in texts and None in texts
    for _, step in P.STAGES:
        assert step(spark, docs.limit(0), FOLDER).count() == 0
        assert step(spark, docs, FOLDER).count() > 0


def test_clashing_columns_survive(spark):
    docs = documents(spark, "/root/testdata/sf0.001").selectExpr("*", "doc_id AS size", "doc_id AS copies", "'x' AS base", "doc_id AS spans", "0 AS score", "doc_id AS target")
    for _, step in P.STAGES[:-1]:
        got = step(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns and got.count() > 50
        assert got.where("size <> doc_id OR copies <> doc_id OR base <> 'x' OR spans <> doc_id OR score <> 0 OR target <> doc_id").count() == 0


def test_run_is_the_chain(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 50 and got.where("n_tokens IS NULL OR decoded IS NULL").count() == 0
