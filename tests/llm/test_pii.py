"""Personal data against a brute-force version of the base patterns, and the added spans."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from haplolake.llm import pii
from haplolake.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    return {"email": True, "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _ok(k, m.group())]


def _texts():
    rng = random.Random(9)
    parts = ["a.b@c-d.example.com", "x@y.z_w@q.r", "12.34.56.78", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111-1111 1111", "4111111111111112",
             "+1 (743) 555-3824", "+49 30 123456", "+1-", "é", "😀", " ", "\n", "a@b", "@", "a..b@c..d.e", "5", "%+-_.", "9" * 40, "+1 (743) 555-3824 4111111111111111", "1.2.3"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 9))) for _ in range(600)] + [None, "", "a" * 100_000, "1." * 30_000, "@" * 5000, "same a@b.co", "same a@b.co"]


def test_base_spans(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    got = pii.find_pii(df).select("doc_id", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s")).orderBy("doc_id").collect()
    assert [r.b.split(",") if r.b else [] for r in got] == [brute(t) for t in texts]
    assert all(set(r.b.split(",")) <= set(r.s.split(",")) for r in got)
    assert pii.find_pii(df.limit(0)).count() == 0


def test_added_spans_and_mask(spark):
    rows = [f"mail me{i}@host.org or call +1 (212) 555-{1000 + i} now" for i in range(40)]
    rows += ["phone (212) 555-0199 please", "write to jo (at) host (dot) com", "card 4111.1111.1111.1111", "plain words only", "version 1234.1234.1234.1234"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = [r.t for r in pii.find_pii(df).orderBy("doc_id").select(pii.masked(F.col("text"), F.col("spans")).alias("t")).collect()]
    assert got[0] == "mail [EMAIL] or call [PHONE] now"
    assert got[40:] == ["phone [PHONE] please", "write to [EMAIL]", "card [CARD]", "plain words only", "version 1234.1234.1234.1234"]


def test_query(spark):
    got = QUERIES["op5_pii"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(want)
    assert sum(len(r.spans.split(",")) for r in got if r.spans) < 1.2 * sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
