"""First lines of any length, files that can't be read, and malformed delta text."""

import gzip
import struct

import pytest
from pyspark.errors import PySparkException

from haplolake import sources as IO
from haplolake.operators import samples as P


def test_long_first_lines(spark, tmp_path):
    long = "@" + "x" * 300_000
    (tmp_path / "a.fq").write_text(long + "\nACGT\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt", compresslevel=1) as f:
        f.write(long + "\nACGT\n")
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(b"@whole")[:-9])
    (tmp_path / "d.txt").write_text("no newline")
    got = {r.path.rsplit("/", 1)[1]: (r.first_line, r.error) for r in IO.scan_files(spark, str(tmp_path)).collect()}
    assert got["a.fq"] == got["b.fq.gz"] == (long, None) and got["d.txt"] == ("no newline", None)
    assert set(got) == {"a.fq", "b.fq.gz", "c.fq.gz", "d.txt"} and (got["c.fq.gz"][0] == "@whole" or got["c.fq.gz"][1])


@pytest.mark.parametrize("text", ["/a /b\nPROMER\n>r q 9 9\n1 9 1 9 0 0 0\n0\n", "/a /b\nNUCMER\n>r q 9 9\n1 9 1 9 0 0 0\n1\n0\n"])
def test_malformed_delta(spark, tmp_path, text):
    (tmp_path / "x.delta").write_text(text)
    with pytest.raises(PySparkException, match="delta"):
        IO.read_delta(spark, str(tmp_path / "x.delta")).collect()


def record(flag=0, bases=100, cigar="9M"):
    return f"r\t{flag}\tc\t1\t60\t{cigar}\t*\t0\t0\t{'A' * bases or '*'}\t*\n"


def bam(header, records):
    """BAM bytes of (flag, operations, bases) records with one reference."""
    out = b"BAM\1" + struct.pack("<i", len(header)) + header.encode() + struct.pack("<ii", 1, 2) + b"c\0" + struct.pack("<i", 9)
    for flag, operations, bases in records:
        body = b"r\0" + bytes(4 * operations) + bytes((bases + 1) // 2) + bytes(bases)
        out += struct.pack("<iiiBBHHHi", 32 + len(body), 0, 0, 2, 60, 0, operations, flag, bases) + struct.pack("<iii", -1, -1, 0) + body
    return gzip.compress(out[:70]) + gzip.compress(out[70:])  # packed in several members, as such files are


def test_discovery_of_alignments(spark, tmp_path):
    head = "@HD\tVN:1.6\n"
    texts = {
        "short.sam": head + record() + record(256, 5000) + record(0, 150) + record(4, 7000),
        "long.sam": head + record(0, 900) + "@odd line\n" + record(16, 1000),
        "platform.sam": head + "@RG\tID:x\tPL:illumina\n" + record(0, 5000),
        "preset.sam": "@PG\tID:m\tCL:mm2 -x map-ont\n" + record(),
        "unmapped.sam": head + record(4) + record(),
        "no_cigar.sam": head + record(cigar="*") + record(),
        "secondary.sam": head + record(256),
        "no_bases.sam": head + record(0, 0),
        "header_only.sam": head,
        "no_header.sam": record(0, 2000),
        "broken.sam": "x\ty\n" + record(),
        "windows.sam": "@RG\tID:x\tPL:ONT\r\n" + record().replace("\n", "\r\n"),
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "packed.sam.gz").write_bytes(gzip.compress((head + record(0, 3000) * 3).encode()))
    (tmp_path / "a.bam").write_bytes(bam("@HD\tVN:1.6\n", [(0, 1, 1200), (256, 1, 10), (0, 1, 1300)]))
    (tmp_path / "u.bam").write_bytes(bam("@HD\tVN:1.6\n", [(4, 0, 1200)]))
    (tmp_path / "p.bam").write_bytes(bam("@RG\tID:x\tPL:ILLUMINA\n", []))
    (tmp_path / "c.cram").write_bytes(b"CRAM\3\0")
    (tmp_path / "cut.bam").write_bytes(gzip.compress(b"BAM\1\x09"))
    (tmp_path / "r_1.fq").write_text("@read\nA\n+\nI\n")
    files = IO.scan_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.median_length) for r in P.classify_files(files).collect()}
    assert got == {
        "short.sam": ("ILL", 150), "long.sam": ("ONT", 1000), "platform.sam": ("ILL", 5000), "preset.sam": ("ONT", 100), "unmapped.sam": (None, None),
        "no_cigar.sam": (None, None), "secondary.sam": (None, None), "no_bases.sam": (None, None), "header_only.sam": (None, None), "no_header.sam": ("ONT", 2000),
        "broken.sam": (None, None), "windows.sam": ("ONT", 100), "packed.sam.gz": ("ONT", 3000), "a.bam": ("ONT", 1300), "u.bam": (None, None), "p.bam": ("ILL", None),
        "c.cram": (None, None), "cut.bam": (None, None), "r_1.fq": ("ILL", None),
    }
    assert {r.path.rsplit("/", 1)[1] for r in files.filter("error IS NOT NULL").collect()} == {"c.cram", "cut.bam"}
    sheet = P.build_sample_sheet(P.resolve_sample_ids(P.pair_reads(P.with_sample_ids(P.classify_files(files)))))
    rows = {r["sample"]: (r["type"], r["bam"] and r["bam"].rsplit("/", 1)[1], r["error"]) for r in sheet.collect()}
    assert rows["a"] == ("long", "a.bam", None) and rows["p"] == ("short", "p.bam", None) and rows["short"][1] == "short.sam"
    few = IO.scan_files(spark, str(tmp_path), records=1).filter("path LIKE '%/short.sam'").first()
    assert few["median_length"] == 100 and few["header"] == "@HD\tVN:1.6"


def test_peek_at_stored_contents(spark):
    rows = [("a.sam", record(0, 30).encode()), ("b.fa.gz", gzip.compress(b">c\nA\n")), ("c.sam", b""), ("d.sam", None), ("e.sam", gzip.compress(b"@HD\n" * 99)[:-12])]
    got = {r.path: (r.first_line and r.first_line[:3], r.median_length) for r in IO.peek_contents(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.sam"] == ("r\t0", 30) and got["b.fa.gz"] == (">c", None) and got["c.sam"] == ("", None) and set(got) == {p for p, _ in rows}
