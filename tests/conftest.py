import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from haplolake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", spark_sql_shuffle_partitions="4", spark_driver_memory="8g", spark_ui_enabled="false")
    session.sparkContext.setLogLevel("OFF")
    yield session


V_SCHEMA = (
    "sample string, chrom string, pos bigint, id string, ref string, alts array<string>, qual double, filters array<string>, "
    "info map<string,string>, fmt map<string,string>, rec_no bigint"
)


@pytest.fixture(scope="session")
def variants(spark):
    """Builder: (pos, ref, alt[, info, gt, filter]) rows on chr1 of sample s."""

    def build(rows, chrom="chr1", sample="s"):
        data = []
        for i, row in enumerate(rows):
            pos, ref, alt, info, gt, flt = [*row, *[None] * (6 - len(row))]
            data.append((sample, chrom, pos, ".", ref, alt.split(","), 60.0, [flt or "PASS"], info or {}, {"GT": gt or "1/1"}, i))
        return spark.createDataFrame(data, V_SCHEMA)

    return build


@pytest.fixture(scope="session")
def reads(spark):
    """Builder: (qname, flag, pos, cigar, seq) rows on chr1."""

    def build(rows, rname="chr1"):
        data = [(q, f, rname, p, 60, c, "*", 0, 0, s, "I" * len(s), {}) for q, f, p, c, s in rows]
        return spark.createDataFrame(
            data, "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
        )

    return build
