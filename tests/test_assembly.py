from pyspark.sql import functions as F

from haplolake.operators import assembly as B

BLOCKS = "ref string, qry string, ref_start int, ref_end int, qry_start int, qry_end int, errors int, offsets array<int>"


def call(spark, blocks, ref, qry, **kw):
    options = {"min_identity": 0, "min_length": 0, "max_variants_per_kb": 0, **kw}
    out = B.delta_variants(
        spark.createDataFrame(blocks, BLOCKS),
        spark.createDataFrame(ref, "contig string, seq string"),
        spark.createDataFrame(qry, "contig string, seq string"),
        **options,
    )
    return out


def test_snp_insertion_deletion(spark):
    ref = [("chr_snp", "ACGTACGT"), ("chr_ins", "ACGTACGT".replace("ACGTACGT", "AACGTCGT")), ("chr_del", "ACGTACGT")]
    ref = [("chr_snp", "ACGTACGT"), ("chr_ins", "AATTCCAA"), ("chr_del", "AAGTACCC")]
    qry = [("q_snp", "ATGTACGT"), ("q_ins", "AATTCCGAA"), ("q_del", "AAGCCC")]
    blocks = [
        ("chr_snp", "q_snp", 1, 8, 1, 8, 1, []),
        ("chr_ins", "q_ins", 1, 8, 1, 9, 1, [-7]),
        ("chr_del", "q_del", 1, 8, 1, 6, 2, [4, 1]),
    ]
    rows = call(spark, blocks, ref, qry).collect()
    got = sorted((r["chrom"], r["pos"], r["ref"], r["alts"][0]) for r in rows)
    assert got == [("chr_del", 3, "GTA", "G"), ("chr_ins", 6, "C", "CG"), ("chr_snp", 2, "C", "T")]
    assert all(r["fmt"] == {"GT": "1/1", "DP": "1", "AO": "1"} and r["qual"] == 60.0 for r in rows)


def test_identity_and_ambiguity(spark):
    ref, qry = [("c", "ACGTACGT")], [("q", "ATGTACGT"), ("p", "AGGTACGT")]
    near = ("c", "q", 1, 8, 1, 8, 0, [])
    assert call(spark, [near], ref, qry, min_identity=90).count() == 1
    assert call(spark, [("c", "q", 1, 8, 1, 8, 2, [])], ref, qry, min_identity=90).count() == 0
    both = [near, ("c", "p", 1, 8, 1, 8, 0, [])]
    assert call(spark, both, ref, qry).count() == 0
    assert call(spark, both, ref, qry, drop_ambiguous_positions=False).count() == 2


def test_reverse_query_and_small_chunks(spark):
    base = "ACGTTGCAACGGTTAACCGGATATCCGAGT"
    changed = base[:9] + "T" + base[10:15] + base[17:25] + "TTT" + base[25:]
    comp = changed[::-1].translate(str.maketrans("ACGT", "TGCA"))
    offsets = [16, 1, -9, -1, -1]  # two reference bases skipped, then three query bases
    for chunk in (4, 1024):
        forward = call(spark, [("c", "q", 1, 30, 1, 31, 6, offsets)], [("c", base)], [("q", changed)], chunk=chunk)
        backward = call(spark, [("c", "q", 1, 30, 31, 1, 6, offsets)], [("c", base)], [("q", comp)], chunk=chunk)
        want = [(10, base[9], "T"), (15, base[14:17], base[14]), (25, base[24], base[24] + "TTT")]
        for out in (forward, backward):
            assert sorted((r["pos"], r["ref"], r["alts"][0]) for r in out.collect()) == want


def paf(spark, *rows):
    return spark.createDataFrame(list(rows), "qname string, contig string, start bigint, end bigint, qstart int, qend int, mapq int, tags map<string,string>")


def test_paf_annotation(spark, variants):
    p = paf(spark, ("q", "chr1", 0, 100, 0, 100, 60, {"tp": "P", "s1": "100", "s2": "90"}))
    rows = {r["pos"]: r for r in B.annotate_paf(variants([(51, "A", "T"), (500, "A", "C")]), p).collect()}
    info = rows[51]["info"]
    assert float(info["ASM_S2_RATIO"]) == 0.9 and info["ASM_EDGE_DIST"] == "49" and info["ASM_LOWQUAL_REASON"] == "REPETITIVE_CHAIN"
    assert rows[51]["filters"] == ["LowQual"] and rows[51]["fmt"]["DP"] == "1"
    assert rows[500]["info"]["ASM_LOWQUAL_REASON"] == "NO_PAF_CONTEXT"


def test_paf_notes_are_built_once(spark, variants):
    p = paf(spark, ("q", "chr1", 0, 100, 0, 100, 60, {"tp": "P", "s1": "100", "s2": "90"}))
    v = variants([(51, "A", "T")]).withColumn("info", F.create_map(F.lit("ASM_TP"), F.lit("S"), F.lit("ASM_DV"), F.lit("1"), F.lit("DP"), F.lit("3")))
    out = B.annotate_paf(v, p)
    (info,) = (r["info"] for r in out.collect())
    assert (info["ASM_TP"], info["ASM_DV"], info["DP"], info["ASM_S1"]) == ("P", "1", "3", "100")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("map_from_entries(") == 1


def test_missing_regions(spark):
    contigs = spark.createDataFrame([("chr1", 100, 0), ("chr2", 50, 1)], "contig string, length bigint, ord int")
    p = paf(spark, ("q", "chr1", 10, 40, 0, 30, 60, {"tp": "P"}), ("q", "chr1", 40, 60, 0, 20, 60, {"tp": "S"}))
    assert sorted(map(tuple, B.missing_regions(p, contigs).collect())) == [("chr1", 0, 10), ("chr1", 40, 100), ("chr2", 0, 50)]
    coords = spark.createDataFrame([("c", 9, 3), ("c", 10, 12)], "contig string, s1 bigint, e1 bigint")
    assert [tuple(r) for r in B.coords_intervals(coords).collect()] == [("c", 2, 12)]


def test_position_filter(spark):
    blocks = spark.createDataFrame([("c", 1, 10), ("c", 20, 8)], "contig string, ref_start int, ref_end int")
    rows = spark.createDataFrame([("c", p) for p in (7, 8, 10, 11)], "chrom string, pos bigint")
    assert sorted(r["pos"] for r in B.drop_ambiguous(rows, blocks).collect()) == [7, 11]
    assert B.filter_blocks(B.block_metrics(spark.createDataFrame([(1, 8, 1, 8, 2)], "ref_start int, ref_end int, qry_start int, qry_end int, errors int")), 90, 0, 0).count() == 0
    assert F.col("x") is not None


def test_delta_variants_make_rows_of_differences_alone(spark, monkeypatch):
    """Forward and reversed blocks; a base that agrees never becomes a row."""
    plans, stage = [], B.stage
    monkeypatch.setattr(B, "stage", lambda df, **kw: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df, **kw))
    ref = "ACGTTGCAAC" * 30
    changed = ref[:50] + "T" + ref[51:170] + "G" + ref[171:]
    back = changed[::-1].translate(str.maketrans("ACGT", "TGCA"))
    blocks = spark.createDataFrame(
        [("c", "f", 1, 300, 1, 300, 2, []), ("d", "r", 1, 300, 300, 1, 2, [])],
        "ref string, qry string, ref_start int, ref_end int, qry_start int, qry_end int, errors int, offsets array<int>",
    )
    refs = spark.createDataFrame([("c", ref), ("d", ref)], "contig string, seq string")
    qry = spark.createDataFrame([("f", changed), ("r", back)], "contig string, seq string")
    got = B.delta_variants(blocks, refs, qry, min_identity=0, min_length=0, max_variants_per_kb=0, chunk=64).collect()
    want = [(p + 1, ref[p], changed[p]) for p in range(300) if ref[p] != changed[p]]
    assert want and sorted((r.chrom, r.pos, r["ref"], r.alts[0]) for r in got) == [(c, *w) for c in "cd" for w in want]
    assert not any("explode(sequence(1, length(" in p for p in plans)
