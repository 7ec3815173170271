"""Functions, joins, index, demultiplexing, models, duplicates and statistics on small fixtures."""

import random
from itertools import product

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandlake.functions import score as sc
from strandlake.functions import sequence as sq
from strandlake.operators import build, demux, fragments, index, joins, packed, seeds, stats, template
from strandlake.plans import alignments, reads
from strandlake.plans.masks import parse_bases_mask


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


# --- functions ---------------------------------------------------------------------------------


def test_sequence_functions(spark):
    rng = random.Random(1)
    seqs = [dna(rng, rng.randint(1, 31)) for _ in range(50)] + ["ACGTN", None, ""]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    for r in df.select("s", sq.reverse_complement(sq.reverse_complement(F.col("s"))).alias("rr"), sq.pack(F.col("s")).alias("p"), F.length("s").alias("n")).collect():
        assert r["rr"] == r["s"]
        if r["s"] and "N" not in r["s"]:
            want = 0
            for b in r["s"]:
                want = want * 4 + "ACGT".index(b)
            assert r["p"] == want
        else:
            assert r["p"] is None
    got = one(spark, a=sq.unpack(F.lit(27), 4), h=sq.hamming(F.lit("ACGT"), F.lit("AGGA")), e=sq.hamming(F.lit("A"), F.lit("AG")), m=sq.mismatches(F.lit("nCGT"), F.lit("ACNT")), c=sq.clip_to_matches(F.lit("TTACGTAC"), F.lit("GGACGTAC")), pm=sq.packed_mismatches(F.lit(0b0001), F.lit(0b1000)))
    assert got == Row(a="ACGT", h=2, e=None, m=1, c=2, pm=2)


def test_base_calls_round_trip(spark):
    for base, q in product("ACGT", (1, 2, 40, 63)):
        b, quality = sq.from_bcl(sq.to_bcl(F.lit(base), F.lit(q)))
        assert one(spark, b=b, q=quality) == Row(b=base, q=q)
    b, quality = sq.from_bcl(sq.to_bcl(F.lit("N"), F.lit(40)))
    assert one(spark, b=b, q=quality) == Row(b="N", q=0)


def test_cigar(spark):
    ops = sq.cigar_ops(F.lit("3S65M1I8M3D23M2H"))
    assert one(spark, t=sq.cigar_text(ops), r=sq.read_length(ops), m=sq.mapped_length(ops), w=sq.cigar_word(F.lit(5), F.lit("S"))) == Row(t="3S65M1I8M3D23M2H", r=100, m=99, w=5 << 4 | 4)
    none = sq.cigar_ops(F.lit(""))
    assert one(spark, r=sq.read_length(none)) == Row(r=0)


def test_barcode_variants(spark):
    got = one(spark, v=sq.variants(F.lit("AAAA")), w=sq.variants(F.lit("AA-A")))
    assert len(got["v"]) == 20 and len(set(got["v"])) == 17 and "CAAA" in got["v"] and len(got["w"]) == 15


def trimmed(q, cutoff=25):
    total = peak = cut = 0
    for i, x in enumerate(reversed(q[35:]), 1):
        total += cutoff - x
        if total < 0:
            break
        if total > peak:
            peak, cut = total, i
    return len(q) - cut


def test_quality_trim_against_loop(spark):
    rng = random.Random(2)
    quals = [[rng.randint(0, 41) for _ in range(rng.randint(0, 80))] for _ in range(80)] + [[2] * 60, [40] * 60, [25] * 60, []]
    df = spark.createDataFrame([(q,) for q in quals], "q array<tinyint>")
    got = [r["k"] for r in df.select(sq.trimmed_length(F.col("q")).alias("k")).collect()]
    assert got == [trimmed(q) if len(q) > 35 else len(q) for q in quals]


def test_quality_bins(spark):
    got = [r[0] for r in spark.range(64).select(sq.binned_quality(F.col("id"))).collect()]
    assert [got[i] for i in (0, 1, 2, 9, 10, 19, 20, 24, 25, 29, 30, 34, 35, 39, 40, 63)] == [0, 1, 6, 6, 15, 15, 22, 22, 27, 27, 33, 33, 37, 37, 40, 40]


def test_scores(spark):
    got = one(
        spark,
        f=sc.bam_flag(paired=F.lit(True), reverse=F.lit(True), duplicate=F.lit(None).cast("boolean")), b=sc.bam_bin(F.lit(16383), F.lit(16385)), b2=sc.bam_bin(F.lit(0), F.lit(1)),
        q=sc.mapq(F.lit(10), F.lit(70), F.lit(True)), p=sc.mapq(F.lit(10), F.lit(70), F.lit(True), pessimistic=True), u=sc.mapq(F.lit(10), F.lit(None).cast("int"), F.lit(True), unknown=255), i=sc.mapq(F.lit(10), F.lit(70), F.lit(False)),
        s=sc.phred(F.lit(0.001), F.lit(0.999)), m=sc.model(F.lit(False), F.lit(True), F.lit(True)), t=sc.signed_length(F.lit(5), F.lit(5), F.lit(9), F.lit(False)),
    )
    assert got == Row(f=17, b=585, b2=4681, q=60, p=10, u=255, i=10, s=30, m=5, t=-9)
    number = sc.seed_id(F.lit(9), F.lit(3), F.lit(70000), F.lit(5), F.lit(True))
    assert one(spark, **sc.seed_parts(number)) == Row(tile=9, barcode=3, cluster=70000, seed=5, reverse=True)
    assert one(spark, n=sc.seed_id(F.lit(4096), F.lit(3), F.lit(7), F.lit(5), F.lit(True))) == Row(n=None)


def test_seed_ids_of_all_tiles(spark, tmp_path):
    rows = [(7, 1, x, 5, 12.0, "A", "F", 0.0, 1.0) for x in (1, 2047, 2048, 4095, 4096, 8191)]
    columns = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string, l_discount double, l_extendedprice double"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["tile"]: (r["seed_id"], r["barcode"]) for r in alignments.m05_seed_ids(spark, str(tmp_path)).collect()}
    assert got == {t: ((t - (4096 if t > 2047 else 0) << 52) | 12 << 40 | 7 << 9 | 3, 12) for t in (1, 2047, 2048, 4095, 0)}


def test_scores_and_kmers_of_whole_reads(spark, tmp_path):
    rng = random.Random(12)
    rows = [(1, c, n, dna(rng, length), [rng.randint(2, 40) for _ in range(length)]) for c in range(12) for n, length in ((1, rng.choice([20, 31, 33, 75])), (2, rng.choice([20, 40, 75])))]
    rows += [(1, 50, 1, "A" * 60, [30] * 60), (1, 50, 2, "A" * 40 + "C" * 10, [30] * 50), (1, 51, 1, "ACGT" * 9, [20] * 36), (1, 52, 1, None, None), (1, 52, 2, "ACGTN" * 5, [9] * 25)]
    schema = "tile_id int, cluster_id long, read_no int, seq string, qual array<int>, pf boolean, x_pos double, y_pos double, barcode_id int, barcode string, end_masked int, loaded_at timestamp"
    spark.createDataFrame([(*r, None, None, None, None, None, None, None) for r in rows], schema).write.parquet(str(tmp_path / "cluster_read.parquet"))
    of = {r[1:3]: r for r in rows}
    got = {r["cluster_id"]: r for r in reads.g03_whole_reads(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(12), 50} and (got[50]["bases"], got[50]["mismatch_count"], got[50]["matches_in_row"]) == (50, 10, 40)
    for c, r in got.items():
        same = [x == y for x, y in zip(of[c, 1][3], of[c, 2][3], strict=False)]
        assert (r["bases"], r["mismatch_count"], r["matches_in_row"]) == (len(same), same.count(False), max(map(len, "".join("x" if m else " " for m in same).split()), default=0))
        q = spark.createDataFrame([(i, m, x) for i, (m, x) in enumerate(zip(same, of[c, 1][4], strict=False))], "i int, m boolean, q int") if c in (0, 50) else None
        assert q is None or abs(q.agg(F.sum(F.when(F.col("m"), sc.log_match(F.col("q"))).otherwise(sc.log_mismatch(F.col("q"))))).first()[0] - r["log_probability"]) < 1e-9
    kmers = reads.x04_all_kmers(spark, str(tmp_path)).collect()
    assert sorted((r["cluster_id"], r["read_no"], r["pos"], r["kmer"]) for r in kmers) == sorted((c, n, i, x[i : i + 16]) for _, c, n, x, _ in rows if x for i in range(len(x) - 15))
    for r in kmers:
        k = r["kmer"]
        assert r["permuted"] == k[8:12] + k[:4] + k[12:] + k[4:8]
        assert (r["unpacked"], r["packed"]) == ((None, None) if "N" in k else (k, sum("ACGT".index(b) << 2 * (15 - i) for i, b in enumerate(k))))


def test_bases_mask():
    assert parse_bases_mask("y*n", [3, 2]) == ["yyn", "yn"]
    assert [len(m) for m in parse_bases_mask("y10n,Y100n,y*n100", [11, 101, 101])] == [11, 101, 101]
    for wrong in ("y*k", "y*n*", "y9", "y*,y*,y*"):
        with pytest.raises(ValueError):
            parse_bases_mask(wrong, [5, 5])


# --- index and joins ---------------------------------------------------------------------------


def test_kmers_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    seqs = [dna(rng, 1500)[:700] + "N" + dna(rng, 300), "ACG", "", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "c int, seq string")
    got = sorted(map(tuple, index.contig_kmers(df, ["c"], "seq", 12).collect()))
    want = sorted((c, i, s[i : i + 12]) for c, s in enumerate(seqs) if s for i in range(len(s) - 11) if "N" not in s[i : i + 12])
    assert got == want


def test_index_caps_repeats(spark):
    df = spark.createDataFrame([(0, "A" * 40), (1, "ACGTTGCATT")], "c int, seq string")
    rows = {r["kmer"]: (r["repeats"], r["hits"]) for r in index.build_index(df, ["c"], "seq", 8, repeat_cap=5).collect()}
    assert rows["AAAAAAAA"] == (33, None)
    assert rows["ACGTTGCA"][1] == [Row(c=1, pos=0)]


def packed_contigs(spark):
    """Contigs given twice, with several sequences, without any, with other letters; a frequent k-mer and one longer than a block."""
    rng = random.Random(31)
    rows = [(i % 7, i, dna(rng, rng.choice([3, 16, 40]))) for i in range(120)]
    rows += [(i % 7, i, rows[i][2]) for i in range(30)] + [(i % 7, i, dna(rng, 20)[: 3 * i]) for i in range(0, 30, 3)]
    rows += [(8, 200 + i, "A" * 30 + "T" * i) for i in range(9)] + [(9, 300, dna(rng, 1300)), (9, 300, dna(rng, 700)), (9, 301, "ACGT" * 5), (9, 302, "ACGTacgtNNACGTéACGTTG"), (9, 303, ""), (9, 304, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "tile int, contig long, seq string")


@pytest.mark.parametrize("k", [4, 7, 16])
def test_high_repeats_counted_without_rows_of_kmers(spark, monkeypatch, k):
    monkeypatch.setattr(packed, "LETTERS", 600)
    contigs, keys = packed_contigs(spark), ["tile", "contig"]
    got = packed.high_repeat_counts(contigs, keys, "seq", k, ["tile"], 4)
    once = contigs.distinct()
    want = index.high_repeats(once, keys, "seq", index.build_index(once, keys, "seq", k, repeat_cap=4)).groupBy("tile").agg(F.count(F.lit(1)).alias("positions"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_high_repeats_query_joins_no_positions(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from strandlake.plans import placing

    packed_contigs(spark).selectExpr("tile AS tile_id", "contig AS cluster_id", "1 AS read_no", "seq").where("seq IS NULL OR seq NOT LIKE '%é%'").coalesce(2).write.parquet(f"{tmp_path}/cluster_read.parquet")
    got = placing.r02_high_repeats(spark, str(tmp_path))
    want = duckdb.sql(placing.SQL["r02_high_repeats"].replace("FROM cluster_read", f"FROM '{tmp_path}/cluster_read.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("k", "cap"), [(4, 20), (7, 3), (16, 1000)])
def test_annotated_without_rows_of_kmers(spark, monkeypatch, k, cap):
    monkeypatch.setattr(packed, "LETTERS", 600)
    contigs, keys = packed_contigs(spark), ["tile", "contig"]
    got = packed.annotated_kmers(contigs, keys, "seq", k, lambda pos: pos % 3 == 0, cap)
    once = contigs.distinct()
    flagged = index.contig_kmers(once, keys, "seq", k).where("pos % 3 = 0").select(*keys, "pos")
    want = index.annotate_positions(index.build_index(once, keys, "seq", k, cap), flagged, [*keys, "pos"]).select("kmer", "repeats", "has_neighbours")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_annotated_query_joins_no_positions(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from strandlake.plans import placing

    packed_contigs(spark).selectExpr("tile AS tile_id", "contig AS cluster_id", "1 AS read_no", "seq").where("seq IS NULL OR seq NOT LIKE '%é%'").coalesce(2).write.parquet(f"{tmp_path}/cluster_read.parquet")
    got = placing.j06_annotated_positions(spark, str(tmp_path))
    want = duckdb.sql(placing.SQL["j06_annotated_positions"].replace("FROM cluster_read", f"FROM '{tmp_path}/cluster_read.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_neighbours_against_pairs(spark):
    rng = random.Random(4)
    kmers = {dna(rng, 8) for _ in range(120)} | {"ACGTACGT", "ACGTACGA"}
    for distance, parts in ((1, 2), (2, 4), (4, 8)):
        got = {r[0] for r in index.mark_neighbours(spark.createDataFrame([(k,) for k in kmers] + [(None,), ("A",)], "kmer string"), 8, distance, parts).collect()}
        assert got == {a for a in kmers if any(a != b and sum(x != y for x, y in zip(a, b, strict=True)) <= distance for b in kmers)}


def test_read_neighbours_of_both_strands(spark, tmp_path):
    rng = random.Random(14)
    seqs = [dna(rng, rng.choice([12, 20, 30])) for _ in range(25)] + ["A" * 40, "ACGTN" * 6, None]
    first = seqs[1] = dna(rng, 16)
    seqs.append("".join("ACGT"[("ACGT".index(b) + 1) % 4] if i in (1, 5, 9, 13) else b for i, b in enumerate(first))[::-1].translate(str.maketrans("ACGT", "TGCA")))
    spark.createDataFrame([(1, i, 1, s) for i, s in enumerate(seqs)], "tile_id int, cluster_id long, read_no int, seq string").write.parquet(str(tmp_path / "cluster_read.parquet"))
    kmers = {s[i : i + 16] for s in seqs if s for i in range(len(s) - 15) if "N" not in s[i : i + 16]}
    kmers |= {x[::-1].translate(str.maketrans("ACGT", "TGCA")) for x in kmers}
    want = {a for a in kmers if any(a != b and sum(x != y for x, y in zip(a, b, strict=True)) <= 4 for b in kmers)}
    got = [r[0] for r in reads.j04_read_neighbours(spark, str(tmp_path)).collect()]
    assert first in want and len(want) < len(kmers) and len(got) == len(set(got)) and set(got) == want


def test_seed_join_kinds_and_two_passes(spark):
    idx = spark.createDataFrame([("AA", 2, [(0, 5), (1, 9)]), ("CC", 12, [(0, i) for i in range(12)]), ("GG", 2000, None)], "kmer string, repeats long, hits array<struct<c:int,pos:int>>")
    seeds = spark.createDataFrame([(1, 0, "AA"), (2, 0, "CC"), (3, 0, "GG"), (4, 0, "TT"), (1, 1, "AA"), (4, 1, "AA")], "read int, seed int, kmer string")
    kinds = sorted((r["read"], r["seed"], r["match_kind"], r["hit"]["pos"] if r["hit"] else None) for r in joins.seed_join(seeds.where("seed = 0"), idx).collect())
    assert kinds == [(1, 0, "hit", 5), (1, 0, "hit", 9), (2, 0, "too_many", None), (3, 0, "too_many", None), (4, 0, "none", None)]
    kmers = idx.where("hits IS NOT NULL").select("kmer", F.explode("hits").alias("h")).select("kmer", "h.*")
    again = sorted((r["read"], r["seed"], r["match_kind"], r["hit"]["pos"] if r["hit"] else None) for r in joins.seed_search(seeds.where("seed = 0"), kmers, ["c", "pos"]).collect())
    assert again == [(1, 0, "hit", 5), (1, 0, "hit", 9), (2, 0, "too_many", None), (3, 0, "none", None), (4, 0, "none", None)]
    second = {(r["read"], r["match_kind"]) for r in joins.two_pass(seeds, lambda s: joins.seed_join(s, idx), ["read"], "seed").where("pass = 2").collect()}
    assert second == {(4, "hit")}


def test_interval_join_against_loop(spark):
    rng = random.Random(5)
    left = [(i, rng.choice("xy"), (a := rng.randint(-50, 300)), a + rng.randint(0, 90)) for i in range(80)] + [(99, None, 1, 5), (98, "x", None, 5)]
    right = [(i, rng.choice("xy"), (a := rng.randint(-50, 300)), a + rng.randint(0, 40)) for i in range(80)]
    got = joins.interval_join(spark.createDataFrame(left, "l int, k string, a int, b int"), spark.createDataFrame(right, "r int, k string, c int, d int"), ["k"], ("a", "b"), ("c", "d"), 16)
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] is not None and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r["l"], r["r"]) for r in got.collect()) == want


def test_reorder_needs_a_permutation(spark):
    df = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {r["name"]: r["place"] for r in index.reorder(df, "name", ["b", "a"]).collect()} == {"b": 0, "a": 1}
    with pytest.raises(Exception, match="permutation"):
        index.reorder(df, "name", ["b"]).collect()


def test_islands(spark):
    df = spark.createDataFrame([("s", p, v) for p, v in ((1, True), (2, True), (3, None), (4, None), (6, None), (7, True))], "s string, p int, v boolean")
    got = sorted((r["first"], r["last"], r["v"], r["length"]) for r in index.islands(df, ["s"], "p", "v").collect())
    assert got == [(1, 2, True, 2), (3, 4, None, 2), (6, 6, None, 1), (7, 7, True, 1)]


# --- demultiplexing ----------------------------------------------------------------------------

SHEET = "flowcell string, lane int, barcode_id int, barcode_seq string, mismatches array<int>"


def test_demultiplex(spark):
    sheet = spark.createDataFrame([("F", 1, 1, "AAAA-CCCC", [1, 0]), ("F", 1, 2, "GGGG", None), ("F", 1, 3, None, None)], SHEET)
    codes = ["AAAA-CCCC", "TAAA-CCCC", "AAAA-CCCT", "GGGN", "GGNN", None, "AAAA"]
    seen = spark.createDataFrame([("F", 1, c) for c in codes], "flowcell string, lane int, code string")
    got = {r["code"]: (r["found_id"], r["mismatched"]) for r in demux.demultiplex(seen, sheet, "code").collect()}
    assert got == {"AAAA-CCCC": (1, 0), "TAAA-CCCC": (1, 1), "AAAA-CCCT": (None, None), "GGGN": (2, 1), "GGNN": (None, None), None: (None, None), "AAAA": (None, None)}
    top = demux.top_unknown(demux.demultiplex(seen.union(seen), sheet, "code"), "code", 2).collect()
    assert [(r["code"], r["n"]) for r in sorted(top, key=lambda r: r["place"])] == [("AAAA", 2), ("AAAA-CCCT", 2)]


def test_demultiplex_lists_no_spellings(spark):
    # 200 samples with 231,361 spellings each; letters that no spelling has count as mismatches, and a third part doesn't count
    rng = random.Random(21)
    rows = [("F", 1 + i % 2, i, f"{dna(rng, 8)}-{dna(rng, 8)}", [2, 2]) for i in range(200)]
    rows += [("F", 1, 200, "acgtacgt", [3, 3]), ("F", 2, 201, "ACGTACG-TT", [0, None]), ("F", 2, 202, "", None), ("F", 1, 203, "AC-GT", [-1, 1])]
    codes = ["AC-GT", "-", "A", "ACG-T", "ACGTACGT-"]
    for _, _, _, text, _ in rows:
        for n in range(6):
            code = list(text.upper())
            for i in rng.sample(range(len(code)), min(n, len(code))):
                code[i] = code[i] if code[i] == "-" else rng.choice("ACGTN.")
            codes.append("".join(code) + "-A" * (n == 1))
    seen = spark.createDataFrame([("F", lane, c) for lane in (1, 2) for c in codes], "flowcell string, lane int, code string").distinct()

    def found(lane, code):
        x, y = [*code.split("-"), ""][:2]
        fits = []
        for _, at, i, text, allowed in rows:
            (a, b), (ma, mb) = [*text.upper().split("-"), ""][:2], [1 if m is None else m for m in allowed or (1, 1)]
            if at == lane and (len(x), len(y)) == (len(a), len(b)) and (b or "-" not in code):
                da, db = (sum(p != q for p, q in zip(*z, strict=True)) for z in ((x, a), (y, b)))
                fits += [(da + db, i)] if da <= ma and db <= mb else []
        return min(fits)[::-1] if fits else (None, None)

    got = {(r["lane"], r["code"]): (r["found_id"], r["mismatched"]) for r in demux.demultiplex(seen, spark.createDataFrame(rows, SHEET), "code").collect()}
    assert got == {(lane, c): found(lane, c) for lane in (1, 2) for c in codes}


def test_demultiplex_query_as_its_sql(spark, tmp_path):
    # a letter that no spelling has, three mismatches that a sheet allows, a third part
    duckdb = pytest.importorskip("duckdb")
    from strandlake.plans import reads

    spark.createDataFrame([("F", 1, 1, "ACGTACGT-GGTTGGTT", [1, 1]), ("F", 1, 2, "ttttcccc", [3, 1])], SHEET).coalesce(1).write.parquet(f"{tmp_path}/barcode.parquet")
    spark.createDataFrame([(7, "F", 1)], "tile_id int, flowcell string, lane int").coalesce(1).write.parquet(f"{tmp_path}/tile.parquet")
    codes = ["ACGTACG.+GGTTGGTT", " acgtacgt-ggttggt? ", "TTTTCGGG", "TTTTGGGG", "ACGTACGT-GGTTGGTT-A", "", None]
    spark.createDataFrame([(7, i, 1, c) for i, c in enumerate(codes)], "tile_id int, cluster_id long, read_no int, barcode string").coalesce(1).write.parquet(f"{tmp_path}/cluster_read.parquet")
    db = duckdb.connect()
    for name in ("barcode", "tile", "cluster_read"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    names = ["cluster_id", "code", "found_id", "mismatched"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({reads.SQL['j07_demultiplex']}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in reads.j07_demultiplex(spark, str(tmp_path)).select(*names).orderBy("cluster_id").collect()] == want
    assert [r[2] for r in want] == [1, 1, 2, None, 1, None, None]


def test_barcode_collision(spark):
    apart = demux.expand_barcodes(spark.createDataFrame([("F", 1, 1, "G-AAA", [1, 1]), ("F", 1, 2, "T-CCC", [1, 1])], SHEET))
    assert demux.collisions(apart).count() == 0
    assert demux.require_no_collisions(apart).count() == apart.count()
    close = demux.expand_barcodes(spark.createDataFrame([("F", 1, 1, "G-AA", [1, 1]), ("F", 1, 2, "T-CC", [1, 1])], SHEET))
    assert demux.collisions(close).count() > 0
    with pytest.raises(Exception, match="collision"):
        demux.require_no_collisions(close).collect()


# --- templates, fragments, duplicates ----------------------------------------------------------


def test_template_length_quantiles(spark):
    # lengths 1 .. 9999 under one model, one pair under another
    rows = spark.range(1, 10000).select(F.lit("b").alias("b"), F.col("id").alias("length"), F.lit(1).alias("model")).union(spark.createDataFrame([("b", 14, 6), ("b", 99999, 3), ("b", None, 1)], "b string, length long, model int"))
    r = template.template_length_stats(rows, ["b"], "length", "model").first()
    assert (r["templates"], r["best_model"], r["second_model"]) == (10000, 1, 6)
    assert (r["min_length"], r["median_length"], r["max_length"], r["low_deviation"], r["high_deviation"]) == (14, 5000, 9986, 3414, 3413)
    assert template.template_length_stats(rows.limit(0), ["b"], "length", "model").count() == 0


def test_mate_orientation(spark):
    # models FR+ (1) and RF- (6): opposite strands; FF+ (0) and RR- (7): the same
    for best, second, same in ((1, 6, False), (0, 7, True)):
        for read, reverse in product((0, 1), (False, True)):
            got = one(spark, r=template.mate_reverse(F.lit(best), F.lit(second), read, F.lit(reverse)))["r"]
            assert got == (reverse if same else not reverse)


def test_best_pair_ties(spark):
    rows = [(1, 1, 3, -2.0), (1, 2, 3, -2.0 + 5e-8), (1, 3, 3, -2.1), (1, 4, 5, 0.0), (2, 1, 0, -1.0)]
    best = template.best_pair(spark.createDataFrame(rows, "c int, p int, cost int, lp double"), ["c"], "cost", "lp", ["p"])
    assert sorted((r["c"], r["p"], r["ties"]) for r in best.collect()) == [(1, 1, 2), (2, 1, 1)]


def test_best_candidate_scatter(spark):
    rows = [(c, p, 1, -1.0) for c in (10, 11) for p in (0, 1)]
    df = spark.createDataFrame(rows, "c int, p int, cost int, lp double")
    assert sorted((r["c"], r["p"]) for r in fragments.best_candidate(df, ["c"], "cost", "lp", ["p"], "c").collect()) == [(10, 0), (11, 1)]


#: name, side, own place, mate (shadow, reverse, bin), mate anchor, ranks; the places that a group shares
GROUPS = [("left Frp", "F", 0, "0/1/1", 300, (3, 2, 3)), ("right Frp", "R", 300, "0/0/0", 0, (3, 2, 3)), ("left Ffp", "F", 0, "0/0/0", 200, (3, 2)), ("right Ffp", "F", 200, "0/0/0", 0, (3, 2)), ("left Rrp", "R", 100, "0/1/1", 300, (3, 2)), ("right Rrp", "R", 300, "0/1/1", 100, (3, 2)), ("left Rfp", "R", 100, "0/0/0", 200, (3, 2, 3)), ("right Rfp", "F", 200, "0/1/1", 100, (3, 2, 3)), ("left bin 0", "F", 0, "0/1/0", 300, (3, 3))]


def test_duplicates(spark):
    rows = [(i * 10 + j, name, side, own, mate, anchor, rank) for i, (name, side, own, mate, anchor, ranks) in enumerate(GROUPS) for j, rank in enumerate(ranks)]
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "cluster int, name string, side string, own int, mate string, anchor int, q int")
    rank = F.struct(F.col("q").alias("quality"), F.lit(0).alias("matches"), F.lit(0).alias("score"))
    out = build.mark_duplicates(df, ["side", "own", "mate", "anchor"], rank, ["cluster"])
    assert sorted(r["cluster"] for r in out.where("NOT duplicate").collect()) == [i * 10 for i in range(len(GROUPS))]
    assert out.count() == len(rows)


def test_duplicates_with_null_places(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 7), (3, 4, 1)], "cluster int, own int, q int")
    rank = F.struct(F.col("q").alias("quality"), F.lit(0).alias("matches"), F.lit(0).alias("score"))
    assert {r["cluster"]: r["duplicate"] for r in build.mark_duplicates(df, ["own"], rank, ["cluster"]).collect()} == {1: True, 2: False, 3: False}


def test_bins_of_the_genome(spark):
    df = spark.createDataFrame([(0, b, n) for b, n in enumerate((5, 5, 5, 40, 1, 0, 9))] + [(1, 0, 3)], "contig int, bin long, matches long")
    got = {(r["contig"], r["bin"]): r["output_bin"] for r in build.plan_bins(df, "contig", 10).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (0, 3): 2, (0, 4): 3, (0, 5): 3, (0, 6): 3, (1, 0): 0}


def test_gaps(spark):
    df = spark.createDataFrame([(0, 100, "10M2D5M3I4M"), (0, 100, "10M2D9M"), (0, 7, "20M"), (0, 1, None)], "contig int, pos long, cigar string")
    assert sorted((r["gap_pos"], r["gap_len"]) for r in build.collect_gaps(df, ["contig"], "pos", "cigar").collect()) == [(110, 2), (117, -3)]


def test_rollup_keeps_null_names_apart(spark):
    df = spark.createDataFrame([(1, "F", None, "S", "B", 2), (1, "F", "P", "S", "B", 3)], "lane int, flowcell string, project string, sample string, barcode string, n long")
    got = {(r["flowcell"], r["project"], r["sample"], r["barcode"]): r["n"] for r in stats.rollup_levels(df, ["n"], ["lane"]).collect()}
    assert got[("F", None, "S", "B")] == 2 and got[("all", "all", "all", "all")] == 5 and got[("all", None, "all", "all")] == 2 and len(got) == 12


def test_deviation_needs_three_tiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", None)], "l string, v double")
    assert {r["l"]: (r["tiles"], r["mean_value"], r["deviation"]) for r in stats.across_tiles(df, ["l"], "v").collect()} == {"a": (2, 2.0, None), "b": (3, 2.0, 0.8165)}


def test_seed_layouts():
    at = lambda d, lengths, k=32: [(s.read, s.offset) for s in seeds.seed_layout(d, lengths, k)]
    assert at("auto", [100]) == [(0, 0), (0, 68), (0, 32), (0, 16)]
    assert at("auto", [32]) == [(0, 0)] and at("auto", [150]) == [(0, o) for o in (0, 118, 32, 64, 16, 48)][:4] + []
    assert at("0:32:64,auto", [100, 40]) == [(0, 0), (0, 32), (0, 64), (1, 0), (1, 8)]
    assert at("all", [34]) == [(0, 0), (0, 1), (0, 2)]
    for wrong, lengths in (("auto", [20]), ("x", [50]), ("90", [100]), ("0,0", [50])):
        with pytest.raises(ValueError):
            seeds.seed_layout(wrong, lengths, 32)


def test_given_template_model():
    assert template.given_stats("100:200:300:17:18:FR+:6")["second_model"] == 6 and template.given_stats("100:200:300:17:18:FR+:RF-")["best_model"] == 1
    for wrong in ("1:2:3", "3:2:1:0:0:1:2", "1:2:3:0:0:9:2"):
        with pytest.raises(ValueError):
            template.given_stats(wrong)


def test_compact_cigar(spark):
    ops = sq.compact_cigar(sq.cigar_ops(F.lit("3M0I4M2D1D5M0S")))
    assert one(spark, t=sq.cigar_text(ops), e=F.size(sq.compact_cigar(sq.cigar_ops(F.lit(""))))) == Row(t="7M3D5M", e=0)


def test_templates(spark):
    ends = "cluster int, lane string, contig int, pos int, len int, reverse boolean, cost int, lp double"
    first = spark.createDataFrame([(1, "a", 0, 100, 50, False, 0, -1.0), (1, "a", 0, 100, 50, False, 0, -1.0), (2, "a", 0, 100, 50, False, 0, -1.0), (3, "a", 1, 5, 50, False, 0, -1.0), (5, "a", 0, 100, 50, False, 0, -1.0), (5, "a", 0, 900, 50, False, 0, -1.0)], ends)
    second = spark.createDataFrame([(1, "a", 0, 300, 50, True, 0, -1.0), (2, "a", 0, 300, 50, False, 0, -1.0), (4, "a", 0, 7, 50, True, 0, -1.0), (5, "a", 0, 300, 50, True, 0, -1.0), (5, "a", 0, 1100, 50, True, 0, -1.0)], ends)
    models = spark.createDataFrame([("a", 200, 260, 300, 1, 6)], "lane string, min_length int, median_length int, max_length int, best_model int, second_model int")
    got = {r["cluster"]: (r["kind"], r["ties"], r["score"]) for r in template.build_templates(first, second, models, "lane", F.lit(1e-6)).collect()}
    assert got[1][:2] == ("proper", 1) and got[1][2] > 40
    assert {c: got[c][0] for c in (2, 3, 4)} == {2: "apart", 3: "single", 4: "single"}
    assert got[5][1] == 3 and got[5][2] <= 3


def test_stages_resume_and_rewind(spark, tmp_path):
    from strandlake.plans.stages import Stages

    built = []
    make = lambda name, n: lambda: built.append(name) or spark.range(n)
    s = Stages(spark, f"file://{tmp_path}/w", ["match", "select"])
    assert s.table("match", make("match", 3)).count() == 3 and s.table("select", make("select", 2)).count() == 2
    assert Stages(spark, f"file://{tmp_path}/w", ["match", "select"]).table("match", make("again", 9)).count() == 3
    s.rewind("select")
    assert s.done("match") and not s.done("select") and built == ["match", "select"]
    with pytest.raises(ValueError):
        s.table("other", make("x", 1))
