"""Placing and rescuing against brute force and known alignments; anchors, samples, pages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import score as sc
from strandlake.operators import build, index, kernels, rescue, stats, template


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def turned(text):
    return text[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_votes_are_those_of_brute_force():
    rng = random.Random(1)
    queries, databases, expected = [], [], []
    for i in range(80):
        q = dna(rng, rng.randrange(0, 120), "ACGT" if i % 3 else "ACN")
        cut = rng.randrange(len(q) + 1)
        d = dna(rng, 6) + q[:cut] + dna(rng, rng.choice((0, 4, 4))) + q[cut:] + dna(rng, 5)
        where: dict = {}
        for p in range(len(q) - 6):
            where.setdefault(q[p : p + 7], []).append(p)
        votes: dict = {}
        for p in range(len(d) - 6):
            at = where.get(d[p : p + 7], [])
            if len(at) == 1 and "N" not in d[p : p + 7]:
                votes[p - at[0]] = votes.get(p - at[0], 0) + 1
        queries.append(q), databases.append(d), expected.append(sum(v >= 8 for v in votes.values()) >= 2)
    assert rescue.vote_offsets(queries, databases).tolist() == expected
    assert 5 < sum(expected) < 75
    assert rescue.vote_offsets([], []).tolist() == []


def test_cigar_scores_are_those_of_brute_force():
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        ops = [(rng.randint(0, 3), "S"), *[(rng.randint(1, 9), op) for _ in range(rng.randint(1, 3)) for op in ("M", rng.choice("ID"))], (rng.randint(1, 9), "M"), (rng.randint(0, 2), "S")]
        ops = [(n, op) for n, op in ops if n]
        size = sum(n for n, op in ops if op != "D")
        rows.append((dna(rng, size, "ACn"), dna(rng, 90, "AC"), [rng.randint(0, 41) for _ in range(size)], ops))
    got = rescue.cigar_scores([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], ["".join(f"{n}{op}" for n, op in r[3]) for r in rows])
    for i, (read, ref, qual, ops) in enumerate(rows):
        at = place = cost = edit = longest = 0
        lp, bad = 0.0, []
        for n, op in ops:
            run = 0
            for j in range(n if op == "M" else 0):
                a, b, q = read[at + j], ref[place + j], qual[at + j]
                edit += a != b
                if a in ("n", b):
                    run, lp = run + 1, lp + math.log1p(-(10 ** (-max(q, 1) / 10)))
                else:
                    run, lp = 0, lp + (math.log(1 - 10**-0.1) if q == 0 else math.log(10 ** (-q / 10) / 3))
                    bad.append(at + j)
                longest = max(longest, run)
            if op in "ID":
                cost, edit = cost + 11 + min(20, 4 * (n - 1)), edit + n
            if op == "S":
                lp += sum(math.log1p(-(10 ** (-max(q, 1) / 10))) for q in qual[at : at + n])
            at, place = at + n * (op != "D"), place + n * (op in "MD")
        r = got.iloc[i]
        assert (r.mismatches, r.matches_in_row, r.edit_distance, r.observed_length, r.cost, r.mismatch_offsets) == (len(bad), longest, edit, place, cost + 3 * len(bad), bad)
        assert r.log_probability == pytest.approx(lp)


def test_mate_places_are_those_of_brute_force():
    rng = random.Random(3)
    mates, windows = [], []
    for i in range(60):
        w = dna(rng, rng.randrange(0, 90), "ACGT" if i % 2 else "AC")
        at = rng.randrange(len(w) + 1)
        m = list(w[at : at + rng.randrange(0, 30)])
        for _ in range(rng.randrange(3)):
            if m:
                m[rng.randrange(len(m))] = rng.choice("ACGTN")
        mates.append("".join(m)), windows.append(w)
    got = {(r.row, r.offset): r.mismatches for r in rescue.mate_places(mates, windows).itertuples()}
    expected = {}
    for i, (m, w) in enumerate(zip(mates, windows, strict=True)):
        for o in range(len(w) - len(m) + 1):
            if any(m[j : j + 7] == w[o + j : o + j + 7] and "N" not in m[j : j + 7] for j in range(len(m) - 6)):
                expected[i, o] = sum(a != b for a, b in zip(m, w[o : o + len(m)], strict=True))
    assert got == expected and len(got) > 30


def test_kernels_take_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([("ACGTACGTAC", [30] * 10, "TTACGTACGTACTT", "10M"), (None, None, None, None), ("", [], "", ""), ("ACGT", [1], "ACGT", "4M"), ("ACGT", [1] * 4, "AC", "4M"), ("AC", [9, 9], "ACGT", "3M")], "r string, q array<int>, w string, c string")
    out = df.select(rescue.score_cigar("r", "w", "q", "c").alias("s"), rescue.best_mate_place("r", "q", "w").alias("p"), rescue.rescue_mate("r", "w").alias("m"), rescue.gaps_make_sense("r", "w").alias("g")).collect()
    assert [r["s"]["mismatches"] for r in out] == [10 - sum(a == b for a, b in zip("ACGTACGTAC", "TTACGTACGT", strict=True)), None, 0, None, None, None]
    assert [r["p"]["offset"] for r in out] == [2, None, None, None, None, None] and out[0]["m"]["mismatches"] == 0
    assert [r["g"] for r in out] == [False, None, False, False, False, False]
    assert df.limit(0).select(rescue.best_mate_place("r", "q", "w")).collect() == []


def ends(spark, contig_seq, mate_seq, **orphan):
    row = {"cluster": 1, "grp": 0, "read": 0, "contig": 4, "pos": 0, "reverse": False, "len": 100, "lp": -0.01, "cost": 0} | orphan
    kinds = "cluster long, grp int, read int, contig int, pos long, reverse boolean, len int, lp double, cost int"
    orphans = spark.createDataFrame([tuple(row.values())], kinds)
    mates = spark.createDataFrame([(1, mate_seq, [40] * len(mate_seq))], "cluster long, seq string, qual array<int>")
    contigs = spark.createDataFrame([(4, contig_seq), (5, ""), (6, None)], "contig int, seq string")
    # FR+ and RF-: the second read is reverse and lies 200 to 400 bases on
    models = spark.createDataFrame([(0, 1, 6, 200, 400)], "grp int, best_model int, second_model int, min_length int, max_length int")
    return orphans, mates, contigs, models, "grp"


def test_mate_is_rescued_in_its_window(spark):
    contig = dna(random.Random(4), 1500)
    mate = turned(contig[318:410])
    for seq, wrong in ((mate, 0), (mate[:50] + ("A" if mate[50] != "A" else "C") + mate[51:], 1)):
        got = rescue.rescue_mates(*ends(spark, contig, seq)).collect()[0]["rescued"]
        assert (got["pos"], got["reverse"], got["len"], got["mismatches"], got["cost"]) == (318, True, 92, wrong, 3 * wrong)
    assert rescue.rescue_mates(*ends(spark, contig, mate)).collect()[0]["rescued"]["lp"] == pytest.approx(-0.00920046, abs=1e-8)
    # outside of the window, on the wrong strand, without bases, on a contig without bases
    assert rescue.rescue_mates(*ends(spark, contig, turned(contig[900:992]))).collect()[0]["rescued"] is None
    assert rescue.rescue_mates(*ends(spark, contig, contig[318:410])).collect()[0]["rescued"] is None
    assert rescue.rescue_mates(*ends(spark, contig, "")).collect()[0]["rescued"] is None
    assert rescue.rescue_mates(*ends(spark, contig, mate, contig=6)).collect()[0]["rescued"] is None
    # a reverse orphan that is the second read has its mate before it
    got = rescue.rescue_mates(*ends(spark, contig, contig[1000:1100], read=1, pos=1200, reverse=True)).collect()[0]["rescued"]
    assert (got["pos"], got["reverse"]) == (1000, False)


def test_rescued_templates(spark):
    contig = dna(random.Random(5), 1500)
    mate = turned(contig[318:410])
    orphans, mates, contigs, models, grp = ends(spark, contig, mate)
    worse = orphans.withColumns({"pos": F.lit(30).cast("long"), "cost": F.lit(6)})
    hopeless = orphans.withColumns({"pos": F.lit(60).cast("long"), "lp": F.lit(-500.0)})
    found = rescue.rescue_mates(orphans.union(worse).union(hopeless), mates, contigs, models, grp)
    assert found.count() == 2
    t = rescue.rescued_templates(found, F.lit(2e-5), grp).collect()
    assert [(r["kind"], r["pos"], r["mate_pos"], r["template_length"]) for r in t] == [("rescued", 0, 318, 410)]
    assert t[0]["score"] == 3  # two orphans of equal probability share it
    alone = rescue.rescue_mates(orphans, mates, contigs, models, grp)
    score = lambda df: rescue.rescued_templates(df, F.lit(2e-5), grp).collect()[0]["score"]
    assert score(alone) == 46 and score(alone.withColumn("anchored", F.lit(False))) == rescue.CLEAN_SCORE
    lost = rescue.rescue_mates(*ends(spark, contig, "ACGT")).collect()
    assert lost[0]["rescued"] is None
    assert rescue.rescued_templates(rescue.rescue_mates(*ends(spark, contig, "ACGT")), F.lit(2e-5), grp).collect()[0]["kind"] == "single"


def test_gapped_candidates(spark):
    rng = random.Random(6)
    ref = dna(rng, 120)
    gap = ref[8:48] + ref[51:91]  # three bases are missing
    rows = [("gap", gap, ref[: 8 + 80 + 7]), ("same", ref[8:88], ref[:95]), ("noise", dna(rng, 80), ref[:95])]
    df = spark.createDataFrame([(n, s, [35] * len(s), f) for n, s, f in rows], "name string, seq string, qual array<int>, flanked string")
    df = df.withColumn("u", rescue.score_cigar("seq", F.expr("substring(flanked, 9)"), "qual", F.lit("80M"))).select("name", "seq", "qual", "flanked", "u.mismatches", "u.observed_length", "u.log_probability")
    got = {r["name"]: r["gapped"] for r in rescue.align_gapped(df).collect()}
    assert got["same"] is None and got["noise"] is None
    assert got["gap"]["shift"] == 0 and got["gap"]["mismatches"] == 0 and got["gap"]["edit_distance"] == 3 and "3D" in got["gap"]["cigar"]


def test_indel_pairs_and_candidates(spark):
    df = spark.createDataFrame([(1, 0, False, 100, 0), (1, 0, False, 114, 64), (1, 0, False, 400, 0), (1, 0, True, 120, 0), (2, 0, False, 50, 64), (2, 0, False, 60, 0)], "read int, contig int, reverse boolean, unclipped int, seed_offset int")
    assert sorted((r["read"], r["first"], r["second"]) for r in rescue.indel_pairs(df, ["read"]).collect()) == [(1, 100, 114), (2, 60, 50)]
    m = [(1, 0, 0, 32, 100, 0, 500, False, False), (1, 1, 40, 32, 100, 0, 540, False, False), (1, 2, 0, 64, 100, 0, 900, True, False), (1, 3, 5, 32, 100, 0, 505, False, True)]
    m += [(1, 4, 9, 32, 100, 0, i, False, False) for i in range(10)]
    df = spark.createDataFrame(m, "read int, seed int, offset int, seed_length int, read_length int, contig int, pos int, reverse boolean, neighbours boolean")
    got = {(r["position"], r["reverse"]): (r["unique_seeds"], r["weak_first"], r["weak_last"]) for r in rescue.build_candidates(df, ["read"], 10).collect()}
    assert got == {(500, False): (0, 0, 40), (864, True): (1, None, None)}


def test_totals_of_ends_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    rows = [(c, e, 0, p, False, -rng.random()) for c in range(5) for e in (1, 2) for p in range(rng.randrange(4))]
    df = spark.createDataFrame(rows, "cluster int, end int, contig int, pos int, reverse boolean, lp double")
    got = {r["cluster"]: r["total"] for r in rescue.disjoint_totals(df.union(df), ["cluster"], "end", "lp").collect()}
    for c in {r[0] for r in rows}:
        assert got[c] == pytest.approx(sum(math.exp(a[5] + b[5]) for a in rows for b in rows if a[0] == b[0] == c and a[1] == 1 and b[1] == 2))


def test_ungapped_cigar(spark):
    df = spark.createDataFrame([(100, 3, 5), (100, 0, 0), (10, 12, 4), (10, 4, 9)], "n int, l int, r int")
    assert [r[0] for r in df.select(rescue.ungapped_cigar(F.col("n"), F.col("l"), F.col("r"))).collect()] == ["3S92M5S", "100M", "10S", "4S6S"]


#: Pairs (side, own position, mate unaligned, mate reverse, mate bin, mate anchor, rank, whether it stays).
PAIRS = [
    ("F", 0, 0, 1, 1, 300, 3, 1), ("F", 0, 0, 1, 1, 300, 2, 0), ("F", 0, 0, 1, 1, 300, 3, 0), ("R", 300, 0, 0, 0, 0, 3, 1), ("R", 300, 0, 0, 0, 0, 2, 0), ("R", 300, 0, 0, 0, 0, 3, 0),
    ("F", 0, 0, 0, 0, 200, 3, 1), ("F", 0, 0, 0, 0, 200, 2, 0), ("F", 200, 0, 0, 0, 0, 3, 1), ("F", 200, 0, 0, 0, 0, 2, 0), ("R", 100, 0, 1, 1, 300, 3, 1), ("R", 100, 0, 1, 1, 300, 2, 0),
    ("R", 300, 0, 1, 1, 100, 3, 1), ("R", 300, 0, 1, 1, 100, 2, 0), ("R", 100, 0, 0, 0, 200, 3, 1), ("R", 100, 0, 0, 0, 200, 2, 0), ("F", 200, 0, 1, 1, 100, 3, 1), ("F", 200, 0, 1, 1, 100, 2, 0), ("F", 0, 0, 1, 0, 300, 3, 1), ("F", 0, 0, 1, 0, 300, 3, 0),
]


def test_pair_duplicates(spark):
    rows = [(i, 7, own, 1, side == "R", "A" * 40, None if shadow else 7, mate, 1, bool(rev), "C" * 40, bin_, rank) for i, (side, own, shadow, rev, bin_, mate, rank, _) in enumerate(PAIRS)]
    # unaligned ends are placed by their first 32 bases
    rows += [(100 + i, None, None, None, False, seq, 7, 50, 1, False, "G", 0, 3) for i, seq in enumerate(("A" * 32 + "CC", "A" * 32 + "GG", "C" * 34))]
    kinds = "cluster int, contig int, pos long, observed int, reverse boolean, seq string, mate_contig int, mate_pos long, mate_observed int, mate_reverse boolean, mate_seq string, mate_bin int, quality int"
    df = spark.createDataFrame(rows, kinds).withColumn("library", F.lit("l"))
    rank = sc.duplicate_rank(F.col("quality"), F.lit(0), F.lit(0), F.lit(0))
    out = {r["cluster"]: r["duplicate"] for r in build.mark_pair_duplicates(df, rank, ["library"], ["cluster"], "cluster").collect()}
    assert [not out[i] for i in range(len(PAIRS))] == [bool(p[-1]) for p in PAIRS]
    assert [out[100], out[101], out[102]] == [False, True, False]
    assert not build.mark_pair_duplicates(df, rank, ["library"], ["cluster"], "cluster", paired=False).where("duplicate").count()


def test_strand_anchor(spark):
    df = spark.createDataFrame([(1, 10, 5, False, "x"), (1, 10, 5, True, "x"), (1, 0, 0, True, "x"), (None, 3, 1, True, "B" * 50)], "c int, p long, o int, r boolean, s string")
    assert [r[0] for r in df.select(build.anchor(*(F.col(x) for x in "cpors"))).collect()] == ["1:10", "1:14", "1:0", "B" * 32]


def test_template_samples(spark):
    def end(cluster, e, contig, pos, cigar="100M", length=100, reverse=False):
        return ("g", cluster, e, contig, pos, length, reverse, cigar)

    rows = [end(1, 1, 0, 100), end(1, 2, 0, 300, reverse=True), end(2, 1, 0, 100), end(3, 1, 0, 1), end(3, 2, 0, 2), end(3, 2, 0, 900), end(4, 1, 0, 1), end(4, 2, 1, 2), end(5, 1, 0, 1, "3I97M"), end(5, 2, 0, 9), end(6, 1, 0, 1), end(6, 2, 0, 9, "97M3I"), end(7, 1, 0, 0), end(7, 2, 0, 60000), end(8, 1, 0, 5, "50M3I47M"), end(8, 2, 0, 5)]
    df = spark.createDataFrame(rows, "lib string, cluster int, end int, contig int, pos long, len int, reverse boolean, cigar string")
    assert sorted((r["cluster"], r["template_length"], r["model"]) for r in template.template_samples(df, ["lib"], ["cluster"]).collect()) == [(1, 300, 1), (8, 100, 0)]


def test_gap_conflicts_and_scope(spark):
    rng = random.Random(8)
    gaps = {(rng.randrange(60), rng.choice((-3, -1, 1, 4, 9))) for _ in range(40)}
    df = spark.createDataFrame([("c", p, n) for p, n in gaps] + [("d", 1, 4)], "contig string, gap_pos int, gap_len int")
    got = {(r["pos1"], r["len1"], r["pos2"], r["len2"]) for r in build.gap_conflicts(df.union(df), ["contig"], bucket=8).collect()}
    bases = lambda p, n: set(range(p, p + n)) if n > 0 else {p}
    assert got == {(*a, *b) for a in gaps for b in gaps if a < b and bases(*a) & bases(*b)}
    with pytest.raises(ValueError, match="no scope"):
        build.gap_scope("lane", "s", "p")
    assert build.gap_scope("none", "s", "p") is None


def test_positions_and_repeats(spark):
    contigs = spark.createDataFrame([("a", "ACGTACGTNACGGTT"), ("b", ""), ("c", None), ("d", "GG")], "contig string, seq string")
    idx = index.build_index(contigs, ["contig"], "seq", 4, repeat_cap=3)
    marked = index.annotate_positions(idx, spark.createDataFrame([("a", 9), ("a", 4)], "contig string, pos long"), ["contig", "pos"])
    assert {r["kmer"] for r in marked.where("has_neighbours").collect()} == {"ACGG"}  # ACGT occurs at 0 first, and as its own other strand
    assert [tuple(r) for r in index.neighbour_positions(marked).collect()] == [("a", 9)]
    free = {(r["contig"], r["pos"]) for r in index.high_repeats(contigs, ["contig"], "seq", idx).collect()}
    stored = {("a", p) for r in idx.collect() for p in [h["pos"] for h in r["hits"] or ()]}
    assert free | stored == {("a", i) for i in range(15)} | {("d", 0), ("d", 1)} and not free & stored and ("a", 0) in free
    order = spark.createDataFrame([("a", "z")], "old string, new string")
    assert [r["contig"] for r in index.translate_contigs(contigs.select("contig"), "contig", order, "old", "new").orderBy("contig").collect()] == [None, None, None, "z"]


def test_fragment_statistics(spark):
    df = spark.createDataFrame([("l", True, 10, 2, 2, [5, 9], "ACN"), ("l", True, 2, 1, 1, [5], "NAA"), ("l", True, None, 0, 0, [], None), ("l", False, None, 0, 0, None, "")], "lane string, aligned boolean, score int, mismatches int, edits int, cycles array<int>, seq string")
    assert tuple(stats.fragment_sums(df, ["lane"]).collect()[0]) == ("l", 4, 3, 1, 0, 12, 3, 2)
    assert sorted(map(tuple, stats.score_histogram(df, ["lane"], "score", "mismatches").collect())) == [("l", 2, 1, 1), ("l", 10, 1, 2)]
    unique = sc.uniquely_aligned(F.col("score"))
    assert sorted(map(tuple, stats.cycle_mismatches(df, ["lane"], "cycles", unique).collect())) == [("l", 5, 2, 1), ("l", 9, 1, 1)]
    assert sorted(map(tuple, stats.cycle_blanks(df.withColumn("first", F.lit(10)), ["lane"], "seq", "first", unique).collect())) == [("l", 10, 1, 0), ("l", 12, 1, 1)]


def test_pages(spark):
    df = spark.createDataFrame([(1, "a<b", 2.5), (1, "c&d", None), (2, "e", 1.0)], "lane int, name string, x double")
    got = {r["lane"]: r["html"] for r in stats.as_html(df, "Lane", ["lane"]).collect()}
    assert "<tr><td>a&lt;b</td><td>2.5</td></tr>\n<tr><td>c&amp;d</td><td></td></tr>" in got[1] and "<h1>Lane 2</h1>" in got[2] and "<th>name</th>" in got[2]


def test_adapter_lists():
    assert kernels.parse_adapters("Standard,ACGT*,") == [*kernels.ADAPTERS["Standard"], "ACGT*"]
    for wrong in ("AXG", "*ACG*", "acgt", "A*C"):
        with pytest.raises(ValueError, match="no adapter"):
            kernels.parse_adapters(wrong)


def test_log_tables():
    assert rescue.LOG_MATCH[0] == rescue.LOG_MATCH[1] and np.isclose(rescue.LOG_MISMATCH[40], math.log(1e-4 / 3))
