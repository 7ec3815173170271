"""Alignment kernels against exhaustive search and known alignments."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import kernels as k
from strandlake.operators import rescue
from strandlake.plans import kernels as plans


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def best_score(q, d, s=k.SCORES):
    """Highest score of any alignment within the band."""

    @functools.lru_cache(None)
    def go(i, j, gap):
        if i == len(q):
            return 0
        best = (s[0] if j < len(d) and q[i] == d[j] else s[1]) + go(i + 1, j + 1, "")
        if i and j - i > 0:
            best = max(best, (s[3] if gap == "I" else s[2]) + go(i + 1, j, "I"))
        if i and j - i + 1 < k.BAND:
            best = max(best, (s[3] if gap == "D" else s[2]) + go(i, j + 1, "D"))
        return best

    return max(go(0, o, "") for o in range(k.BAND))


@pytest.mark.parametrize("scores", [k.SCORES, (2, -1, -15, -3)])
def test_banded_alignment_is_the_best(scores):
    rng = random.Random(1)
    pairs = []
    for _ in range(60):
        q = dna(rng, rng.randint(4, 14))
        i = rng.randint(1, len(q) - 1)
        pairs.append((q, (dna(rng, 3) + q[:i] + dna(rng, rng.randint(0, 4)) + q[i + rng.randint(0, 2) :] + dna(rng, 20))[: len(q) + 15]))
    got = k.banded_align([q for q, _ in pairs], [d for _, d in pairs], scores)
    assert [g[2] for g in got] == [best_score(q, d, scores) for q, d in pairs]


def test_banded_alignment_known():
    rng = random.Random(2)
    d = dna(rng, 115)
    assert [x[:2] for x in k.banded_align([d[i : i + 100] for i in range(16)], [d] * 16)] == [(i, "100M") for i in range(16)]
    left, out, right = dna(rng, 39) + "T", "AGAGCAGCGAGCGACAGCAGCAGCAAA", dna(rng, 40)
    for n in range(1, 14):
        assert k.banded_align([left + right], [left + out[:n] + right + dna(rng, 15 - n)])[0][:2] == (0, f"40M{n}D40M")
    d = dna(rng, 230)
    for n in range(1, 10):
        q = d[12:112] + "T" * n + d[112:190]
        offset, cigar, _ = k.banded_align([q], [d])[0]
        assert offset == 12 and cigar.count("I") == 1 and f"{n}I" in cigar
    assert k.banded_align(["", "A"], ["ACGT", "ACGT"]) == [(0, "", 0), (0, "1M", 0)]


def test_simple_indel():
    rng = random.Random(3)
    ref = dna(rng, 300)
    assert k.simple_indel(ref[10:81] + ref[95:163], ref, 10, 24) == ("71M14D68M", 0, 14)
    cigar, wrong, edits = k.simple_indel(ref[10:80] + "GATTACA" + ref[80:140], ref, 10, 3)
    assert wrong == 0 and edits == 7 and "7I" in cigar
    assert k.simple_indel(ref[:100], ref, 0, 0) is None and k.simple_indel(ref[:100], ref, 0, 101) is None and k.simple_indel("A" * 20, ref, 0, 5) is None


def test_clips():
    assert k.semialigned("TTTTACGTACGTTT", "CCCCACGTACGCCC") == (4, 3)
    assert k.semialigned("AAAA", "CCCC") == (0, 0)
    read, ref = "ACGTACGTAC" + "CTGTCTCTTATACACATCTGG", "ACGTACGTAC" + "A" * 21
    assert k.adapter_clip(read, ref, ["CTGTCTCTTATACACATCT*"]) == (10, len(read))
    assert k.adapter_clip(read, ref, ["CTGTCTCTTATACACATCT"]) == (10, 29)
    assert k.adapter_clip(read, read, ["CTGTCTCTTATACACATCT"]) == (0, 0)
    assert k.overlap_clip(0, 50, 30.0, 40, 50, 20.0) == (0, 10) and k.overlap_clip(0, 50, 10.0, 40, 50, 20.0) == (10, 0)
    assert k.overlap_clip(0, 50, 1, 50, 50, 2) == (0, 0) and k.overlap_clip(0, 50, 1, 10, 20, 2) == (0, 0)


def test_realignment():
    rng = random.Random(4)
    ref = dna(rng, 200)
    read = ref[10:84] + ref[87:110]
    assert k.realign(read, ref, 10, [(84, 3), (50, -2)]) == ("74M3D23M", 10, 0, 4)
    assert k.realign(ref[10:110], ref, 10, [(84, 3)]) == ("100M", 10, 0, 0)
    # held at its end: the read was placed as if its tail were in place
    assert k.realign(read, ref, 13, [(84, 3)])[:3] == ("74M3D23M", 10, 0)
    inserted = ref[10:60] + "GG" + ref[60:108]
    assert k.realign(inserted, ref, 10, [(60, -2)])[2] == 0
    assert k.realign(read, ref, 10, []) == ("97M", 10, k.realign(read, ref, 10, [])[2], k.realign(read, ref, 10, [])[3])


def test_mate_search():
    rng = random.Random(5)
    w = dna(rng, 300)
    mate = w[120:160]
    assert k.find_mate(mate, w) == (120, 0)
    assert k.find_mate(mate[:20] + ("A" if mate[20] != "A" else "C") + mate[21:], w) == (120, 1)
    assert k.find_mate("A" * 40, "C" * 300) is None and k.find_mate("ACG", w) is None


def test_udfs_with_nulls(spark):
    df = spark.createDataFrame([("ACGTACGTAC", "ACGTACGTACGTACGTACGTACGTA", 0, 3), (None, "A", 0, 3), ("ACGT", None, 0, 3)], "q string, d string, a int, b int")
    got = df.select(k.banded_sw("q", "d").alias("s"), rescue.rescue_mate("q", "d").alias("m"), k.align_simple_indel("q", "d", "a", "b").alias("i"), k.clip_adapters(F.col("q"), F.col("d"), ["Standard"]).alias("c")).collect()
    assert got[0]["s"]["cigar"] == "10M" and got[0]["m"]["offset"] == 0
    assert all(r["s"]["cigar"] is None and r["m"]["offset"] is None and r["i"]["cigar"] is None and r["c"]["clip_from"] == 0 for r in got[1:])


def test_queries_keep_short_reads(spark, tmp_path):
    rng = random.Random(21)
    reads = {i: dna(rng, n) for i, n in enumerate([0, 2, 20, 25, 36, 37, 38, 39, 42, 43, 49, 50, 75])} | {99: None}
    schema = "tile_id int, cluster_id long, read_no int, seq string, loaded_at timestamp"
    spark.createDataFrame([(1, i, 1, s, None) for i, s in reads.items()], schema).write.parquet(str(tmp_path / "cluster_read.parquet"))
    rows = lambda f: {r["cluster_id"]: r[3:] for r in f(spark, str(tmp_path)).collect()}
    aligned, indels, mates, gaps, clips = map(rows, (plans.g08_banded_alignment, plans.g05_simple_indel, plans.j11_rescue_all, plans.g20_gap_realignment, plans.g11_adapter_clip))
    for i, s in reads.items():
        n = len(s or "")
        short = lambda most, n=n: min(most, n * most // 50)
        read = None if s is None else s[: short(20)] + s[short(20) + 3 : n - short(12)]
        assert aligned[i] == ((None,) * 3 if s is None else k.banded_align([read], [s])[0])
        head, twice = min(35, 2 * n - 42), (s or "") * 2
        assert indels[i] == ((None,) * 3 if n < 37 else k.simple_indel(twice[:head] + twice[head + 10 : head + 50], twice, 0, 10)) and (n < 37 or indels[i][1] == 0)
        assert mates[i] == ((None, None) if short(30) < 7 else (short(10), 0))
        assert gaps[i] == ((None,) * 4 if s is None else k.realign(read, s, 0, [(short(20), 3), (short(30), -2)]))
        assert clips[i] == ((0, 0) if n < 20 else (short(30), n))
    assert gaps[2][0] == "8M3D5M" and gaps[12][0] == "20M3D40M"
