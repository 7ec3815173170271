"""Column expressions on qualities, probabilities, positions, flags and pair models."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Natural logs differ by less than this when they count as equal.
EPSILON = 1e-7
#: Probability mass within three and within one standard deviation.
THREE_SIGMA, ONE_SIGMA = math.erf(3 / math.sqrt(2)), math.erf(1 / math.sqrt(2))
#: Highest mapping quality; score above which a fragment is uniquely aligned; seed lengths.
MAPQ_CAP, UNIQUE_SCORE, WEAK_SEED = 60, 3, 32
#: Names of the eight orders and orientations of two ends, by number.
MODELS = ("FFp", "FRp", "RFp", "RRp", "FFm", "FRm", "RFm", "RRm")


def log_match(q: Column) -> Column:
    """Log probability of a right base; quality 0 counts as 1."""
    return F.log1p(-F.pow(F.lit(10.0), -F.greatest(q, F.lit(1)) / 10))


def log_mismatch(q: Column) -> Column:
    """Log probability of one certain wrong base; quality 0 as a right base of quality 1."""
    return F.when(q == 0, F.lit(math.log(1 - 10**-0.1))).otherwise(F.ln(F.pow(F.lit(10.0), -q / 10) / 3))


def phred(other: Column, best: Column) -> Column:
    """Score of the best alternative against the others: floor(-10 log10(other / (other + best)))."""
    return F.floor(-10 * F.log10(other / (other + best))).cast("int")


def nearly(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EPSILON


def rest_of_genome(genome: Column, length: Column) -> Column:
    """Expected number of chance hits of a read in a genome on both strands."""
    return 2 * genome / F.pow(F.lit(4.0), length)


def seed_position(position: Column, offset: Column, seed: int, length: Column, reverse: Column) -> Column:
    """Start of a read from the position of its seed."""
    return F.when(reverse, position + seed + offset - length).otherwise(position - offset)


def model(first_reverse: Column, second_reverse: Column, first_after: Column) -> Column:
    """Number of the orientation model: 2 for a reverse first end, 1 for a reverse second end, 4 if the first lies after."""
    return F.when(first_after, 4).otherwise(0) + F.when(first_reverse, 2).otherwise(0) + F.when(second_reverse, 1).otherwise(0)


def model_class(number: Column) -> Column:
    """Class of a model: the same for a model and its mirror image."""
    return F.when(number < 4, number).otherwise(7 - number)


def template_length(pos1: Column, len1: Column, pos2: Column, len2: Column) -> Column:
    """Bases from the leftmost to the rightmost base of two ends."""
    return F.greatest(pos1 + len1, pos2 + len2) - F.least(pos1, pos2)


def signed_length(pos: Column, mate: Column, length: Column, first: Column) -> Column:
    """TLEN: positive for the leftmost end; of equal positions for the first read."""
    return F.when((pos < mate) | ((pos == mate) & first), length).otherwise(-length)


def check_model(length: Column, number: Column, low: Column, high: Column, best: Column, second: Column) -> Column:
    """'nomatch' for another orientation, else 'oversized', 'undersized' or 'nominal'."""
    return F.when((number != best) & (number != second), "nomatch").when(length > high, "oversized").when(length < low, "undersized").otherwise("nominal")


def mapq(single: Column, template: Column, proper: Column, pessimistic: bool = False, unknown: int = 0) -> Column:
    """Mapping quality: of the better score in a proper pair (the worse if ``pessimistic``), else of the fragment's.

    A missing score gives ``unknown``.
    """
    pair = F.least(single, template) if pessimistic else F.greatest(single, template)
    score = F.when(proper, F.when(template.isNotNull(), pair)).otherwise(single)
    return F.when(score.isNull(), F.lit(unknown)).otherwise(F.least(F.lit(MAPQ_CAP), score))


#: Bits of a BAM record's flag.
FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "fail": 512, "duplicate": 1024}


def bam_flag(**bits: Column) -> Column:
    """Flag from boolean columns; null counts as false."""
    out = F.lit(0)
    for name, bit in bits.items():
        out = out.bitwiseOR(F.when(bit, FLAGS[name]).otherwise(0))
    return out


def bam_bin(begin: Column, end: Column) -> Column:
    """Number of the smallest index bin that holds [begin, end)."""
    last = end - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(begin, shift) == F.shiftright(last, shift), first + F.shiftright(begin, shift)).otherwise(out)
    return out


def very_bad(in_a_row: Column, mismatch_count: Column, mapped: Column, log_probability: Column) -> Column:
    """An alignment without a run of 32 matches that has too many mismatches or is too improbable."""
    worst = math.log(1e-4 / 3) / 4
    return (in_a_row < 32) & ((mismatch_count > F.floor(mapped / 8)) | (log_probability < worst * mapped))


def uniquely_aligned(score: Column) -> Column:
    return F.coalesce(score > UNIQUE_SCORE, F.lit(False))


def well_anchored(unique_seeds: Column, weak_first: Column, weak_last: Column) -> Column:
    """A unique seed, or weak seeds that together span a seed's length."""
    return (unique_seeds > 0) | F.coalesce(weak_last - weak_first >= WEAK_SEED, F.lit(False))


def duplicate_rank(quality: Column, length: Column, edits: Column, score: Column) -> Column:
    """Order of duplicates: total quality, matching bases, score; an unknown score is the lowest."""
    return F.struct(quality.alias("quality"), (length - edits).alias("matches"), F.coalesce(score, F.lit(-1)).alias("score"))


def seed_id(tile: Column, barcode: Column, cluster: Column, seed: Column, reverse: Column) -> Column:
    """64-bit identity of a seed: 12, 12, 31, 8 and 1 bits; null if a part is out of its range."""
    fits = (tile < 1 << 12) & (barcode < 1 << 12) & (cluster < 1 << 31) & (seed < 1 << 8)
    parts = [F.shiftleft(tile.cast("long"), 52), F.shiftleft(barcode.cast("long"), 40), F.shiftleft(cluster.cast("long"), 9), F.shiftleft(seed.cast("long"), 1), reverse.cast("long")]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return F.when(fits, out)


def seed_parts(number: Column) -> dict[str, Column]:
    cut = lambda shift, bits: F.shiftrightunsigned(number, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return {"tile": cut(52, 12), "barcode": cut(40, 12), "cluster": cut(9, 31), "seed": cut(1, 8), "reverse": cut(0, 1) == 1}
