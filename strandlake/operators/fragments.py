"""Candidate alignments of reads: building, consolidating, scoring by columns, and choosing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import score as sc
from strandlake.functions import sequence as sq

#: Hits of one seed from which its candidates are dropped.
REPEAT_CAP = 10


def drop_repeats(candidates: DataFrame, seed: list[str], cap: int = REPEAT_CAP) -> DataFrame:
    """Candidates of seeds with fewer than ``cap`` of them."""
    few = candidates.groupBy(*seed).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < cap).drop("__n")
    return candidates.join(few, seed, "left_semi")


def consolidate(candidates: DataFrame, place: list[str]) -> DataFrame:
    """Candidates of several seeds at one place as one: unique seeds summed, weak offsets spanned."""
    return candidates.groupBy(*place).agg(F.sum("unique_seeds").alias("unique_seeds"), F.min("weak_offset").alias("weak_first"), F.max("weak_offset").alias("weak_last"))


def ungapped_score(read: Column, ref: Column, qual: Column) -> dict[str, Column]:
    """Mismatches, longest run of matches and log probability of a read laid on a reference of its length."""
    flags = F.zip_with(F.split(read, ""), F.split(ref, ""), sq.is_match)
    run = F.aggregate(
        flags,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda s, m: F.struct(F.when(m, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(m, s["now"] + 1).otherwise(0)).alias("best")),
        lambda s: s["best"],
    )
    probability = F.aggregate(F.zip_with(flags, qual, lambda m, q: F.when(m, sc.log_match(q)).otherwise(sc.log_mismatch(q))), F.lit(0.0), lambda s, x: s + x)
    return {"mismatch_count": sq.mismatches(read, ref), "matches_in_row": run, "log_probability": probability}


def clip_to_contig(position: Column, length: Column, contig_length: Column) -> dict[str, Column]:
    """Bases of a placed read before the start and after the end of its contig, and the place of the rest."""
    left = F.least(length, F.greatest(F.lit(0), -position))
    right = F.least(length - left, F.greatest(F.lit(0), position + length - contig_length))
    return {"clip_left": left, "clip_right": right, "clipped_position": position + left}


def best_candidate(candidates: DataFrame, read: list[str], cost: str, log_probability: str, order: list[str], scatter: str | None = None) -> DataFrame:
    """The candidate of lowest cost, then of highest log probability, of each read.

    Log probabilities within EPSILON of the best are ties; ``ties`` counts them. Of ties the first by
    ``order`` is taken, or number ``scatter`` modulo their number, which spreads repeats evenly.
    """
    low = candidates.groupBy(*read).agg(F.min(cost).alias("__cost"))
    at = candidates.join(low, read).where(F.col(cost) == F.col("__cost")).drop("__cost")
    high = at.groupBy(*read).agg(F.max(log_probability).alias("__lp"))
    tied = at.join(high, read).where(F.col(log_probability) >= F.col("__lp") - sc.EPSILON).drop("__lp")
    w = Window.partitionBy(*read)
    tied = tied.withColumn("ties", F.count(F.lit(1)).over(w)).withColumn("__k", F.row_number().over(w.orderBy(*order)) - 1)
    wanted = F.pmod(F.col(scatter), F.col("ties")) if scatter else F.lit(0)
    return tied.where(F.col("__k") == wanted).drop("__k")


def fragment_score(candidates: DataFrame, read: list[str], log_probability: str, rest: Column) -> DataFrame:
    """The best log probability of each read's distinct candidates and its score against the others."""
    distinct = candidates.dropDuplicates([*read, "contig", "pos", "reverse"])
    sums = distinct.groupBy(*read).agg(F.max(log_probability).alias("best"), F.sum(F.exp(log_probability)).alias("total"))
    best = F.exp("best")
    return sums.select(*read, "best", sc.phred(F.greatest(F.col("total") - best, F.lit(0.0)) + rest, best).alias("score"))
