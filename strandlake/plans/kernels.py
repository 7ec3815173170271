"""Queries of the alignment kernels over the reads; tests hold the kernels against brute force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import kernels, rescue
from strandlake.plans.reads import READ, reads_once

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_once(spark, sf_dir).select(*READ, "seq")


def _bases(most: int) -> Column:
    """A number of bases of a read: ``most`` from 50 bases on, in proportion in a shorter one."""
    return F.least(F.lit(most), F.floor(F.length("seq") * most / 50)).cast("int")


def _without(at: Column, gap: int, end: Column) -> Column:
    """A read without ``gap`` bases from ``at`` on and ``end`` at its end."""
    return F.concat(F.substring("seq", F.lit(1), at), F.substring("seq", at + gap + 1, F.length("seq") - at - gap - end))


@query()
def g08_banded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read without three of its bases, aligned to the whole read."""
    rows = _reads(spark, sf_dir).withColumn("a", kernels.banded_sw(_without(_bases(20), 3, _bases(12)), F.col("seq")))
    return rows.select(*READ, "a.offset", "a.cigar", "a.score")


@query()
def g05_simple_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads laid on themselves twice over, with ten bases left out between the placements.

    Both flanks need 32 bases: reads below 37 bases are too short for an indel and give null.
    """
    reference = F.concat("seq", "seq")
    head = F.greatest(F.lit(0), F.least(F.lit(35), F.length("seq") * 2 - 42))
    read = F.concat(F.substring(reference, F.lit(1), head), F.substring(reference, head + 11, F.lit(40)))
    rows = _reads(spark, sf_dir).withColumn("a", kernels.align_simple_indel(read, reference, F.lit(0), F.lit(10)))
    return rows.select(*READ, "a.cigar", "a.mismatches", "a.edit_distance")


@query("""
WITH r AS (SELECT tile_id, cluster_id, read_no, max(seq) AS seq FROM cluster_read GROUP BY ALL HAVING length(max(seq)) >= 50)
SELECT tile_id, cluster_id, read_no, CAST(instr(seq, substr(seq, 11, 30)) - 1 AS INT) AS "offset", CAST(0 AS INT) AS mismatches FROM r""")
def j11_mate_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of thirty bases of each read of at least 50 in the read."""
    rows = _reads(spark, sf_dir).where(F.length("seq") >= 50).withColumn("a", rescue.rescue_mate(F.substring("seq", 11, 30), F.col("seq")))
    return rows.select(*READ, "a.offset", "a.mismatches")


@query()
def j11_rescue_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of thirty bases of each read in the read, of fewer in a read below 50 bases."""
    rows = _reads(spark, sf_dir).withColumn("a", rescue.rescue_mate(F.substring("seq", _bases(10) + 1, _bases(30)), F.col("seq")))
    return rows.select(*READ, "a.offset", "a.mismatches")


@query()
def g20_gap_realignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read without three bases, realigned with the gap of these and one that doesn't help."""
    gaps = F.array(_bases(20), _bases(30)), F.array(F.lit(3), F.lit(-2))
    rows = _reads(spark, sf_dir).withColumn("a", kernels.realign_gaps(_without(_bases(20), 3, _bases(12)), F.col("seq"), F.lit(0), *gaps))
    return rows.select(*READ, "a.cigar", "a.position", "a.mismatches", "a.cost")


@query()
def g11_adapter_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that run into an adapter after thirty bases, after fewer in a read below 50 bases."""
    read = F.substring(F.concat(F.substring("seq", F.lit(1), _bases(30)), F.lit("CTGTCTCTTATACACATCTGACGC"), F.col("seq")), F.lit(1), F.length("seq"))
    rows = _reads(spark, sf_dir).withColumn("a", kernels.clip_adapters(read, F.col("seq"), ["Nextera"]))
    return rows.select(*READ, "a.clip_from", "a.clip_to")
