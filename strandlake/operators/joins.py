"""Joins that Spark has no single operator for: capped seeds, two passes, intervals, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.tables import written

#: Hits from which a seed counts as a repeat.
SEED_CAP = 10
#: Order of match kinds: a repeat sorts first, no match last.
KINDS = ("too_many", "hit", "none")


def seed_join(seeds: DataFrame, index: DataFrame, cap: int = SEED_CAP) -> DataFrame:
    """Seeds with ``match_kind`` and one row for each hit: none, 1 to cap - 1 hits, or too many.

    The index side is cut to the cap before the join, so a repeat is one row and no seed meets more
    than cap - 1 positions.
    """
    few = index.select("kmer", F.when(F.size("hits") < cap, F.col("hits")).alias("hits"), F.lit(True).alias("known"))
    joined = seeds.join(few, "kmer", "left")
    kind = F.when(F.col("known").isNull(), "none").when(F.col("hits").isNull(), "too_many").otherwise("hit")
    return joined.select(*seeds.columns, kind.alias("match_kind"), F.explode_outer("hits").alias("hit"))


def seed_search(seeds: DataFrame, kmers: DataFrame, place: list[str], cap: int = SEED_CAP) -> DataFrame:
    """As ``seed_join``, against the k-mers of contigs (``kmer`` and the columns of ``place``) without an index.

    Only k-mers that some seed has are kept, in a table written once (the k-mers of all contigs are made
    one time only); they are counted, and the places of those below the cap joined row by row, so no
    list of places is built and a repeat never meets its places.
    """
    near = written(kmers.join(seeds.select("kmer").distinct(), "kmer", "left_semi").select("kmer", *place))
    counts = near.groupBy("kmer").agg(F.count(F.lit(1)).alias("__n"))
    hits = near.join(counts.where(F.col("__n") < cap), "kmer").select("kmer", F.struct(*place).alias("hit"))
    kind = F.when(F.col("__n").isNull(), "none").when(F.col("__n") >= cap, "too_many").otherwise("hit")
    found = seeds.join(counts, "kmer", "left").select(*seeds.columns, kind.alias("match_kind"))
    return found.join(hits, "kmer", "left").select(*seeds.columns, "match_kind", "hit")


def two_pass(seeds: DataFrame, search, read: list[str], order: str, first: int = 1) -> DataFrame:
    """Matches of the first seeds; of further seeds only those of reads that the first left without a hit.

    ``search`` gives the matches of some seeds, by ``seed_join`` or ``seed_search``. All seeds are searched
    at once, as a pass over the index costs more than the seeds that a second one would spare.
    """
    found = written(search(seeds))
    one = found.where(F.col(order) < first)
    resolved = one.where("match_kind = 'hit'").select(*read).distinct()
    rest = found.where(F.col(order) >= first).join(resolved, read, "left_anti")
    return one.withColumn("pass", F.lit(1)).unionByName(rest.withColumn("pass", F.lit(2)))


def neighbour_join(seeds: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """Seeds with every k-mer that has the same first half and exactly one mismatch in the second.

    The variants of a seed (three for each letter of its second half) are joined by equality, so no
    bucket of equal halves is compared pair by pair and none needs a cap. Repeated k-mers count once.
    """
    half = k // 2
    places = F.sequence(F.lit(half + 1), F.lit(k))
    letters = F.array(*(F.lit(x) for x in "ACGT"))
    every = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda x: F.overlay("kmer", x, i, F.lit(1)))))
    near = seeds.select("*", F.explode(F.array_except(every, F.array("kmer"))).alias("neighbour"))
    return near.join(kmers.select(F.col("kmer").alias("neighbour")).distinct(), "neighbour")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], bucket: int) -> DataFrame:
    """Rows of both sides whose half-open intervals overlap, as an equi-join on buckets of positions.

    A pair that shares several buckets is kept in the first of them only, so no distinct is needed.
    Empty intervals overlap nothing. Columns of the sides must differ, but for the keys.
    """
    (a, b), (c, d) = left_ends, right_ends
    span = lambda lo, hi: F.when(F.col(hi) > F.col(lo), F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket)))
    lhs = left.withColumn("__bucket", F.explode(span(a, b)))
    rhs = right.withColumn("__bucket", F.explode(span(c, d)))
    joined = lhs.join(rhs, [*keys, "__bucket"]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return joined.where(F.col("__bucket") == F.floor(F.greatest(a, c) / bucket)).drop("__bucket")


def pair_join(first: DataFrame, second: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Candidates of both ends of a cluster on one contig, no further apart than ``longest``.

    Both sides have pos and len, as pos1, len1 and pos2, len2.
    """
    joined = first.join(second, keys)
    length = F.greatest(F.col("pos1") + F.col("len1"), F.col("pos2") + F.col("len2")) - F.least("pos1", "pos2")
    return joined.withColumn("template_length", length).where(F.col("template_length") <= longest)
