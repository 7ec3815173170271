"""Index of the k-mers of contigs: blocks, k-mers of both strands, repeat cap, neighbours, positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as sq
from strandlake.tables import task_count, written

#: Repeats from which a k-mer of the index is only a marker; letters of a block of a contig.
REPEAT_CAP, BLOCK = 1000, 512
#: K-mers of one task in which neighbours are searched.
NEAR_ROWS = 1 << 20


def blocks(contigs: DataFrame, keys: list[str], seq: str, k: int, size: int = BLOCK) -> DataFrame:
    """(keys, block_start, block): a contig in blocks that overlap by k - 1 letters.

    Work on a k-mer then costs the same wherever it stands in a contig, and a long contig is many rows.
    A null or empty contig has no block.
    """
    n = F.length(seq)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    rows = contigs.select(*keys, F.col(seq).alias("__s"), F.explode(starts).alias("block_start"))
    return rows.select(*keys, F.col("block_start").cast("long").alias("block_start"), F.substring("__s", F.col("block_start") + 1, F.lit(size + k - 1)).alias("block"))


def contig_kmers(contigs: DataFrame, keys: list[str], seq: str, k: int, both_strands: bool = False) -> DataFrame:
    """(keys, pos, kmer[, reverse]) for every k-mer of A, C, G and T; pos is 0-based."""
    each = blocks(contigs, keys, seq, k).select(*keys, "block_start", F.explode(sq.kmers(F.col("block"), k)).alias("m"))
    forward = each.select(*keys, (F.col("block_start") + F.col("m.i")).alias("pos"), F.col("m.kmer").alias("kmer"))
    if not both_strands:
        return forward
    strand = F.explode(F.array(F.struct(F.col("kmer").alias("kmer"), F.lit(False).alias("reverse")), F.struct(sq.reverse_complement(F.col("kmer")).alias("kmer"), F.lit(True).alias("reverse"))))
    return forward.select(*keys, "pos", strand.alias("s")).select(*keys, "pos", "s.kmer", "s.reverse")


def build_index(contigs: DataFrame, keys: list[str], seq: str, k: int, repeat_cap: int = REPEAT_CAP) -> DataFrame:
    """(kmer, repeats, hits): forward positions of each k-mer, sorted; null where it repeats too often.

    Repeats are counted on both strands. Counts come first, so a hot k-mer is never collected: only
    positions of k-mers below the cap are grouped.
    """
    kmers = contig_kmers(contigs, keys, seq, k, both_strands=True)
    counts = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("repeats"), F.count_if(~F.col("reverse")).alias("forward"))
    counts = counts.where("forward > 0")
    rare = kmers.where("NOT reverse").join(counts.where(F.col("repeats") <= repeat_cap).select("kmer"), "kmer", "left_semi")
    hits = rare.groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct(*keys, "pos"))).alias("hits"))
    return counts.select("kmer", "repeats").join(hits, "kmer", "left")


def mark_neighbours(kmers: DataFrame, k: int, distance: int, parts: int) -> DataFrame:
    """(kmer): those of the distinct k-mers that have another one within ``distance`` mismatches.

    Up to two mismatches: two k-mers are that close if they are equal once letters at the same one or two
    places are taken out, so counting these forms is enough and no pair is listed. Beyond: with
    ``parts`` parts some ``parts - distance`` of them are equal. Choice by choice of these, the k-mers that
    have no neighbour yet are compared with those of equal parts, inside of a task and without a list of
    pairs, until none is left or all choices are through. Runs at once, not when the result is read.
    """
    edges = [round(i * k / parts) for i in range(parts + 1)]
    distinct = kmers.select("kmer").where(F.length("kmer") == k).distinct()
    if distance <= 2:
        hole = lambda text, i: F.overlay(text, F.lit("."), i, F.lit(1))
        if distance == 1:
            forms = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: hole("kmer", i))
        else:
            forms = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.transform(F.sequence(i + 1, F.lit(k)), lambda j: hole(hole("kmer", i), j))))
        each = distinct.select("kmer", F.explode(forms).alias("form"))
        shared = each.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return each.join(shared, "form").select("kmer").distinct()
    distinct = written(distinct)
    tasks = max(task_count(distinct.sparkSession), distinct.count() // NEAR_ROWS + 1)
    alone = distinct
    for c in combinations(range(parts), parts - distance):
        key = F.concat(*(F.substring("kmer", edges[p] + 1, edges[p + 1] - edges[p]) for p in c))
        keyed = distinct.withColumn("key", key)
        if alone is not distinct:
            keyed = keyed.join(alone.select(key.alias("key")).distinct(), "key", "left_semi")
        equal = [i for p in c for i in range(edges[p], edges[p + 1])]
        found = keyed.repartition(tasks, "key").select("kmer").mapInArrow(_near(k, distance, equal), "kmer string")
        alone = written(alone.join(found, "kmer", "left_anti"))
        if alone.isEmpty():
            return distinct
    return distinct.join(alone, "kmer", "left_anti")


def _near(k: int, distance: int, equal: list[int]):
    """Function of a task's k-mers: those with another one within ``distance`` that has the same letters at ``equal``."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.chunked_array([b.column(0) for b in batches], pa.string()).combine_chunks()
        n = len(texts)
        letters = np.zeros((n, -(-k // 8) * 8), np.uint8)
        letters[:, :k] = np.frombuffer("".join(texts.to_pylist()).encode("ascii"), np.uint8).reshape(n, k)
        same = np.zeros_like(letters)
        same[:, equal] = letters[:, equal]
        words, same = letters.view(np.uint64), same.view(np.uint64)
        order = np.lexsort(same.T)
        words, same = words[order], same[order]
        first = np.flatnonzero(np.r_[n > 0, (same[1:] != same[:-1]).any(1)])
        sizes = np.diff(np.r_[first, n])
        start, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        marked, at, lag = np.zeros(n, bool), np.arange(n), 1
        while len(at):
            for i, j in ((x := at[at + lag < end[at]], x + lag), (x := at[at - lag >= start[at]], x - lag)):
                d = words[i] ^ words[j]
                for shift in (4, 2, 1):
                    d |= d >> np.uint64(shift)
                close = np.bitwise_count(d & np.uint64(0x0101010101010101)).sum(1) <= distance
                marked[i[close]] = marked[j[close]] = True
            lag += 1
            at = at[~marked[at] & ((at + lag < end[at]) | (at - lag >= start[at]))]
        yield pa.RecordBatch.from_arrays([texts.take(pa.array(order[marked]))], names=["kmer"])

    return near


def annotate(index: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Index with ``has_neighbours``."""
    return index.join(neighbours.select("kmer").withColumn("has_neighbours", F.lit(True)), "kmer", "left").withColumn("has_neighbours", F.coalesce("has_neighbours", F.lit(False)))


def annotate_positions(index: DataFrame, flagged: DataFrame, place: list[str]) -> DataFrame:
    """Index with ``has_neighbours`` where the first position of a k-mer is among those ``flagged`` (columns ``place``)."""
    rows = index.withColumn("__first", F.get("hits", F.lit(0)))
    flags = flagged.select(*(F.col(c).alias(f"__f_{c}") for c in place)).distinct().withColumn("has_neighbours", F.lit(True))
    match = F.lit(True)
    for c in place:
        match = match & (F.col(f"__first.{c}") == F.col(f"__f_{c}"))
    return rows.join(flags, match, "left").select(*index.columns, F.coalesce("has_neighbours", F.lit(False)).alias("has_neighbours"))


def neighbour_positions(annotated: DataFrame) -> DataFrame:
    """Positions of all k-mers of an index that have neighbours."""
    return annotated.where("has_neighbours").select(F.explode("hits").alias("h")).select("h.*")


def high_repeats(contigs: DataFrame, keys: list[str], seq: str, index: DataFrame) -> DataFrame:
    """(keys, pos): positions at which no k-mer of the index is stored: repeats beyond its cap, other letters, ends of contigs."""
    starts = F.sequence(F.lit(0), F.length(seq) - 1, F.lit(BLOCK))
    each = contigs.where(F.length(seq) > 0).select(*keys, F.length(seq).alias("__n"), F.explode(starts).alias("__s"))
    each = each.select(*keys, F.explode(F.sequence(F.col("__s").cast("long"), F.least(F.col("__s") + BLOCK, F.col("__n")).cast("long") - 1)).alias("pos"))
    stored = index.select(F.explode("hits").alias("h")).select(*(F.col(f"h.{c}").alias(c) for c in (*keys, "pos")))
    return each.join(stored, [*keys, "pos"], "left_anti")


def translate_contigs(positions: DataFrame, contig: str, contigs: DataFrame, old: str, new: str) -> DataFrame:
    """Positions with their contig in another numbering (``contigs``: old, new); null for an unknown contig."""
    names = contigs.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return positions.join(names, F.col(contig) == F.col("__old"), "left").withColumn(contig, F.col("__new")).drop("__old", "__new")


def contig_metadata(contigs: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(keys, total_bases, acgt_bases, md5): of the sequence without white space, its letters in upper case."""
    s = F.translate(F.regexp_replace(F.coalesce(seq, F.lit("")), r"\s", ""), ascii_lowercase, ascii_uppercase)
    return contigs.select(*keys, F.length(s).cast("long").alias("total_bases"), F.length(F.regexp_replace(s, "[^ACGT]", "")).cast("long").alias("acgt_bases"), F.md5(s.cast("binary")).alias("md5"))


def genomic_offsets(contigs: DataFrame, order: str, size: str, by: list[str] | None = None) -> DataFrame:
    """Contigs with ``genomic_offset``: the bases of all before. A genome has few contigs: one row each."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("genomic_offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def reorder(contigs: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Contigs with ``place`` in an explicit order, which must name each exactly once."""
    place = F.array_position(F.lit(order), F.col(name))
    wrong = (place == 0) | (F.size(F.array_distinct(F.lit(order))) != len(order))
    return contigs.withColumn("place", F.when(wrong, F.raise_error(F.lit("the order is not a permutation of the contigs"))).otherwise(place - 1))


def islands(flags: DataFrame, source: list[str], position: str, value: str) -> DataFrame:
    """Runs of equal values at consecutive positions: (source, first, last, value, length)."""
    w = Window.partitionBy(*source).orderBy(position)
    same: Column = (F.col(position) - F.lag(position).over(w) == 1) & F.col(value).eqNullSafe(F.lag(value).over(w))
    rows = flags.withColumn("__run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    return rows.groupBy(*source, "__run", value).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")
