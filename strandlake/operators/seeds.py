"""Where seeds stand in reads, and the seeds of all reads on both strands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequence as sq

#: Seeds that an automatic layout aims at.
WANTED = 4


@dataclass(frozen=True)
class Seed:
    """A seed: number over all reads, read (from 0), offset in it, length."""

    number: int
    read: int
    offset: int
    length: int


def auto_offsets(read_length: int, k: int) -> list[int]:
    """Both ends of the read, then seeds side by side between them, then overlapping ones up to WANTED."""
    if read_length < k:
        return []
    ends, first, past = ([0, read_length - k], k, read_length - k) if read_length > k else ([], 0, read_length)
    found = ends + list(range(first, past - k + 1, k))
    between = list(range(k // 2, past - k // 2 - k + 1, k))
    return found + between[: max(0, WANTED - len(found))]


def seed_layout(descriptor: str, read_lengths: list[int], k: int) -> list[Seed]:
    """Seeds of a descriptor: 'auto', 'all', or offsets as 'a:b:c', one part for each read by commas.

    A single part is used for all reads. Manual seeds past the end of a read are left out; a read
    without any seed, and anything that is no number, raises ValueError. 'all' includes the last offset.
    """
    parts = descriptor.split(",")
    if len(parts) == 1:
        parts *= len(read_lengths)
    if len(parts) != len(read_lengths):
        raise ValueError(f"{len(parts)} seed descriptors for {len(read_lengths)} reads")
    out: list[Seed] = []
    for read, (part, length) in enumerate(zip(parts, read_lengths, strict=True)):
        if part == "auto":
            offsets = auto_offsets(length, k)
        elif part == "all":
            offsets = list(range(length - k + 1))
        else:
            offsets = [o for o in map(int, part.split(":")) if 0 <= o <= length - k]
        if not offsets:
            raise ValueError(f"read {read} of {length} bases has no seed of {k}")
        out += [Seed(len(out) + i, read, o, k) for i, o in enumerate(offsets)]
    return out


def make_seeds(reads: DataFrame, keys: list[str], seq: str, layout: Column, k: int) -> DataFrame:
    """(keys, seed, reverse, kmer): each seed on both strands; ``layout`` is an array of struct(seed, offset).

    Seeds that hold other letters than A, C, G and T, or pass the end of their read, find nothing and
    are left out.
    """
    each = reads.select(*keys, F.col(seq).alias("__s"), F.explode(layout).alias("__p"))
    forward = F.substring("__s", F.col("__p.offset") + 1, F.lit(k))
    rows = each.select(*keys, F.col("__p.seed").alias("seed"), forward.alias("__k")).where(F.col("__k").rlike(f"^[ACGT]{{{k}}}$"))
    strands = F.explode(F.array(F.struct(F.lit(False).alias("reverse"), F.col("__k").alias("kmer")), F.struct(F.lit(True).alias("reverse"), sq.reverse_complement(F.col("__k")).alias("kmer"))))
    return rows.select(*keys, "seed", strands.alias("s")).select(*keys, "seed", "s.reverse", "s.kmer")


def auto_layout(length: Column, k: int, lengths: list[int]) -> Column:
    """Automatic layout as a column, for the read lengths that occur (a few)."""
    out = F.array().cast("array<struct<seed:int,offset:int>>")
    for n in sorted(set(lengths)):
        places = [F.struct(F.lit(i).alias("seed"), F.lit(o).alias("offset")) for i, o in enumerate(auto_offsets(n, k))]
        if places:
            out = F.when(length == n, F.array(*places)).otherwise(out)
    return out
