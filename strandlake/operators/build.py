"""From fragments to sorted output: duplicates, bins of the genome, gaps, order and columns of BAM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import score as sc
from strandlake.functions import sequence as sq
from strandlake.operators.joins import interval_join

#: Bases of one entry of the match distribution; first bases that place an unaligned fragment.
DISTRIBUTION_BIN, SHADOW_BASES = 2048, 32


def mark_duplicates(fragments: DataFrame, place: list[str], rank: Column, order: list[str], library: list[str] | None = None, owner: list[str] | None = None) -> DataFrame:
    """Fragments with ``duplicate``: all but the best of those at one place in one library.

    ``place`` holds own anchor, mate anchor and mate strand. The best has the highest rank, then comes
    first by ``order``, which identifies a fragment: rows with equal ``order`` are one. With ``owner`` (the cluster) both ends of the best cluster stay. The first of
    each place is found by an aggregate with map-side combine, so a hot place is no window partition.
    """
    keys = [*place, *(library or [])]
    first = F.min(F.struct(*(_descending(rank, c) for c in ("quality", "matches", "score")), *(F.col(c).alias(f"__o_{c}") for c in order)))
    best = fragments.groupBy(*keys).agg(first.alias("__b"))
    best = best.select(*(F.col(c).alias(f"__k_{c}") for c in keys), *(F.col(f"__b.__o_{c}").alias(f"__o_{c}") for c in order))
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = fragments.join(best, match, "left")
    stays = F.lit(True)
    for c in owner or order:
        stays = stays & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return joined.withColumn("duplicate", ~stays).drop(*(f"__k_{c}" for c in keys), *(f"__o_{c}" for c in order))


def _descending(rank: Column, field: str) -> Column:
    return (-rank[field]).alias(f"__{field}")


def anchor(contig: Column, pos: Column, observed: Column, reverse: Column, seq: Column) -> Column:
    """What places a fragment: its strand position, or of an unaligned one (null contig) its first SHADOW_BASES bases."""
    strand = F.when(reverse, F.greatest(pos + observed, F.lit(1)) - 1).otherwise(pos)
    return F.when(contig.isNotNull(), F.concat_ws(":", contig, strand)).otherwise(F.substring(seq, 1, SHADOW_BASES))


def mark_pair_duplicates(fragments: DataFrame, rank: Column, library: list[str], order: list[str], cluster: str, paired: bool = True) -> DataFrame:
    """``mark_duplicates`` of the fragments of pairs, by the anchors of both ends.

    Needs contig (null: unaligned), pos, observed, reverse, seq, the same with ``mate_`` before them, and mate_bin. Forward
    fragments compete at one position; reverse and unaligned ones at one anchor. The mate's anchor,
    strand, bin and whether it is aligned must be equal. Both ends of the best cluster stay. Fragments of single
    reads (``paired`` false) are no duplicates.
    """
    if not paired:
        return fragments.withColumn("duplicate", F.lit(False))
    of = lambda p: anchor(*(F.col(p + x) for x in ("contig", "pos", "observed", "reverse", "seq")))
    forward = F.col("contig").isNotNull() & ~F.col("reverse")
    rows = fragments.withColumns({"__forward": forward, "__anchor": of(""), "__mate": of("mate_"), "__shadow": F.col("mate_contig").isNull()})
    place = ["__forward", "__anchor", "__mate", "__shadow", "mate_reverse", "mate_bin"]
    return mark_duplicates(rows, place, rank, order, library, [cluster]).drop("__forward", "__anchor", "__mate", "__shadow")


def duplicate_stats(marked: DataFrame, by: list[str]) -> DataFrame:
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("duplicate")).alias("unique_fragments"))


def match_distribution(hits: DataFrame, contig: str, pos: str, weight: Column | None = None) -> DataFrame:
    """(contig, bin, matches): hits in each stretch of DISTRIBUTION_BIN bases."""
    w = weight if weight is not None else F.lit(1)
    return hits.groupBy(contig, F.floor(F.col(pos) / DISTRIBUTION_BIN).alias("bin")).agg(F.sum(w).cast("long").alias("matches"))


def plan_bins(distribution: DataFrame, contig: str, target: int) -> DataFrame:
    """(contig, bin, output_bin): consecutive stretches packed greedily up to ``target`` matches.

    Output bins don't spread across contigs and count from 0 within each; a stretch above the target
    is a bin of its own. The packing is sequential within a contig, whose stretches are few (a contig
    has at most its length / DISTRIBUTION_BIN of them), each 16 bytes.
    """

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        out, now, size = [], 0, 0
        for n in part["matches"]:
            if size and size + n > target:
                now, size = now + 1, 0
            size += n
            out.append(now)
        return part[[contig, "bin"]].assign(output_bin=out)

    kind = distribution.schema[contig].dataType.simpleString()
    return distribution.groupBy(contig).applyInPandas(pack, f"{contig} {kind}, bin long, output_bin long")


def bam_order(contig: str, pos: str, tile: str, cluster: str, unmapped: Column, second: Column, unaligned: str = "back") -> list[Column]:
    """Sort columns of a BAM file: place, cluster, unmapped ends after mapped, second reads after first."""
    place = F.asc_nulls_last if unaligned == "back" else F.asc_nulls_first
    return [place(contig), place(pos), F.asc(tile), F.asc(cluster), unmapped.asc(), second.asc()]


def keep_unaligned(fragments: DataFrame, contig: str, mode: str) -> DataFrame:
    """'discard' drops fragments without contig; 'front' and 'back' keep them for ``bam_order``."""
    return fragments.where(F.col(contig).isNotNull()) if mode == "discard" else fragments


def collect_gaps(fragments: DataFrame, keys: list[str], pos: str, cigar: str) -> DataFrame:
    """(keys, gap_pos, gap_len): deletions as positive, insertions as negative lengths, each once."""
    ops = sq.cigar_ops(F.col(cigar))
    rows = fragments.where(F.col(cigar).rlike("[ID]")).select(*keys, F.col(pos).alias("__p"), ops.alias("__ops"))
    rows = rows.select(*keys, "__p", "__ops", F.posexplode("__ops").alias("__i", "__o"))
    before = sq.mapped_length(F.slice("__ops", F.lit(1), F.col("__i")))
    gap = F.when(F.col("__o.op") == "D", F.col("__o.len")).when(F.col("__o.op") == "I", -F.col("__o.len"))
    return rows.select(*keys, (F.col("__p") + before).alias("gap_pos"), gap.alias("gap_len")).where("gap_len IS NOT NULL").distinct()


def gap_scope(scope: str, sample: str, project: str) -> Column | None:
    """Group within which fragments share their gaps: 'sample', 'project', 'all' or 'none' (no group, no realignment)."""
    scopes = {"sample": F.col(sample), "project": F.col(project), "all": F.lit("all"), "none": None}
    if scope not in scopes:
        raise ValueError(f"{scope} is no scope; there are {', '.join(scopes)}")
    return scopes[scope]


def gap_conflicts(gaps: DataFrame, keys: list[str], bucket: int = 64) -> DataFrame:
    """(keys, pos1, len1, pos2, len2): gaps that can't be applied together, each pair once, lower one first.

    Deletions (positive lengths) conflict if they share a base, an insertion with a deletion that covers the
    base before and the base after it or begins there, and insertions at one place. Found by an
    interval join on buckets of positions.
    """
    rows = gaps.select(*keys, F.col("gap_pos").alias("p"), F.col("gap_len").alias("n")).where("n <> 0").distinct()
    end = F.when(F.col("n") > 0, F.col("p") + F.col("n")).otherwise(F.col("p") + 1)
    side = lambda i: rows.select(*keys, F.col("p").alias(f"pos{i}"), F.col("n").alias(f"len{i}"), end.alias(f"end{i}"))
    both = interval_join(side(1), side(2), keys, ("pos1", "end1"), ("pos2", "end2"), bucket)
    return both.where((F.col("pos1") < F.col("pos2")) | ((F.col("pos1") == F.col("pos2")) & (F.col("len1") < F.col("len2")))).drop("end1", "end2")


def sam_columns(fragments: DataFrame) -> DataFrame:
    """The eleven columns of SAM from stored fragments; positions 1-based, 0 where there is none.

    Needs: name, flags (paired, proper, ...), contig_name, pos, single_score, template_score, cigar,
    mate_contig_name, mate_pos, tlen, seq, qual (array).
    """
    c = F.col
    bits = {name: c(name) for name in sc.FLAGS if name in fragments.columns}
    quality = F.array_join(F.transform("qual", lambda q: F.char(q.cast("int") + 33)), "")
    mate = F.when(c("mate_contig_name").isNull(), "*").when(c("mate_contig_name") == c("contig_name"), "=").otherwise(c("mate_contig_name"))
    return fragments.select(
        c("name").alias("qname"), sc.bam_flag(**bits).alias("flag"), F.coalesce("contig_name", F.lit("*")).alias("rname"), F.coalesce(c("pos") + 1, F.lit(0)).alias("pos"),
        sc.mapq(c("single_score"), c("template_score"), F.coalesce("proper", F.lit(False))).alias("mapq"), F.coalesce("cigar", F.lit("*")).alias("cigar"),
        mate.alias("rnext"), F.coalesce(c("mate_pos") + 1, F.lit(0)).alias("pnext"), F.coalesce("tlen", F.lit(0)).alias("tlen"), c("seq"), quality.alias("qual"),
    )


def above_mapq(fragments: DataFrame, least: int) -> DataFrame:
    """Fragments whose score reaches a threshold: that of the template in a proper pair, else their own.

    Both ends of a proper pair are so kept or dropped together. A missing score counts as too low.
    """
    score = F.when(F.coalesce(F.col("proper"), F.lit(False)), F.col("template_score")).otherwise(F.col("single_score"))
    return fragments.where(F.coalesce(score >= least, F.lit(False)))


def chosen_bins(bins: DataFrame, name: str, choice: str) -> DataFrame:
    """Bins by 'all', 'skip-empty' (those with matches) or a regular expression of their name."""
    if choice == "all":
        return bins
    return bins.where(F.col("matches") > 0) if choice == "skip-empty" else bins.where(F.col(name).rlike(choice))


def chosen_clusters(reads: DataFrame, ids: list[int], cluster: str = "cluster_id") -> DataFrame:
    """Reads of the listed clusters; an empty list means all."""
    return reads.where(F.col(cluster).isin(ids)) if ids else reads
