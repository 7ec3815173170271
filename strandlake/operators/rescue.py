"""Placing reads on a reference in whole batches: CIGAR scores, offset votes, gapped candidates, mate rescue.

The kernels run over the bases of all rows of a batch at once (one flat array), never row by row.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import score as sc
from strandlake.functions import sequence as sq
from strandlake.operators import kernels
from strandlake.operators.template import mate_reverse, mate_window

#: Bases of a k-mer of the votes and of the search for a mate; equal offsets that confirm one.
KMER, CONFIRMED = 7, 8
#: Penalties of a mismatch, of opening and of extending a gap, and the most an extension costs.
PENALTIES = (3, 11, 4, 20)
#: Mismatches above which gaps are tried, mismatches that a gapped alignment may have.
TRY_GAPS, MOST_GAPPED = 5, 5
#: Slack around the window of a mate; log probability by which an orphan may be worse than the best.
SLACK, ORPHAN_SLACK = 10, 100.0
#: Fixed value: highest score of what isn't anchored well.
CLEAN_SCORE = 10
#: Bases of a block of a reference.
BLOCK = 512
#: Rows that a kernel takes at once.
ROWS = 512

_CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
_Q = np.arange(256, dtype=np.float64)
LOG_MATCH = np.log1p(-(10 ** (-np.maximum(_Q, 1) / 10)))
LOG_MISMATCH = np.where(_Q == 0, np.log(1 - 10**-0.1), np.log(10 ** (-_Q / 10) / 3))


class Flat:
    """Texts of many rows as one array of bytes."""

    def __init__(self, texts: list[str]) -> None:
        self.bytes = np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]

    def kmers(self, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, number) of every k-mer of A, C, G and T."""
        row = np.repeat(np.arange(len(self.length)), self.length)
        place = np.arange(len(self.bytes)) - self.start[row]
        code = _CODE[self.bytes]
        n = max(0, len(code) - k + 1)
        number, good = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            number = number * 4 + code[j : n + j]
            good &= code[j : n + j] < 4
        good &= place[:n] + k <= self.length[row[:n]]
        at = np.flatnonzero(good)
        return row[at], place[at], number[at]


def _runs(length: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of many stretches laid end to end."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def longest_runs(match: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Longest run of matches in each row of a flat array in order of rows."""
    edge = np.flatnonzero(np.r_[np.ones(min(len(match), 1), bool), (match[1:] != match[:-1]) | (row[1:] != row[:-1])])
    length = np.diff(np.r_[edge, len(match)])
    out = np.zeros(rows, np.int64)
    np.maximum.at(out, row[edge], np.where(match[edge], length, 0) if len(edge) else length)
    return out


def vote_offsets(queries: list[str], databases: list[str]) -> np.ndarray:
    """Whether two offsets of a query in its database are each confirmed by CONFIRMED k-mers that are unique in the query.

    If not, an alignment with gaps is unlikely to be better than one without.
    """
    q, d = Flat(queries), Flat(databases)
    row, place, kmer = q.kmers()
    key = row * 4**KMER + kmer
    keys, first, count = np.unique(key, return_index=True, return_counts=True)
    keys, place = keys[count == 1], place[first[count == 1]]
    row, at, kmer = d.kmers()
    key = row * 4**KMER + kmer
    i = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
    hit = keys[i] == key if len(keys) else np.zeros(len(key), bool)
    span = int(q.length.max(initial=0) + d.length.max(initial=0)) + 1
    offset = row[hit] * (2 * span) + at[hit] - place[i[hit]] + span
    offsets, votes = np.unique(offset, return_counts=True)
    return np.bincount(offsets[votes >= CONFIRMED] // (2 * span), minlength=len(queries)) >= 2


def cigar_scores(reads: list[str], references: list[str], quals: list, cigars: list[str]) -> pd.DataFrame:
    """Scores of reads laid on references from their first base by CIGARs of M, I, D and S.

    ``cost`` adds PENALTIES; the log probability takes soft clips as matches; an 'n' of a read matches
    anything but counts in the edit distance. ``mismatch_offsets``: places in the read.
    """
    read, ref = Flat(reads), Flat(references)
    qual = np.concatenate([np.asarray(q, np.int64) for q in quals]) if len(quals) else np.zeros(0, np.int64)
    rows = len(reads)
    ops: list[tuple] = []
    for r, text in enumerate(cigars):
        at = place = 0
        for n, op in re.findall(r"(\d+)([MIDS])", text):
            ops.append((r, op, int(n), at, place))
            at += int(n) * (op != "D")
            place += int(n) * (op in "MD")
    row, kind, length, at, place = (np.array(c) for c in zip(*ops, strict=True)) if ops else (np.zeros(0, np.int64), np.zeros(0, "U1"), *[np.zeros(0, np.int64)] * 3)
    m = kind == "M"
    base_row = np.repeat(row[m], length[m])
    i = np.repeat(at[m], length[m]) + _runs(length[m])
    a = read.bytes[read.start[base_row] + i]
    j = np.repeat(place[m], length[m]) + _runs(length[m])
    b = ref.bytes[ref.start[base_row] + j]
    q = np.clip(qual[read.start[base_row] + i], 0, 255)
    match = (a == b) | (a == ord("n"))
    total = lambda values, where: np.bincount(where, values, rows)
    lp = total(np.where(match, LOG_MATCH[q], LOG_MISMATCH[q]), base_row)
    s = kind == "S"
    clip_row = np.repeat(row[s], length[s])
    lp += total(LOG_MATCH[np.clip(qual[read.start[clip_row] + np.repeat(at[s], length[s]) + _runs(length[s])], 0, 255)], clip_row)
    gap = (kind == "I") | (kind == "D")
    mismatch, opened, extended, most = PENALTIES
    wrong = total(~match, base_row).astype(int)
    cost = wrong * mismatch + total(opened + np.minimum(most, (length[gap] - 1) * extended), row[gap])
    # a run of matches ends with its operation
    op_row = np.repeat(np.flatnonzero(m), length[m])
    by_op = longest_runs(match, op_row, len(row))
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, by_op)
    bad = np.flatnonzero(~match)
    offsets = np.split(i[bad], np.searchsorted(base_row[bad], np.arange(1, rows))) if rows else []
    return pd.DataFrame({
        "matches": total(match, base_row).astype(int), "mismatches": wrong, "matches_in_row": longest, "gaps": total(np.ones(gap.sum()), row[gap]).astype(int),
        "edit_distance": (total(a != b, base_row) + total(length[gap], row[gap])).astype(int), "observed_length": total(length[m | (kind == "D")], row[m | (kind == "D")]).astype(int),
        "cost": cost.astype(int), "log_probability": lp, "mismatch_offsets": [x.tolist() for x in offsets],
    })


_SCORES = T.StructType([
    *(T.StructField(n, T.IntegerType()) for n in ("matches", "mismatches", "matches_in_row", "gaps", "edit_distance", "observed_length", "cost")),
    T.StructField("log_probability", T.DoubleType()), T.StructField("mismatch_offsets", T.ArrayType(T.IntegerType())),
])


def _filled(n: int, at: np.ndarray, done: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
    """Rows of ``done`` at their places among ``n``, nulls elsewhere."""
    out = pd.DataFrame({f.name: np.full(n, None, object) for f in schema.fields})
    if len(at):
        out.iloc[at] = done[out.columns].astype(object).to_numpy(object)
    ints = {f.name: "Int64" if isinstance(f.dataType, T.LongType) else "Int32" for f in schema.fields if isinstance(f.dataType, T.LongType | T.IntegerType)}
    return out.astype(ints | {f.name: "float64" for f in schema.fields if isinstance(f.dataType, T.DoubleType)})


def _complete(*columns: pd.Series) -> np.ndarray:
    return np.flatnonzero(np.logical_and.reduce([c.notna().to_numpy() for c in columns]))


@F.pandas_udf(_SCORES)
def score_cigar(read: pd.Series, reference: pd.Series, qual: pd.Series, cigar: pd.Series) -> pd.DataFrame:
    """``cigar_scores`` of each row: bases and qualities in the order of the reference, which starts at the placement.

    Null if anything is null, if the CIGAR doesn't cover the read or passes the end of the reference.
    """
    at = []
    for i in _complete(read, reference, qual, cigar):
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDS])", cigar.iloc[i])]
        covers = sum(n for n, op in ops if op != "D") == len(read.iloc[i]) == len(qual.iloc[i])
        if covers and sum(n for n, op in ops if op in "MD") <= len(reference.iloc[i]):
            at.append(i)
    at = np.array(at, np.int64)
    return _filled(len(read), at, cigar_scores(*(c.iloc[at].tolist() for c in (read, reference, qual, cigar))), _SCORES)


@F.pandas_udf(T.BooleanType())
def gaps_make_sense(query: pd.Series, database: pd.Series) -> pd.Series:
    """``vote_offsets`` of each row; null in, null out."""
    at = _complete(query, database)
    out = pd.Series(None, index=range(len(query)), dtype="boolean")
    out.iloc[at] = vote_offsets(query.iloc[at].tolist(), database.iloc[at].tolist())
    return out


def ungapped_cigar(length: Column, left: Column, right: Column) -> Column:
    """CIGAR of a read without gaps and with clipped ends: the longest clip of all reasons counts at either side."""
    left = F.least(length, left)
    right = F.least(length - left, right)
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    return F.concat(part(left, "S"), part(length - left - right, "M"), part(right, "S"))


def align_gapped(candidates: DataFrame, band: int = kernels.BAND) -> DataFrame:
    """Candidates with ``gapped``: the accepted alignment with gaps (cigar, shift, scores), else null.

    Needs seq and qual in the order of the reference, ``flanked`` (the reference from ``band / 2`` bases before
    the placement to ``band - 1 - band / 2`` bases after its end) and the ungapped ``mismatches``, ``observed_length`` and
    ``log_probability``. Tried with more than TRY_GAPS mismatches if the votes make sense of it; accepted if
    nearly all bases match, with at most MOST_GAPPED mismatches, fewer than before, and a higher log
    probability. ``shift``: bases by which the start moves.
    """
    tried = F.when((F.col("mismatches") > TRY_GAPS) & gaps_make_sense("seq", "flanked"), F.struct("seq", "flanked"))
    rows = candidates.withColumn("__t", tried).withColumn("__a", kernels.banded_sw(F.col("__t.seq"), F.col("__t.flanked")))
    laid = score_cigar(F.col("__t.seq"), F.expr("substring(__t.flanked, __a.offset + 1)"), F.col("qual"), F.col("__a.cigar"))
    rows = rows.withColumn("__s", laid)
    s = F.col("__s")
    good = (s["matches"] > 0) & (s["matches"] + band > F.col("observed_length")) & (s["mismatches"] <= MOST_GAPPED) & (s["mismatches"] < F.col("mismatches")) & (s["log_probability"] > F.col("log_probability") + sc.EPSILON)
    gapped = F.struct(F.col("__a.cigar").alias("cigar"), (F.col("__a.offset") - band // 2).alias("shift"), *(s[f.name].alias(f.name) for f in _SCORES.fields))
    return rows.withColumn("gapped", F.when(good, gapped)).drop("__t", "__a", "__s")


def indel_pairs(candidates: DataFrame, read: list[str], limit: int = 100) -> DataFrame:
    """Neighbouring candidates of a read on one strand of a contig less than ``limit`` bases apart.

    Needs contig, reverse, ``unclipped`` (position without clips) and ``seed_offset`` on the strand. ``first`` and ``second`` are
    where the head and the tail of the read lie: if the seeds follow each other like the placements, the
    gap is a deletion, else an insertion.
    """
    w = Window.partitionBy(*read, "contig", "reverse").orderBy("unclipped")
    rows = candidates.withColumns({"__next": F.lead("unclipped").over(w), "__seed": F.lead("seed_offset").over(w)})
    rows = rows.where((F.col("__next") > F.col("unclipped")) & (F.col("__next") - F.col("unclipped") < limit))
    ahead = F.col("__seed") > F.col("seed_offset")
    return rows.select(
        *read, "contig", "reverse", F.when(ahead, F.col("unclipped")).otherwise(F.col("__next")).alias("first"), F.when(ahead, F.col("__next")).otherwise(F.col("unclipped")).alias("second")
    )


def mate_places(mates: list[str], windows: list[str], quals: list | None = None) -> pd.DataFrame:
    """All places of mates in their windows that share a k-mer: row, offset, mismatches, log_probability, matches_in_row."""
    m, w = Flat(mates), Flat(windows)
    row, place, kmer = m.kmers()
    order = np.argsort(row * 4**KMER + kmer, kind="stable")
    keys, place = (row * 4**KMER + kmer)[order], place[order]
    row, at, kmer = w.kmers()
    low, high = (np.searchsorted(keys, row * 4**KMER + kmer, side) for side in ("left", "right"))
    n = high - low
    offset = np.repeat(at, n) - place[np.repeat(low, n) + _runs(n)]
    row = np.repeat(row, n)
    inside = (offset >= 0) & (offset + m.length[row] <= w.length[row])
    span = int(w.length.max(initial=0)) + 1
    place = np.unique(row[inside] * span + offset[inside])
    row, offset = place // span, place % span
    length = m.length[row]
    each = np.repeat(np.arange(len(row)), length)
    i = _runs(length)
    a, b = m.bytes[m.start[row[each]] + i], w.bytes[w.start[row[each]] + offset[each] + i]
    match = (a == b) | (a == ord("n"))
    out = {"row": row, "offset": offset, "mismatches": np.bincount(each, ~match, len(row)).astype(int), "matches_in_row": longest_runs(match, each, len(row))}
    if quals is not None:
        qual = np.concatenate([np.asarray(q, np.int64) for q in quals]) if len(quals) else np.zeros(0, np.int64)
        q = np.clip(qual[m.start[row[each]] + i], 0, 255)
        out["log_probability"] = np.bincount(each, np.where(match, LOG_MATCH[q], LOG_MISMATCH[q]), len(row))
    return pd.DataFrame(out)


_PLACE = T.StructType([
    *(T.StructField(n, T.IntegerType()) for n in ("offset", "mismatches", "matches_in_row")), T.StructField("log_probability", T.DoubleType()), T.StructField("total", T.DoubleType()),
])


@F.pandas_udf(_PLACE)
def best_mate_place(mate: pd.Series, qual: pd.Series, window: pd.Series) -> pd.DataFrame:
    """The place of highest log probability of each mate, the first of ties, and ``total``, the sum of the probabilities of all.

    Null where no k-mer of the mate is in its window or anything is null.
    """
    found, at = [], _complete(mate, qual, window)
    at = at[[len(mate.iloc[i]) == len(qual.iloc[i]) for i in at]] if len(at) else at
    for part in np.array_split(at, max(1, -(-len(at) // ROWS))):
        if len(part):
            places = mate_places(mate.iloc[part].tolist(), window.iloc[part].tolist(), qual.iloc[part].tolist())
            found.append(places.assign(row=part[places["row"].to_numpy()]))
    every = pd.concat(found) if found else mate_places([], [], [])
    every["total"] = np.exp(every["log_probability"]).groupby(every["row"]).transform("sum")
    best = every.sort_values(["row", "log_probability", "offset"], ascending=[True, False, True]).drop_duplicates("row")
    return _filled(len(mate), best["row"].to_numpy(), best, _PLACE)


_NEAR = T.StructType([T.StructField(n, T.IntegerType()) for n in ("offset", "mismatches")])


@F.pandas_udf(_NEAR)
def rescue_mate(mate: pd.Series, window: pd.Series) -> pd.DataFrame:
    """The place of fewest mismatches of each mate in its window, the first of ties; null where no k-mer is shared."""
    found, at = [], _complete(mate, window)
    for part in np.array_split(at, max(1, -(-len(at) // ROWS))):
        if len(part):
            places = mate_places(mate.iloc[part].tolist(), window.iloc[part].tolist())
            found.append(places.assign(row=part[places["row"].to_numpy()]))
    every = pd.concat(found) if found else mate_places([], [])
    best = every.sort_values(["row", "mismatches", "offset"]).drop_duplicates("row")
    return _filled(len(mate), best["row"].to_numpy(), best, _NEAR)


def rescue_mates(orphans: DataFrame, mates: DataFrame, contigs: DataFrame, models: DataFrame, group: str) -> DataFrame:
    """Orphans (placed ends) with the best place of their mate in the window of the model.

    ``orphans``: cluster, group, read (0 or 1), contig, pos, reverse, len, lp, cost; ``mates``: cluster, seq,
    qual as sequenced; ``contigs``: contig, seq; ``models``: one row for each group. An orphan whose log probability is
    ORPHAN_SLACK below that of the best of its cluster isn't tried. The reference is joined by blocks, so
    an orphan meets the bases of its window only. ``rescued`` is null where no place is found or the place is very bad.
    """
    c = F.col
    rows = orphans.join(orphans.groupBy("cluster").agg(F.max("lp").alias("__top")), "cluster").where(c("lp") + ORPHAN_SLACK >= c("__top")).drop("__top")
    rows = rows.join(mates.select("cluster", "seq", "qual"), "cluster").join(models.select(group, "best_model", "second_model", "min_length", "max_length"), group)
    b, s = c("best_model"), c("second_model")
    size = F.length("seq")
    by_read = lambda f: F.when(c("read") == 0, f(0)).otherwise(f(1))
    window = lambda i: by_read(lambda r: mate_window(b, s, r, c("reverse"), c("pos"), c("min_length"), c("max_length"), c("len"), size)[i])
    turned = by_read(lambda r: mate_reverse(b, s, r, c("reverse")))
    rows = rows.select(*orphans.columns, turned.alias("mate_reverse"), F.when(turned, sq.reverse_complement(c("seq"))).otherwise(c("seq")).alias("__seq"), F.when(turned, F.reverse("qual")).otherwise(c("qual")).alias("__qual"),
        F.greatest(window(0) - SLACK, F.lit(0)).cast("long").alias("__from"), (window(1) + size - 1 + SLACK).cast("long").alias("__upto"))
    key = ["cluster", "read", "contig", "pos", "reverse"]
    each = rows.where("__upto >= __from").select(*key, F.explode(F.sequence(F.floor(c("__from") / BLOCK), F.floor(c("__upto") / BLOCK))).alias("__b"))
    starts = F.sequence(F.lit(0), F.length("seq") - 1, F.lit(BLOCK))
    blocks = contigs.where(F.length("seq") > 0).select("contig", "seq", F.explode(starts).alias("__s")).select("contig", (c("__s") / BLOCK).cast("long").alias("__b"), F.expr(f"substring(seq, __s + 1, {BLOCK})").alias("__t"))
    text = each.join(blocks, ["contig", "__b"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__b", "__t"))).alias("__w"))
    rows = rows.join(text, key, "left").withColumn("__begin", F.get("__w", F.lit(0))["__b"] * BLOCK)
    rows = rows.withColumn("__first", F.greatest(c("__from") - c("__begin"), F.lit(0)))
    piece = F.substring(F.array_join(F.transform("__w", lambda x: x["__t"]), ""), c("__first").cast("int") + 1, (c("__upto") + 1 - c("__begin") - c("__first")).cast("int"))
    rows = rows.withColumn("__p", best_mate_place(c("__seq"), c("__qual"), piece))
    p, n = c("__p"), F.length("__seq")
    bad = sc.very_bad(p["matches_in_row"], p["mismatches"], n, p["log_probability"])
    place = F.struct((c("__begin") + c("__first") + p["offset"]).alias("pos"), c("mate_reverse").alias("reverse"), n.alias("len"), p["mismatches"].alias("mismatches"), (p["mismatches"] * PENALTIES[0]).alias("cost"), p["log_probability"].alias("lp"), p["total"].alias("total"))
    return rows.select(*orphans.columns, F.when(p["offset"].isNotNull() & ~bad, place).alias("rescued"))


def rescued_templates(rescued: DataFrame, rest: Column, group: str) -> DataFrame:
    """One template for each cluster: the orphan and rescued mate of lowest cost, then of highest log probability.

    The score sets its probability against those of all orphans with all places of their mates and ``rest``.
    A cluster whose mate isn't found keeps its best orphan, as kind 'single' without score. If several
    orphans tie, the first place counts. A score of an orphan that isn't well anchored (column ``anchored``, true where
    absent) is at most CLEAN_SCORE.
    """
    c = F.col
    anchored = F.coalesce(c("anchored"), F.lit(True)) if "anchored" in rescued.columns else F.lit(True)
    r = c("rescued")
    rank = F.struct(r.isNull().alias("a"), F.when(r.isNull(), c("cost")).otherwise(c("cost") + r["cost"]).alias("b"), (-F.round(c("lp") + F.coalesce(r["lp"], F.lit(0.0)), 7)).alias("c"), c("contig").alias("d"), c("pos").alias("e"), c("reverse").alias("f"))
    keep = F.struct(c(group).alias("g"), "read", "contig", "pos", "reverse", "len", c("lp"), "rescued", anchored.alias("anchored"))
    best = rescued.groupBy("cluster").agg(F.min_by(keep, rank).alias("o"), F.coalesce(F.sum(F.exp("lp") * r["total"]), F.lit(0.0)).alias("total"))
    o = c("o")
    lp = F.exp(o["lp"] + o["rescued"]["lp"])
    score = sc.phred(F.greatest(c("total") - lp, F.lit(0.0)) + rest, lp)
    return best.select(
        "cluster", o["g"].alias(group), F.when(o["rescued"].isNull(), "single").otherwise("rescued").alias("kind"), o["read"].alias("read"), *(o[x].alias(x) for x in ("contig", "pos", "reverse")),
        o["rescued"]["pos"].alias("mate_pos"), o["rescued"]["reverse"].alias("mate_reverse"), o["rescued"]["mismatches"].alias("mate_mismatches"),
        (F.greatest(o["pos"] + o["len"], o["rescued"]["pos"] + o["rescued"]["len"]) - F.least(o["pos"], o["rescued"]["pos"])).cast("long").alias("template_length"),
        F.when(o["anchored"], score).otherwise(F.least(score, F.lit(CLEAN_SCORE))).alias("score"),
    )


def disjoint_totals(orphans: DataFrame, cluster: list[str], end: str, log_probability: str) -> DataFrame:
    """Sum of the probabilities of all pairs of an orphan of either end: the product of the sums of the ends.

    Each orphan counts once (``contig``, ``pos``, ``reverse``); no pair is made. 0 where an end has none.
    """
    once = orphans.dropDuplicates([*cluster, end, "contig", "pos", "reverse"])
    of = lambda i: F.coalesce(F.sum(F.when(F.col(end) == i, F.exp(log_probability))), F.lit(0.0))
    return once.groupBy(*cluster).agg((of(1) * of(2)).alias("total"))


def build_candidates(matches: DataFrame, read: list[str], cap: int, weak: int = sc.WEAK_SEED) -> DataFrame:
    """Candidate placements from seed matches, one for each place of a read: position, strand, evidence.

    ``matches``: read, seed, offset, seed_length, read_length, contig, pos (of the seed), reverse, neighbours. A seed with
    ``cap`` hits or more is left out. A seed without neighbours is unique evidence if it is longer than
    ``weak`` bases, else its offset is weak evidence.
    """
    n = matches.groupBy(*read, "seed").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < cap).drop("__n")
    rows = matches.join(n, [*read, "seed"], "left_semi")
    c = F.col
    place = F.when(c("reverse"), c("pos") + c("seed_length") + c("offset") - c("read_length")).otherwise(c("pos") - c("offset"))
    alone = ~F.coalesce(c("neighbours"), F.lit(False))
    strong = alone & (c("seed_length") > weak)
    seed = F.when(alone & ~strong, c("offset"))
    rows = rows.select(*read, "contig", "reverse", place.alias("position"), strong.cast("int").alias("__u"), seed.alias("__w"))
    return rows.groupBy(*read, "contig", "reverse", "position").agg(F.sum("__u").alias("unique_seeds"), F.min("__w").alias("weak_first"), F.max("__w").alias("weak_last"))
