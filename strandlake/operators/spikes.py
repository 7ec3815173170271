"""Implausible readings, each judged by what is normal for its own source.

Impossible values are found by rule. The others form the sequence of their source, in which a count
that stays the same too long (no variance at all) is frozen. The rest is compared with the median of
its neighbourhood; the distribution of these residuals is kept as one quantile sketch for each source
and context (a band of positions), merged over partitions. A reading is a jump if it lies outside the
expanded interquartile fences against the levels both before and after it, as does its step from
them, and no more than two neighbours share the excursion. A lasting change of level differs from one
side only.

Sources of any length: the sequence runs over blocks of rows with a halo (``blocked``), in one sorted
exchange; the kernels work on whole arrays of many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.blocked import BLOCK, COARSE, OWN, blocked, lookup, stretches, together, whole_blocks
from strandlake.tables import written

#: Readings on each side that show a level; how far to look for them past frozen ones.
SIDE, REACH = 7, 24
#: Equal readings in a row that count as frozen; longest excursion that is still a jump.
FROZEN, EXCURSION = 6, 3
#: Fences reach this many interquartile ranges beyond the quartiles; smallest range assumed.
#: A normal residual passes 5 ranges (7.4 deviations) once in 8e12 readings, so the readings of 100 TB
#: (about 1e12) hold less than one by chance; 4.5 ranges (6.7 deviations) would let about 15 pass.
FENCE, LEAST_RANGE = 5.0, 0.02
#: Positions of one context; readings from which a context has fences of its own.
BAND, ENOUGH = 64, 30
#: Rows of a block, and those that a row's result may depend on at either side.
SIZE, HALO = 4096, 2 * REACH + 2 * FROZEN


class Series:
    """The readings of many blocks one after the other; ``y`` is NaN where a reading is frozen."""

    def __init__(self, values: np.ndarray, starts: np.ndarray) -> None:
        n = len(values)
        sizes = np.diff(np.r_[starts, n])
        self.first, self.past = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        self.at = np.arange(n)
        new = np.r_[np.ones(min(n, 1), bool), values[1:] != values[:-1]]
        new[starts] = True
        runs = np.flatnonzero(new)
        length = np.diff(np.r_[runs, n])
        self.frozen = np.repeat(length, length) >= FROZEN
        self.y = np.where(self.frozen, np.nan, values.astype(np.float64))

    def near(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last SIDE values that aren't NaN before each reading and the first after it; infinite where there are fewer."""
        valid = ~np.isnan(values)
        place = np.flatnonzero(valid)
        upto = np.cumsum(valid)
        out = []
        for number, inside in ((upto - valid, lambda p: (p >= self.at[:, None] - REACH) & (p >= self.first[:, None])), (upto, lambda p: (p <= self.at[:, None] + REACH) & (p < self.past[:, None]))):
            k = number[:, None] + (np.arange(-SIDE, 0) if not out else np.arange(SIDE))
            ok = (k >= 0) & (k < len(place))
            p = place[np.where(ok, k, 0)] if len(place) else np.zeros(k.shape, np.int64)
            ok &= inside(p)
            out.append(np.where(ok, values[p] if len(values) else 0.0, np.inf))
        return out[0], out[1]

    def residuals(self) -> np.ndarray:
        """Log ratio of each reading to the median of its neighbourhood; NaN where frozen."""
        before, after = self.near(self.y)
        own = np.where(np.isnan(self.y), np.inf, self.y)
        return ratio(self.y, median(np.concatenate((before, own[:, None], after), 1)))

    def jumps(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which readings leave the fences (of each reading) for no longer than EXCURSION against both sides."""
        out_of = lambda e: np.where(e > hi, 1, np.where(e < lo, -1, 0))
        e = self.residuals()
        side = np.where(np.isnan(e), 9, out_of(e))
        before, after = (median(x) for x in self.near(np.where(side == 0, self.y, np.nan)))
        length = np.ones(len(side), np.int64)
        for sign in (-1, 1):
            equal = np.ones(len(side), bool)
            for k in range(1, EXCURSION + 1):
                p = self.at + sign * k
                ok = (p >= self.first) & (p < self.past)
                equal &= ok & (side[np.where(ok, p, 0)] == side)
                length += equal
        beyond = lambda level: np.isnan(level) | (out_of(ratio(self.y, level)) == side)
        known = ~np.isnan(before) | ~np.isnan(after)
        return (np.abs(side) == 1) & known & beyond(before) & beyond(after) & (length <= EXCURSION)


def median(values: np.ndarray) -> np.ndarray:
    """Median of the finite values of each row; NaN where there is none."""
    s, n = np.sort(values, 1), np.isfinite(values).sum(1)
    row = np.arange(len(s))
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (s[row, np.maximum(n - 1, 0) // 2] + s[row, n // 2 * (n > 0)]) / 2, np.nan)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.log((a + 1) / (b + 1))


def flag_series(readings: DataFrame, source: list[str], position: str, value: str) -> DataFrame:
    """``readings`` (one per source and position, both values not null) with ``frozen`` and ``jump``.

    Positions are whole numbers; values are not negative.
    """
    places = stretches(readings, source, position, HALO, SIZE, BAND)
    rows = together(blocked(readings, source, position, places, BAND), source, position)
    keys, columns = [*source, BLOCK], readings.columns

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_blocks(batches, keys):
            e = Series(table["__v"].to_numpy(), starts).residuals()
            own = np.flatnonzero(table[OWN].to_numpy() & ~np.isnan(e))
            coarse = table[COARSE].to_numpy()[own]
            block = np.searchsorted(starts, own, side="right")
            new = np.flatnonzero(np.r_[np.ones(min(len(own), 1), bool), (coarse[1:] != coarse[:-1]) | (block[1:] != block[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(own)], pa.int32()), pa.array(e[own]))
            heads = table.select([*source, COARSE]).take(pa.array(own[new])).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(heads[c].combine_chunks() if heads.num_rows else pa.array([], heads.schema.field(c).type) for c in heads.column_names), lists], names=[*source, COARSE, "e"])

    slim = rows.select(*keys, COARSE, OWN, F.col(value).cast("double").alias("__v"))
    kinds = {c: readings.schema[c].dataType for c in source}
    found = slim.mapInArrow(residuals, T.StructType([*(T.StructField(c, t) for c, t in kinds.items()), T.StructField(COARSE, T.LongType()), T.StructField("e", T.ArrayType(T.DoubleType()))]))
    fences = context_fences(found.withColumn("e", F.explode("e")), source, COARSE, "e")
    each = lookup(fences, places, [*source, COARSE], "inner").withColumn(BLOCK, F.explode("__to.b"))
    each = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(COARSE, F.struct("lo", "hi")))).alias("__f"))
    fenced = lookup(rows, each, keys).withColumn("__f", F.try_element_at("__f", F.col(COARSE)))
    fenced = fenced.withColumns({"__lo": F.col("__f.lo"), "__hi": F.col("__f.hi"), "__v": F.col(value).cast("double")}).drop("__f", COARSE)
    out = T.StructType([*readings.schema.fields, T.StructField("frozen", T.BooleanType()), T.StructField("jump", T.BooleanType())])

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_blocks(batches, keys):
            series = Series(table["__v"].to_numpy(), starts)
            lo, hi = (table[c].to_numpy() for c in ("__lo", "__hi"))
            jump = series.jumps(np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi))
            done = table.select(columns).append_column("frozen", pa.array(series.frozen)).append_column("jump", pa.array(jump))
            yield from done.filter(table[OWN]).combine_chunks().to_batches()

    return together(fenced, source, position).mapInArrow(flags, out)


def context_fences(rows: DataFrame, source: list[str], context: str, residual: str) -> DataFrame:
    """Fences (lo, hi) for each source and context from merged quantile sketches.

    A context with few readings takes the quartiles of its source, and none has a narrower range than
    its source: a context of a few dozen readings shows its scatter only roughly.
    """
    sketch = rows.where(F.col(residual).isNotNull()).groupBy(*source, context).agg(F.kll_sketch_agg_double(residual).alias("s"))
    whole = sketch.groupBy(*source).agg(F.kll_merge_agg_double("s").alias("t"))
    joined = lookup(sketch, whole, source, "inner")
    s = F.when(F.kll_sketch_get_n_double("s") >= ENOUGH, F.col("s")).otherwise(F.col("t"))
    at = lambda sketch, q: F.kll_sketch_get_quantile_double(sketch, F.lit(q))
    out = joined.select(*source, context, at(s, 0.25).alias("q1"), at(s, 0.75).alias("q3"), (at("t", 0.75) - at("t", 0.25)).alias("whole"))
    spread = F.greatest(F.col("q3") - F.col("q1"), "whole", F.lit(LEAST_RANGE)) * FENCE
    return out.select(*source, context, (F.col("q1") - spread).alias("lo"), (F.col("q3") + spread).alias("hi"))


SOURCE = ["flowcell", "lane", "tile_no", "read_no"]


def cycle_readings(stats: DataFrame, tiles: DataFrame, reads: DataFrame) -> DataFrame:
    """Every reading of the per-cycle counts once, with the reason for which it is implausible or null.

    ``reason`` is 'impossible', 'frozen' or 'jump', the first that holds. Re-delivered rows count
    once; of rows that differ under one key the first to arrive counts. A null count, key or cycle is
    no case, nor is a reading whose read has no known cycles.
    """
    key = [*SOURCE, "cycle_no"]
    first = stats.where(F.col("mismatches").isNotNull() & F.col("cycle_no").isNotNull())
    # fragments are the same in all cycles of a source, but null in some rows
    totals = first.groupBy(*SOURCE).agg(F.max("fragments").alias("fragments"))
    once = first.groupBy(*key).agg(F.min_by(F.struct("mismatches", "blanks"), F.struct(F.col("loaded_at").isNull(), "loaded_at", "mismatches")).alias("r"))
    once = lookup(once.select(*key, "r.mismatches", "r.blanks"), totals, SOURCE)
    known = tiles.select("flowcell", "lane", "tile_no").distinct().withColumn("__tile", F.lit(True))
    cycles = reads.groupBy("flowcell", "read_no").agg(F.min("first_cycle").alias("__from"), F.max(F.col("first_cycle") + F.col("read_length") - 1).alias("__to"))
    once = once.join(known, ["flowcell", "lane", "tile_no"], "left").join(cycles, ["flowcell", "read_no"], "left")
    named = F.col("flowcell").isNotNull() & F.col("lane").isNotNull() & F.col("tile_no").isNotNull()
    impossible = (
        (F.col("mismatches") < 0)
        | F.coalesce(F.col("mismatches") + F.coalesce("blanks", F.lit(0)) > F.col("fragments"), F.lit(False))
        | (F.col("__tile").isNull() & named)
        | F.coalesce(~F.col("cycle_no").between(F.col("__from"), F.col("__to")), F.lit(False))
    )
    once = written(once.select(*key, "mismatches", "blanks", "fragments", impossible.alias("impossible")))
    flagged = flag_series(once.where(~F.col("impossible")), SOURCE, "cycle_no", "mismatches")
    bad = once.where("impossible").withColumn("frozen", F.lit(False)).withColumn("jump", F.lit(False))
    reason = F.when(F.col("impossible"), "impossible").when(F.col("frozen"), "frozen").when(F.col("jump"), "jump")
    return flagged.unionByName(bad).withColumn("reason", reason).drop("impossible", "frozen", "jump")
