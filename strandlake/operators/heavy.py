"""Most frequent values in bounded memory: a heavy-light split with vote-evicting buckets.

Every partition keeps a fixed number of exact buckets and a fixed array of counters. A value that
hashes to a bucket held by another votes against the holder; when the votes against reach
``EVICT`` times those for it, the holder's count falls into the counters and the newcomer takes the
bucket. Partitions are merged bucket by bucket: counts of a value add up, the strongest ``KEEP``
values of a bucket stay, the others fall into the summed counters. The size of every state is a
constant, whatever the number of rows or of distinct values. A value that no bucket kept is wholly in
its counters, so it is passed over only if one of these stays below the k-th count; all others are
counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets and counters of one partition's state (both powers of two), rows of counters.
BUCKETS, COUNTERS, ROWS = 2048, 16384, 2
#: Votes against a holder, per vote for it, that evict it; values kept in a merged bucket.
EVICT, KEEP = 8, 4

SCHEMA = "kind int, slot int, value string, n long"


class HeavyLight:
    """State of one partition. Batches arrive already counted by value."""

    def __init__(self, buckets: int = BUCKETS, counters: int = COUNTERS) -> None:
        self.buckets, self.counters = buckets, counters
        self.held = np.zeros(buckets, np.int64)
        self.votes = np.zeros(buckets, np.int64)
        self.against = np.zeros(buckets, np.int64)
        self.names = np.full(buckets, None, object)
        self.light = np.zeros((ROWS, counters), np.int64)

    def _spill(self, hashes: np.ndarray, n: np.ndarray) -> None:
        for r in range(ROWS):
            np.add.at(self.light[r], light_slot(hashes, r, self.counters), n)

    def add(self, hashes: np.ndarray, names: np.ndarray, n: np.ndarray) -> None:
        """One batch of distinct values with their counts."""
        at = hashes & (self.buckets - 1)
        ours = (self.votes[at] > 0) & (self.held[at] == hashes)
        self.votes[at[ours]] += n[ours]
        rest = np.flatnonzero(~ours)
        rest = rest[np.lexsort((hashes[rest], -n[rest], at[rest]))]
        lead = rest[np.flatnonzero(np.r_[True, at[rest][1:] != at[rest][:-1]])] if len(rest) else rest
        np.add.at(self.against, at[rest], n[rest])
        b = at[lead]
        empty = self.votes[b] == 0
        evict = ~empty & (self.against[b] >= EVICT * self.votes[b])
        self._spill(self.held[b[evict]], self.votes[b[evict]])
        moved = lead[empty | evict]
        b = at[moved]
        self.against[b] -= np.where(self.votes[b] == 0, n[moved], self.against[b])
        self.held[b], self.votes[b], self.names[b] = hashes[moved], n[moved], names[moved]
        stay = np.setdiff1d(rest, moved, assume_unique=True)
        self._spill(hashes[stay], n[stay])

    def rows(self) -> pa.RecordBatch:
        """Kind 1: value held by a bucket; kind 0: a counter."""
        full = np.flatnonzero(self.votes)
        flat = self.light.ravel()
        used = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[np.ones(len(full), np.int32), np.zeros(len(used), np.int32)]),
                pa.array(np.r_[full, used].astype(np.int32)),
                pa.array([*self.names[full], *[None] * len(used)], pa.string()),
                pa.array(np.r_[self.votes[full], flat[used]]),
            ],
            names=["kind", "slot", "value", "n"],
        )


def light_slot(hashes, row: int, counters: int):
    """Counter of a hash in a row; the bits differ from those that choose the bucket."""
    return (hashes >> (16 + 20 * row)) & (counters - 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = HeavyLight()
    for batch in batches:
        counted = pa.table(batch).group_by(["value"]).aggregate([("h", "min"), ("value", "count")])
        state.add(counted["h_min"].to_numpy(), counted["value"].to_numpy(zero_copy_only=False), counted["value_count"].to_numpy())
    yield state.rows()


def sketch(values: DataFrame, value: str) -> DataFrame:
    """Merged state over all partitions: rows (kind, slot, value, n, h); nulls don't count.

    Kind 1: a value kept by a bucket, at most BUCKETS * KEEP; kind 0: a counter, at most ROWS * COUNTERS,
    with the values that the merge dropped.
    """
    parts = values.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.xxhash64(value).alias("h")).mapInArrow(_sketch, SCHEMA)
    merged = parts.groupBy("kind", "slot", "value").agg(F.sum("n").alias("n"))
    h = F.xxhash64("value")
    rank = F.row_number().over(Window.partitionBy("kind", "slot").orderBy(F.desc("n"), "value"))
    row = lambda kind, slot, value: F.struct(F.lit(kind).alias("kind"), slot.alias("slot"), value.alias("value"))
    none = F.lit(None).cast("string")
    lost = F.array(*(row(0, light_slot_column(h, r) + r * COUNTERS, none) for r in range(ROWS)))
    to = F.when((F.col("kind") == 1) & (F.col("rank") > KEEP), lost).otherwise(F.array(row(F.col("kind"), F.col("slot"), F.col("value"))))
    rows = merged.withColumn("rank", rank).select(F.explode(to).alias("to"), "n").groupBy("to").agg(F.sum("n").alias("n"))
    return rows.select("to.kind", "to.slot", "to.value", "n", F.xxhash64("to.value").alias("h"))


def candidates(values: DataFrame, value: str, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """What may be among the ``k`` most frequent: kept values (value, low, high), and counters (s, l) of each row.

    ``low`` is what buckets counted exactly for a value; ``high`` adds its counters, which also hold
    other values. A kept value whose ``high`` stays below the k-th ``low`` can't be among the ``k``, nor a
    value that wasn't kept if one of its counters stays below it; only the counters from there on are
    given. The state, a constant, is put together in the driver.
    """
    state = sketch(values, value).toArrow()
    kind, slot, n, h = (state[c].to_numpy() for c in ("kind", "slot", "n", "h"))
    light = np.zeros(ROWS * COUNTERS, np.int64)
    light[slot[kind == 0]] = n[kind == 0]
    light = light.reshape(ROWS, COUNTERS)
    low, h = n[kind == 1], h[kind == 1]
    high = low + np.minimum.reduce([light[r][light_slot(h, r, COUNTERS)] for r in range(ROWS)])
    kth = int(np.sort(low)[-k]) if len(low) >= k else 1
    few = pa.table({"value": state["value"].filter(pa.array(kind == 1)).cast(pa.string()), "low": low, "high": high}).filter(pa.array(high >= kth))
    spark = values.sparkSession
    hot = [np.flatnonzero(x >= kth) for x in light]
    return (
        spark.createDataFrame(few, "value string, low long, high long"),
        [spark.createDataFrame(pa.table({f"s{r}": s.astype(np.int32), f"l{r}": light[r][s]}), f"s{r} int, l{r} long") for r, s in enumerate(hot)],
    )


def light_slot_column(h: Column, row: int) -> Column:
    return F.shiftright(h, 16 + 20 * row).bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def top_values(values: DataFrame, value: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values: (value, low, high, n).

    The sketch bounds all counts; an exact count of the values whose bound reaches the k-th count settles
    the order. These are the kept values (at most BUCKETS * KEEP) and those with all counters at the
    k-th count or above: few where the k-th value stands out of a counter's load, and where it doesn't,
    up to all values, which the shuffle then counts. Ties go to the smaller value. An empty column gives
    no rows.
    """
    few, hot = candidates(values, value, k)
    rows = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull())
    h = F.xxhash64("value")
    rows = rows.select("value", *(light_slot_column(h, r).alias(f"s{r}") for r in range(ROWS)))
    for r in range(ROWS):
        rows = rows.join(F.broadcast(hot[r]), f"s{r}", "left")
    rows = rows.join(F.broadcast(few), "value", "left")
    reach = F.lit(True)
    for r in range(ROWS):
        reach = reach & F.col(f"l{r}").isNotNull()
    high = F.coalesce("high", F.least(*(F.col(f"l{r}") for r in range(ROWS))))
    rows = rows.where(F.col("low").isNotNull() | reach).select("value", F.coalesce("low", F.lit(0)).alias("low"), high.alias("high"))
    return rows.groupBy("value", "low", "high").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def clean_barcode(barcode: Column) -> Column:
    """Upper case, without blanks around, halves joined by '-'; null where nothing is left."""
    b = F.upper(F.regexp_replace(barcode, r"^\s+|\s+$", ""))
    return F.when(b != "", F.replace(b, F.lit("+"), F.lit("-")))
