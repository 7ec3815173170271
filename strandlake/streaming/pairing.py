"""Structured Streaming: pairing of ends in an unordered stream, and a statistic that settles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlake.operators import template

PAIRED = "name string, first string, second string, paired boolean"


def pair_ends(ends: DataFrame, name: str, end: str, value: str, wait: str = "10 minutes", event_time: str | None = None) -> DataFrame:
    """(name, first, second, paired) of a stream of ends (1 or 2) in any order.

    The state holds one end for each open name, nothing for closed ones. An end whose mate doesn't come
    within ``wait`` comes out alone: by the watermark of ``event_time`` where that is given, else by the
    clock. A repeated end doesn't count. A null name is no group and is dropped.
    """
    rows = ends.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(end).cast("int").alias("end"), F.col(value).cast("string").alias("value"), *([F.col(event_time).alias("__at")] if event_time else []))
    delay = int(pd.Timedelta(wait).total_seconds() * 1000)
    kind = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.ProcessingTimeTimeout
    if event_time:
        rows = rows.withWatermark("__at", wait)

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip((1, 2), state.get, strict=True)) if state.exists else {1: None, 2: None}
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], held[1], held[2], False)], columns=["name", "first", "second", "paired"])
            return
        latest = 0
        for frame in frames:
            for row in frame.itertuples():
                if held.get(row.end, "") is None:
                    held[row.end] = row.value
            if event_time and len(frame):
                latest = max(latest, int(frame["__at"].max().timestamp() * 1000))
        if held[1] is not None and held[2] is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], held[1], held[2], True)], columns=["name", "first", "second", "paired"])
            return
        state.update((held[1], held[2]))
        if event_time:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + delay)
        else:
            state.setTimeoutDuration(delay)

    return rows.groupBy("name").applyInPandasWithState(pair, PAIRED, "first string, second string", "append", kind)


class SettlingModel:
    """A model of template lengths over a growing set of pairs, frozen once an update leaves it as it was.

    For ``writeStream.foreachBatch``: each batch adds its counts of lengths (bounded by the longest
    template) to a table of counts, from which the model is made again, until it is stable.
    """

    def __init__(self, by: list[str], length: str, model: str, report: Callable[[pd.DataFrame], None] | None = None) -> None:
        self.by, self.length, self.model, self.report = by, length, model, report
        self.counts: pd.DataFrame | None = None
        self.value: pd.DataFrame | None = None
        self.stable = False

    def __call__(self, batch: DataFrame, _: int) -> None:
        if self.stable:
            return
        keys = [*self.by, self.model, self.length]
        usable = batch.where((F.col(self.length) >= 0) & (F.col(self.length) <= template.LONGEST))
        # one row for each group, model and length: at most 8 * LONGEST for each group
        new = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).toPandas()
        if new.empty:
            return
        whole = new if self.counts is None else pd.concat([self.counts, new])
        self.counts = whole.groupby(keys, dropna=False, as_index=False)["n"].sum()
        spark = batch.sparkSession
        rows = spark.createDataFrame(self.counts).select(*keys, F.explode(F.expr("sequence(1, int(n))")).alias("__i"))
        value = template.template_length_stats(rows, self.by, self.length, self.model).drop("templates").orderBy(*self.by).toPandas()
        self.stable = self.value is not None and value.equals(self.value)
        self.value = value
        if self.report:
            self.report(value.assign(stable=self.stable))
