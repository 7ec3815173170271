"""Sources of any length in blocks of rows with a halo of their neighbours.

A source may hold a third of all rows, so it must not be one window partition. Its rows are counted in
coarse stretches of positions, and consecutive stretches make blocks of about a fixed number of rows;
stretches within ``halo`` rows of a border go to the block next to it as well. A function of a row
that looks at most ``halo`` rows away gives the same result as over the whole source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, OWN, RANK, COARSE = "__block", "__own", "__rank", "__coarse"
#: Rows of a batch of whole blocks in a task.
CHUNK = 1 << 16


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of lists of columns."""
    return reduce(Column.__and__, (a.eqNullSafe(b) for a, b in zip(left, right, strict=True)))


def lookup(rows: DataFrame, side: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on columns in which nulls are equal; the side's columns follow."""
    renamed = side.select(*(F.col(c).alias(f"__j_{c}") for c in on), *(c for c in side.columns if c not in on))
    return rows.join(renamed, same([F.col(c) for c in on], [F.col(f"__j_{c}") for c in on]), how).drop(*(f"__j_{c}" for c in on))


def ranked(rows: DataFrame, source: list[str], position: str, span: int = 4096) -> DataFrame:
    """Rows with RANK, dense from 0 by ``position`` (unique in its source; not null)."""
    coarse = rows.withColumn(COARSE, F.floor(F.col(position) / span))
    by = [*source, COARSE]
    before = Window.partitionBy(*source).orderBy(COARSE).rowsBetween(Window.unboundedPreceding, -1)
    counts = coarse.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = lookup(coarse, counts.drop("__n"), by, "inner")
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(position)) - 1
    return joined.withColumn(RANK, F.col("__before") + inside).drop(COARSE, "__before")


def stretches(rows: DataFrame, source: list[str], position: str, halo: int, size: int, span: int) -> DataFrame:
    """(source, COARSE, ``__to``): the blocks that each stretch of ``span`` positions goes to, as (b, own).

    Positions are whole numbers, unique in their source. Every block but the last of a source has more
    than ``size - span`` rows, which must reach ``halo``. A source has at most 2**32 / span stretches.
    """
    if size - span < halo:
        raise ValueError("the blocks are smaller than their halo")
    counts = rows.groupBy(*source, F.floor(F.col(position) / span).alias(COARSE)).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*source)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w.orderBy(COARSE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("__b", F.floor(F.col("__before") / size)).withColumn("__last", F.max("__b").over(w))
    inside = Window.partitionBy(*source, "__b")
    counts = counts.withColumn("__from", F.min("__before").over(inside)).withColumn("__upto", F.max(F.col("__before") + F.col("__n")).over(inside))
    to = lambda b, own: F.struct(b.alias("b"), F.lit(own).alias("own"))
    before = F.when((F.col("__b") > 0) & (F.col("__before") < F.col("__from") + halo), to(F.col("__b") - 1, False))
    after = F.when((F.col("__b") < F.col("__last")) & (F.col("__before") + F.col("__n") > F.col("__upto") - halo), to(F.col("__b") + 1, False))
    return counts.select(*source, COARSE, F.array_compact(F.array(to(F.col("__b"), True), before, after)).alias("__to"))


def blocked(rows: DataFrame, source: list[str], position: str, places: DataFrame, span: int) -> DataFrame:
    """Rows with COARSE, BLOCK and OWN by the result of ``stretches``; copies in another block have OWN false."""
    each = lookup(rows.withColumn(COARSE, F.floor(F.col(position) / span)), places, [*source, COARSE], "inner")
    return each.withColumn("__to", F.explode("__to")).withColumn(BLOCK, F.col("__to.b")).withColumn(OWN, F.col("__to.own")).drop("__to")


def together(rows: DataFrame, source: list[str], position: str) -> DataFrame:
    """Blocked rows with each block in one task, in order of position."""
    return rows.withColumn("__h", F.xxhash64(*source)).repartition("__h", BLOCK).sortWithinPartitions("__h", *source, BLOCK, position).drop("__h")


def whole_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks of at least CHUNK rows, but for the last, with the start of each block."""
    held: list[pa.RecordBatch] = []
    size = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
            codes = codes.indices.to_numpy(zero_copy_only=False) if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks().indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        at = starts(table)
        if at[-1]:
            yield table.slice(0, int(at[-1])), at[:-1]
            table = table.slice(int(at[-1]))
        held, size = table.to_batches(), table.num_rows
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)
