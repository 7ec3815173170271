"""Quality statistics at every level of a run: per cycle, per tile and barcode, rolled up, as ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import score as sc

#: Tiles from which a deviation across tiles is given; quality of the 'good' bases.
ENOUGH_TILES, GOOD_QUALITY = 3, 30
#: The levels of the report: which of the four names are kept; the others read 'all'.
LEVELS = (("flowcell", "project", "sample", "barcode"), ("flowcell", "project", "sample"), ("flowcell", "project"), ("flowcell",), ("project", "sample"), ("project",), ())


def base_stats(reads: DataFrame, by: list[str], qual: str = "qual") -> DataFrame:
    """Reads, yield, yield of good bases and quality sum, of all and of passing (pf) reads, in one pass."""
    q = F.col(qual)
    bases = F.coalesce(F.size(q), F.lit(0)).cast("long")
    good = F.size(F.filter(q, lambda x: x >= GOOD_QUALITY)).cast("long")
    total = F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = reads.select(*by, "pf", bases.alias("__n"), good.alias("__g"), total.alias("__t"))
    pf = F.coalesce(F.col("pf"), F.lit(False))
    cols = []
    for name, keep in (("raw", F.lit(True)), ("pf", pf)):
        cols += [F.count_if(keep).alias(f"{name}_reads"), *(F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0)).cast("long").alias(f"{name}_{n}") for c, n in (("__n", "yield"), ("__g", "yield_q30"), ("__t", "quality_sum")))]
    return rows.groupBy(*by).agg(*cols)


def rollup_levels(stats: DataFrame, sums: list[str], within: list[str]) -> DataFrame:
    """Sums at the seven levels of the report, names above a level as 'all'.

    The rows are summed at the finest level first, so the grouping sets expand groups, not rows. A null
    name stays null and is told from 'all' by the grouping, not by its value.
    """
    names = LEVELS[0]
    fine = stats.groupBy(*within, *names).agg(*(F.sum(c).alias(c) for c in sums))
    sets = [[F.col(c) for c in (*within, *level)] for level in LEVELS]
    cube = fine.groupingSets(sets, *(F.col(c) for c in (*within, *names))).agg(*(F.sum(c).alias(c) for c in sums), *(F.grouping(c).alias(f"__g_{c}") for c in names))
    return cube.select(*within, *(F.when(F.col(f"__g_{c}") == 1, "all").otherwise(F.col(c)).alias(c) for c in names), *sums)


def mismatch_curves(fragments: DataFrame, by: list[str], cycles: str, most: int = 4) -> DataFrame:
    """For each cycle, fragments with at most k mismatches up to it, k = 0 to ``most``.

    ``cycles``: the sorted cycles of a fragment's mismatches. A fragment leaves curve k at its
    (k+1)-th mismatch, so one row for each of these few is enough.
    """
    total = fragments.groupBy(*by).agg(F.count(F.lit(1)).alias("fragments"))
    leaves = fragments.select(*by, F.posexplode(F.slice(cycles, 1, most + 1)).alias("k", "cycle"))
    counts = leaves.groupBy(*by, "cycle").agg(*(F.count_if(F.col("k") == k).alias(f"c{k}") for k in range(most + 1)))
    w = Window.partitionBy(*by).orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(total, by)
    return rows.select(*by, "cycle", *((F.col("fragments") - F.sum(f"c{k}").over(w)).alias(f"at_most_{k}") for k in range(most + 1)))


def fragment_sums(fragments: DataFrame, by: list[str]) -> DataFrame:
    """Fragments, aligned, unique and perfect ones, their scores and mismatches, in one pass.

    Needs ``aligned``, ``score`` (null: unknown), ``mismatches`` and ``edits``. Unique: aligned with a score above UNIQUE_SCORE.
    """
    c = F.col
    aligned = F.coalesce(c("aligned"), F.lit(False))
    unique = aligned & sc.uniquely_aligned(c("score"))
    total = lambda keep, x: F.coalesce(F.sum(F.when(keep, c(x))), F.lit(0)).cast("long")
    return fragments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fragments"), F.count_if(aligned).alias("aligned_fragments"), F.count_if(unique).alias("unique_fragments"), F.count_if(unique & (c("edits") == 0)).alias("perfect_fragments"),
        total(aligned, "score").alias("score_sum"), total(aligned, "mismatches").alias("mismatch_sum"), total(unique, "mismatches").alias("unique_mismatch_sum"),
    )


def score_histogram(fragments: DataFrame, by: list[str], score: str, mismatches: str) -> DataFrame:
    """(by, score, fragments, mismatches) for every score that occurs; unknown ones don't count."""
    return fragments.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("fragments"), F.sum(mismatches).cast("long").alias("mismatch_sum"))


def cycle_blanks(reads: DataFrame, by: list[str], seq: str, first_cycle: str, unique: Column) -> DataFrame:
    """(by, cycle, blanks, unique_blanks): reads without a base at each cycle; only the blanks of a read are exploded."""
    places = F.filter(F.sequence(F.lit(1), F.length(seq)), lambda i: F.upper(F.substring(F.col(seq), i, F.lit(1))) == "N")
    each = reads.where(F.length(seq) > 0).select(*by, unique.alias("__u"), F.explode(F.transform(places, lambda i: i + F.col(first_cycle) - 1)).alias("cycle"))
    return each.groupBy(*by, "cycle").agg(F.count(F.lit(1)).alias("blanks"), F.count_if("__u").alias("unique_blanks"))


def cycle_mismatches(fragments: DataFrame, by: list[str], cycles: str, unique: Column) -> DataFrame:
    """(by, cycle, mismatches, unique_mismatches) from the cycles of each fragment's mismatches."""
    each = fragments.select(*by, unique.alias("__u"), F.explode(cycles).alias("cycle"))
    return each.groupBy(*by, "cycle").agg(F.count(F.lit(1)).alias("mismatches"), F.count_if("__u").alias("unique_mismatches"))


def ratio(part: Column, whole: Column, digits: int = 2, factor: float = 100.0) -> Column:
    """A percentage, rounded; null where the whole is 0 or null."""
    return F.round(F.try_divide(part * F.lit(factor), whole), digits)


def across_tiles(values: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """Mean over tiles and population deviation, which is null for fewer than ENOUGH_TILES tiles."""
    n = F.count(value)
    return values.groupBy(*by).agg(n.alias("tiles"), F.round(F.avg(value), digits).alias("mean_value"), F.round(F.when(n >= ENOUGH_TILES, F.stddev_pop(value)), digits).alias("deviation"))


def match_tally(matches: DataFrame, by: list[str]) -> DataFrame:
    """Matches of each tile, pass and barcode, by kind."""
    kinds = ("too_many", "hit", "none")
    return matches.groupBy(*by).agg(*(F.count_if(F.col("match_kind") == k).alias(k) for k in kinds))


def as_xml(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(keys, xml): each row of a table of statistics as an element."""
    body = F.to_xml(F.struct(*(c for c in rows.columns)), {"rowTag": tag})
    return rows.select(*keys, body.alias("xml"))


def as_html(rows: DataFrame, title: str, keys: list[str]) -> DataFrame:
    """(keys, html): a page for each group of ``keys`` (a lane, a sample) with its rows of statistics as a table.

    Rows stand in the order of their text. A group is as large as the statistics of a lane or sample.
    """
    columns = [c for c in rows.columns if c not in keys]
    safe = lambda x: F.replace(F.replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda tag, cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")) for x in cells), F.lit("</tr>"))
    body = rows.select(*keys, line("td", [safe(F.col(c)) for c in columns]).alias("__row")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__row")), "\n").alias("__rows"))
    name = F.concat_ws(" ", F.lit(title), *(F.col(k).cast("string") for k in keys))
    head = line("th", [safe(F.lit(c)) for c in columns])
    page = F.concat(F.lit("<!DOCTYPE html>\n<html><head><title>"), safe(name), F.lit("</title></head><body><h1>"), safe(name), F.lit("</h1>\n<table>\n"), head, F.lit("\n"), F.col("__rows"), F.lit("\n</table></body></html>\n"))
    return body.select(*keys, page.alias("html"))
