"""Pairs of ends: the model of template lengths, the classes of pairs, the best pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import score as sc
from strandlake.operators.fragments import best_candidate
from strandlake.operators.joins import pair_join

#: Longest template of the model; median and maximum without data.
LONGEST = 50000
#: Parts of the sorted lengths at which the model's numbers stand.
QUANTILES = {
    "min_length": (1 - sc.THREE_SIGMA) / 2,
    "low_sigma": (1 - sc.ONE_SIGMA) / 2,
    "median_length": 0.5,
    "high_sigma": (1 + sc.ONE_SIGMA) / 2,
    "max_length": (1 + sc.THREE_SIGMA) / 2,
}


def template_length_stats(pairs: DataFrame, by: list[str], length: str, model: str) -> DataFrame:
    """One row for each group: its two most frequent models and the quantiles of their lengths.

    Quantiles are the values at index floor(n p) of the sorted lengths, not interpolated. They are
    taken from the counts of distinct lengths (at most LONGEST of each group), so no group is sorted
    row by row. Ties of models go to the lower number; a group without pairs has no row.
    """
    usable = pairs.where((F.col(length) <= LONGEST) & (F.col(length) >= 0) & F.col(model).isNotNull())
    counts = usable.groupBy(*by, model, length).agg(F.count(F.lit(1)).alias("n"))
    models = counts.groupBy(*by, model).agg(F.sum("n").alias("m"))
    ranked = models.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("m"), model))).where("k <= 2")
    best = ranked.groupBy(*by).agg(F.max(F.when(F.col("k") == 1, F.col(model))).alias("best_model"), F.max(F.when(F.col("k") == 2, F.col(model))).alias("second_model"))
    kept = counts.join(ranked.select(*by, model), [*by, model], "left_semi").groupBy(*by, length).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    kept = kept.withColumn("upto", F.sum("n").over(w.orderBy(length).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = {name: F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col(length))).alias(name) for name, p in QUANTILES.items()}
    out = kept.groupBy(*by).agg(F.max("total").alias("templates"), *at.values()).join(best, by)
    return out.select(
        *by, "templates", "best_model", "second_model", "min_length", "median_length", "max_length",
        (F.col("median_length") - F.col("low_sigma")).alias("low_deviation"), (F.col("high_sigma") - F.col("median_length")).alias("high_deviation"),
    )


def template_samples(fragments: DataFrame, by: list[str], cluster: list[str]) -> DataFrame:
    """(by, cluster, template_length, model): the templates that tell their true length.

    ``fragments``: candidates of both ends (``end`` 1 or 2) with contig, pos, len (on the reference), reverse and cigar. Both
    ends have exactly one candidate, on one contig, that doesn't begin or end with an insertion, and the
    template is no longer than LONGEST.
    """
    place = F.struct("contig", "pos", "len", "reverse", "cigar")
    one = lambda i: F.max(F.when(F.col("end") == i, place)).alias(f"e{i}")
    ends = fragments.groupBy(*by, *cluster).agg(F.count_if(F.col("end") == 1).alias("n1"), F.count_if(F.col("end") == 2).alias("n2"), one(1), one(2))
    a, b = F.col("e1"), F.col("e2")
    inside = lambda e: ~F.coalesce(e["cigar"].rlike(r"^\d+I|I$"), F.lit(False))
    rows = ends.where((F.col("n1") == 1) & (F.col("n2") == 1) & (a["contig"] == b["contig"]) & inside(a) & inside(b))
    length = sc.template_length(a["pos"], a["len"], b["pos"], b["len"])
    return rows.select(*by, *cluster, length.alias("template_length"), sc.model(a["reverse"], b["reverse"], a["pos"] > b["pos"]).alias("model")).where(F.col("template_length") <= LONGEST)


def given_stats(text: str) -> dict:
    """A model given as ``min:median:max:low:high:best:second``, models by name ('FR+') or number."""
    parts = text.split(":")
    if len(parts) != 7:
        raise ValueError("a template model has seven parts")
    names = [m[:2] + ("+" if m[2] == "p" else "-") for m in sc.MODELS]
    number = lambda m: names.index(m) if m in names else int(m)
    values = [*map(int, parts[:5]), number(parts[5]), number(parts[6])]
    if not values[0] <= values[1] <= values[2] or not all(0 <= m < 8 for m in values[5:]):
        raise ValueError("the lengths of a template model must rise, its models be known")
    return dict(zip(("min_length", "median_length", "max_length", "low_deviation", "high_deviation", "best_model", "second_model"), values, strict=True))


def mate_reverse(best: Column, second: Column, read: int, reverse: Column) -> Column:
    """Expected strand of the other end, by the first of the two models in which this end has its strand."""
    own = lambda m: F.shiftright(m, (read + 1) % 2).bitwiseAND(F.lit(1)) == 1
    other = lambda m: F.shiftright(m, read).bitwiseAND(F.lit(1)) == 1
    return F.when(own(best) == reverse, other(best)).when(own(second) == reverse, other(second)).otherwise(other(best))


def mate_window(best: Column, second: Column, read: int, reverse: Column, position: Column, low: Column, high: Column, own_length: Column, mate_length: Column) -> tuple[Column, Column]:
    """First and last start of the other end; the position itself where no model has this strand."""
    own = lambda m: F.shiftright(m, (read + 1) % 2).bitwiseAND(F.lit(1)) == 1
    leads = lambda m: F.shiftright(m, 2).bitwiseAND(F.lit(1)) == read
    valid = (own(best) == reverse) | (own(second) == reverse)
    first = F.when(own(best) == reverse, leads(best)).otherwise(leads(second))
    start = F.when(first, position + low - mate_length).otherwise(position - high + own_length)
    end = F.when(first, position + high - mate_length).otherwise(position - low + own_length)
    return F.when(valid, start).otherwise(position), F.when(valid, end).otherwise(position)


def best_pair(pairs: DataFrame, cluster: list[str], cost: str, log_probability: str, order: list[str]) -> DataFrame:
    """The pair of lowest cost, then highest log probability, with its ties and the sum of all probabilities."""
    w = Window.partitionBy(*cluster)
    summed = pairs.withColumn("total", F.sum(F.exp(log_probability)).over(w)).withColumn("__c", F.min(cost).over(w))
    at = summed.where(F.col(cost) == F.col("__c")).withColumn("__lp", F.max(log_probability).over(w))
    tied = at.where(F.col(log_probability) >= F.col("__lp") - sc.EPSILON).withColumn("ties", F.count(F.lit(1)).over(w))
    return tied.withColumn("__k", F.row_number().over(w.orderBy(*order))).where("__k = 1").drop("__k", "__c", "__lp")


#: Columns of a candidate end besides the cluster.
END = ["contig", "pos", "len", "reverse", "cost", "lp"]


def build_templates(first: DataFrame, second: DataFrame, models: DataFrame, group: str, rest: Column) -> DataFrame:
    """One template for each cluster: its best pair, or the best of each end where no pair fits the model.

    ``first`` and ``second``: candidates of the ends (cluster, ``group`` and END); ``models``: one row for
    each group, as from ``template_length_stats``. A pair lies on one contig under one of the two
    models, no longer than LONGEST. ``kind`` is 'proper' (of nominal length), 'pair', 'apart' (both
    ends, no pair) or 'single'. The score of a pair is that of its probability against all other pairs'
    and the rest of the genome; other kinds have none. A repeated best pair has score 0 to 3 by its ties.
    """
    side = lambda df, i: df.select("cluster", group, "contig", *(F.col(c).alias(f"{c}{i}") for c in END if c != "contig"))
    both = pair_join(side(first, 1), side(second, 2).drop(group), ["cluster", "contig"], LONGEST)
    both = both.withColumn("model", sc.model(F.col("reverse1"), F.col("reverse2"), F.col("pos1") > F.col("pos2"))).join(models, group)
    kind = sc.check_model(F.col("template_length"), F.col("model"), F.col("min_length"), F.col("max_length"), F.col("best_model"), F.col("second_model"))
    pairs = both.withColumn("fit", kind).where("fit <> 'nomatch'").withColumn("cost", F.col("cost1") + F.col("cost2")).withColumn("lp", F.col("lp1") + F.col("lp2"))
    # one pair of places counts once, however many seeds led to it
    pairs = pairs.dropDuplicates(["cluster", "contig", "pos1", "reverse1", "pos2", "reverse2"])
    best = best_pair(pairs, ["cluster"], "cost", "lp", ["contig", "pos1", "pos2", "reverse1", "reverse2"])
    others = F.greatest(F.col("total") - F.exp("lp"), F.lit(0.0)) + rest
    paired = best.select(
        "cluster", group, F.when(F.col("fit") == "nominal", "proper").otherwise("pair").alias("kind"), F.col("contig").alias("contig1"), F.col("contig").alias("contig2"),
        "pos1", "pos2", "reverse1", "reverse2", "template_length", "ties", sc.phred(others, F.exp("lp")).alias("score"),
    )
    ends = []
    for i, df in ((1, first), (2, second)):
        left = df.join(paired.select("cluster"), "cluster", "left_anti")
        one = best_candidate(left, ["cluster"], "cost", "lp", ["contig", "pos", "reverse"])
        ends.append(one.select("cluster", F.col(group).alias(f"g{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("contig", "pos", "reverse")), F.col("ties").alias(f"t{i}")))
    rest_of = ends[0].join(ends[1], "cluster", "full").select(
        "cluster", F.coalesce("g1", "g2").alias(group), F.when(F.col("t1").isNotNull() & F.col("t2").isNotNull(), "apart").otherwise("single").alias("kind"),
        "contig1", "contig2", "pos1", "pos2", "reverse1", "reverse2", F.lit(None).cast("long").alias("template_length"), F.greatest("t1", "t2").alias("ties"), F.lit(None).cast("int").alias("score"),
    )
    return paired.withColumn("template_length", F.col("template_length").cast("long")).unionByName(rest_of)
