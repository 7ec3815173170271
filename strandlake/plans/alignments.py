"""Queries over alignments, with the SQL that checks them.

The order tables stand in for alignments: a line item is a fragment (supplier = contig, part =
position, quantity = length and quality, odd line numbers on the reverse strand), an order is the
cluster of its fragments, the return flag a library, the line status a lane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import score as sc
from strandlake.functions import sequence as sq
from strandlake.operators import build, fragments, index, joins, stats, template
from strandlake.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def fragment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the role of fragments."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("cluster"), c("l_linenumber").alias("part"), c("l_suppkey").alias("contig"), c("l_partkey").alias("pos"),
        c("l_quantity").cast("int").alias("len"), (c("l_linenumber") % 2 == 1).alias("reverse"), c("l_returnflag").alias("library"), c("l_linestatus").alias("lane"),
        F.round(c("l_discount") * 100).cast("int").alias("edits"), F.floor(c("l_extendedprice") % 61).cast("int").alias("score"),
    )


FRAGMENTS = """f AS (SELECT l_orderkey AS cluster, l_linenumber AS part, l_suppkey AS contig, l_partkey AS pos, CAST(l_quantity AS INT) AS len, l_linenumber % 2 = 1 AS reverse,
  l_returnflag AS library, l_linestatus AS lane, CAST(round(l_discount * 100) AS INT) AS edits, CAST(floor(l_extendedprice % 61) AS INT) AS score FROM lineitem)"""

_ENDS = f"""{FRAGMENTS},
e AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY part, lane, contig, pos, len, reverse) AS k FROM f),
p AS (SELECT a.cluster, a.lane, a.contig % 5 AS contig, a.pos AS pos1, a.len AS len1, a.reverse AS rev1, b.pos AS pos2, b.len AS len2, b.reverse AS rev2 FROM e a JOIN e b ON a.cluster = b.cluster AND a.k = 1 AND b.k = 2),
q AS (SELECT *, greatest(pos1 + len1, pos2 + len2) - least(pos1, pos2) AS template_length, CAST(CASE WHEN pos1 > pos2 THEN 4 ELSE 0 END + CASE WHEN rev1 THEN 2 ELSE 0 END + CASE WHEN rev2 THEN 1 ELSE 0 END AS INT) AS model FROM p)"""


def end_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two fragments of each cluster as the ends of a template."""
    f = fragment_rows(spark, sf_dir)
    two = f.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct("part", "lane", "contig", "pos", "len", "reverse"))), 1, 2).alias("e")).where(F.size("e") == 2)
    a, b = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    rows = two.select("cluster", a["lane"].alias("lane"), (a["contig"] % 5).alias("contig"), *(x[c].alias(f"{n}{i}") for i, x in ((1, a), (2, b)) for c, n in (("pos", "pos"), ("len", "len"), ("reverse", "rev"))))
    c = F.col
    return rows.withColumn("template_length", sc.template_length(c("pos1"), c("len1"), c("pos2"), c("len2"))).withColumn("model", sc.model(c("rev1"), c("rev2"), c("pos1") > c("pos2")))


_LOW, _HIGH = template.QUANTILES["min_length"], template.QUANTILES["max_length"]
_TLS = f"""{_ENDS},
m0 AS (SELECT lane, model, count(*) AS n FROM q WHERE template_length <= 50000 GROUP BY ALL),
m AS (SELECT lane, model, row_number() OVER (PARTITION BY lane ORDER BY n DESC, model) AS k FROM m0),
s AS (SELECT lane, template_length AS t, row_number() OVER (PARTITION BY lane ORDER BY template_length) - 1 AS i, count(*) OVER (PARTITION BY lane) AS n
  FROM q WHERE template_length <= 50000 AND EXISTS (FROM m WHERE m.lane = q.lane AND m.model = q.model AND k <= 2)),
tls AS (SELECT lane, max(n) AS templates, max(CASE WHEN i = floor(n * {_LOW!r}) THEN t END) AS min_length, max(CASE WHEN i = floor(n * 0.5) THEN t END) AS median_length, max(CASE WHEN i = floor(n * {_HIGH!r}) THEN t END) AS max_length,
  max(CASE WHEN i = floor(n * 0.5) THEN t END) - max(CASE WHEN i = floor(n * {template.QUANTILES['low_sigma']!r}) THEN t END) AS low_deviation,
  max(CASE WHEN i = floor(n * {template.QUANTILES['high_sigma']!r}) THEN t END) - max(CASE WHEN i = floor(n * 0.5) THEN t END) AS high_deviation FROM s GROUP BY lane),
mm AS (SELECT lane, max(CASE WHEN k = 1 THEN model END) AS best_model, max(CASE WHEN k = 2 THEN model END) AS second_model FROM m GROUP BY lane)"""


@query(f"WITH {_TLS} SELECT tls.*, best_model, second_model FROM tls JOIN mm USING (lane)")
def a10_template_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of template lengths of each lane."""
    return template.template_length_stats(end_pairs(spark, sf_dir), ["lane"], "template_length", "model")


@query(f"""WITH {_TLS}
SELECT q.lane, model, CAST(CASE WHEN model < 4 THEN model ELSE 7 - model END AS INT) AS model_class,
  CASE WHEN model <> best_model AND model <> second_model THEN 'nomatch' WHEN template_length > max_length THEN 'oversized' WHEN template_length < min_length THEN 'undersized' ELSE 'nominal' END AS kind, count(*) AS templates
FROM q JOIN tls USING (lane) JOIN mm USING (lane) GROUP BY ALL""")
def m10_check_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates by orientation, its class, and size against the model of the lane."""
    pairs = end_pairs(spark, sf_dir)
    # one row for each lane
    model = template.template_length_stats(pairs, ["lane"], "template_length", "model")
    c = F.col
    kind = sc.check_model(c("template_length"), c("model"), c("min_length"), c("max_length"), c("best_model"), c("second_model"))
    return pairs.join(model, "lane").groupBy("lane", "model", sc.model_class(c("model")).alias("model_class"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("templates"))


@query(f"""WITH {_TLS}, o AS (SELECT q.cluster, CAST(pos1 AS BIGINT) AS pos1, len1, len2, rev1, best_model AS b, second_model AS s, min_length, max_length FROM q JOIN tls USING (lane) JOIN mm USING (lane)),
v AS (SELECT *, ((b >> 1) & 1 = 1) = rev1 AS vb, ((s >> 1) & 1 = 1) = rev1 AS vs FROM o)
SELECT cluster, CASE WHEN vb THEN b & 1 = 1 WHEN vs THEN s & 1 = 1 ELSE b & 1 = 1 END AS mate_reverse,
  CAST(CASE WHEN NOT (vb OR vs) THEN pos1 WHEN (CASE WHEN vb THEN (b >> 2) & 1 ELSE (s >> 2) & 1 END) = 0 THEN pos1 + min_length - len2 ELSE pos1 - max_length + len1 END AS BIGINT) AS mate_from,
  CAST(CASE WHEN NOT (vb OR vs) THEN pos1 WHEN (CASE WHEN vb THEN (b >> 2) & 1 ELSE (s >> 2) & 1 END) = 0 THEN pos1 + max_length - len2 ELSE pos1 - min_length + len1 END AS BIGINT) AS mate_to FROM v""")
def m11_mate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and on which strand the model expects the second end of each template."""
    pairs = end_pairs(spark, sf_dir)
    rows = pairs.join(template.template_length_stats(pairs, ["lane"], "template_length", "model"), "lane")
    c = F.col
    first, last = template.mate_window(c("best_model"), c("second_model"), 0, c("rev1"), c("pos1"), c("min_length"), c("max_length"), c("len1"), c("len2"))
    return rows.select("cluster", template.mate_reverse(c("best_model"), c("second_model"), 0, c("rev1")).alias("mate_reverse"), first.cast("long").alias("mate_from"), last.cast("long").alias("mate_to"))


@query(f"""WITH {FRAGMENTS},
pr AS (SELECT a.cluster, a.part AS part1, b.part AS part2, a.edits + b.edits AS cost, round(-(a.len + b.len) / 10.0, 4) AS lp
  FROM f a JOIN f b ON a.cluster = b.cluster AND a.reverse AND NOT b.reverse AND greatest(a.pos + a.len, b.pos + b.len) - least(a.pos, b.pos) <= 20000),
c AS (SELECT *, sum(exp(lp)) OVER (PARTITION BY cluster) AS total, min(cost) OVER (PARTITION BY cluster) AS mc FROM pr),
t AS (SELECT *, max(lp) OVER (PARTITION BY cluster) AS ml FROM c WHERE cost = mc),
k AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS ties, row_number() OVER (PARTITION BY cluster ORDER BY part1, part2) AS k FROM t WHERE lp >= ml - 1e-7)
SELECT cluster, part1, part2, cost, lp, ties, round(total, 6) AS total FROM k WHERE k = 1""")
def w06_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of candidates of both ends of each cluster."""
    f = fragment_rows(spark, sf_dir)
    side = lambda i, keep: f.where(keep).select("cluster", *(F.col(c).alias(f"{c}{i}") for c in ("part", "pos", "len", "edits")))
    pairs = joins.pair_join(side(1, F.col("reverse")), side(2, ~F.col("reverse")), ["cluster"], 20000)
    pairs = pairs.select("cluster", "part1", "part2", (F.col("edits1") + F.col("edits2")).alias("cost"), F.round(-(F.col("len1") + F.col("len2")) / 10.0, 4).alias("lp"))
    best = template.best_pair(pairs, ["cluster"], "cost", "lp", ["part1", "part2"])
    return best.withColumn("total", F.round("total", 6))


@query(f"""WITH {FRAGMENTS}, c AS (SELECT *, min(edits) OVER (PARTITION BY cluster) AS mc FROM f),
t AS (SELECT *, max(-len / 10.0) OVER (PARTITION BY cluster) AS ml FROM c WHERE edits = mc),
k AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS ties, row_number() OVER (PARTITION BY cluster ORDER BY part) - 1 AS k FROM t WHERE -len / 10.0 >= ml - 1e-7)
SELECT cluster, part, edits, len, ties FROM k WHERE k = cluster % ties""")
def w05_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each cluster, repeats spread over their ties."""
    f = fragment_rows(spark, sf_dir).withColumn("lp", -F.col("len") / 10.0)
    return fragments.best_candidate(f, ["cluster"], "edits", "lp", ["part"], "cluster").select("cluster", "part", "edits", "len", "ties")


@query(f"""WITH {FRAGMENTS}, d AS (SELECT DISTINCT cluster, contig, pos, reverse, -len / 5.0 AS lp FROM f), s AS (SELECT cluster, max(lp) AS best, sum(exp(lp)) AS total FROM d GROUP BY 1)
SELECT cluster, best, CAST(floor(-10 * log10((greatest(total - exp(best), 0) + 2e-5) / ((greatest(total - exp(best), 0) + 2e-5) + exp(best)))) AS INT) AS score FROM s""")
def g14_fragment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the best candidate of each cluster against the others and the rest of a genome."""
    f = fragment_rows(spark, sf_dir).withColumn("lp", -F.col("len") / 5.0)
    return fragments.fragment_score(f, ["cluster"], "lp", F.lit(2e-5))


@query(f"""WITH {FRAGMENTS}, few AS (SELECT contig FROM f GROUP BY 1 HAVING count(*) < 60)
SELECT contig, pos // 500 AS place, reverse, CAST(sum(CASE WHEN edits = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unique_seeds, min(CASE WHEN edits > 0 THEN len END) AS weak_first, max(CASE WHEN edits > 0 THEN len END) AS weak_last,
  sum(CASE WHEN edits = 0 THEN 1 ELSE 0 END) > 0 OR coalesce(max(CASE WHEN edits > 0 THEN len END) - min(CASE WHEN edits > 0 THEN len END) >= 32, FALSE) AS well_anchored
FROM f WHERE contig NOT IN (FROM few) GROUP BY ALL""")
def f14_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one place as one, without those of rare contigs, and whether they are well anchored."""
    f = fragment_rows(spark, sf_dir)
    rare = fragments.drop_repeats(f.select("contig", "cluster", "part"), ["contig"], 60).select("contig").distinct()
    rows = f.join(rare, "contig", "left_anti").select(
        "contig", F.floor(F.col("pos") / 500).alias("place"), "reverse", F.when(F.col("edits") == 0, 1).otherwise(0).alias("unique_seeds"), F.when(F.col("edits") > 0, F.col("len")).alias("weak_offset")
    )
    c = fragments.consolidate(rows, ["contig", "place", "reverse"])
    return c.withColumn("well_anchored", sc.well_anchored(F.col("unique_seeds"), F.col("weak_first"), F.col("weak_last")))


@query(f"""WITH {FRAGMENTS} SELECT len < 32 AND (edits > len // 8 OR -edits * 2.0 < ln(1e-4 / 3) / 4 * len) AS very_bad, score > 3 AS uniquely_aligned, count(*) AS n FROM f GROUP BY ALL""")
def f10_bad_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments by the predicates of a very bad and of a unique alignment."""
    f = fragment_rows(spark, sf_dir)
    c = F.col
    return f.groupBy(sc.very_bad(c("len"), c("edits"), c("len"), -c("edits") * 2.0).alias("very_bad"), sc.uniquely_aligned(c("score")).alias("uniquely_aligned")).agg(F.count(F.lit(1)).alias("n"))


_MARKED = f"""WITH {FRAGMENTS}, 
b AS (SELECT *, first_value(struct_pack(c := cluster, p := part)) OVER (PARTITION BY contig % 3, pos // 20, reverse, library ORDER BY len DESC, len - edits DESC, score DESC, cluster, part) AS best FROM f),
d AS (SELECT *, best.c <> cluster OR best.p <> part AS duplicate FROM b)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragment_rows(spark, sf_dir).withColumn("strand_contig", F.col("contig") % 3).withColumn("anchor", F.floor(F.col("pos") / 20))
    c = F.col
    rank = sc.duplicate_rank(c("len"), c("len"), c("edits"), c("score"))
    return build.mark_duplicates(f, ["strand_contig", "anchor", "reverse"], rank, ["cluster", "part"], ["library"])


@query(f"{_MARKED} SELECT cluster, part, duplicate FROM d")
def w01_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments with a mark for duplicates within their library."""
    return _marked(spark, sf_dir).select("cluster", "part", "duplicate")


@query(f"{_MARKED} SELECT library, lane, count(*) AS total, count(*) FILTER (WHERE NOT duplicate) AS unique_fragments FROM d GROUP BY ALL")
def a09_duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and unique ones of each library and lane."""
    return build.duplicate_stats(_marked(spark, sf_dir), ["library", "lane"])


@query(f"""WITH {FRAGMENTS}, g AS (SELECT p_partkey AS part_id, p_partkey % 7 AS grp, p_partkey AS gap_from, p_partkey + p_size % 13 AS gap_to FROM part)
SELECT cluster, part, part_id FROM f JOIN g ON f.contig % 7 = g.grp AND pos < gap_to AND gap_from < pos + len AND gap_to > gap_from""")
def j12_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments and the gaps that overlap them."""
    f = fragment_rows(spark, sf_dir).select("cluster", "part", (F.col("contig") % 7).alias("grp"), "pos", (F.col("pos") + F.col("len")).alias("end"))
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), (F.col("p_partkey") % 7).alias("grp"), F.col("p_partkey").alias("gap_from"), (F.col("p_partkey") + F.col("p_size") % 13).alias("gap_to"))
    return joins.interval_join(f, g, ["grp"], ("pos", "end"), ("gap_from", "gap_to"), 64).select("cluster", "part", "part_id")


@query(f"""WITH {FRAGMENTS}, c AS (SELECT contig, pos, len, part, CASE WHEN part % 3 = 0 THEN pos + len ELSE pos + len + part + 10 END AS d, part AS g FROM f)
SELECT DISTINCT contig, CASE WHEN part % 3 = 0 THEN pos + len ELSE pos + len END AS gap_pos, CASE WHEN part % 3 = 0 THEN -part ELSE part END AS gap_len FROM c""")
def g19_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of CIGAR strings: len M, part I or D, ten M."""
    f = fragment_rows(spark, sf_dir)
    cigar = F.concat(F.col("len").cast("string"), F.lit("M"), F.col("part").cast("string"), F.when(F.col("part") % 3 == 0, "I").otherwise("D"), F.lit("10M"))
    return build.collect_gaps(f.withColumn("cigar", cigar), ["contig"], "pos", "cigar")


@query(f"""WITH {FRAGMENTS} SELECT cluster, part, len || 'M' || part || 'I5S' AS cigar, CAST(len + part + 5 AS INT) AS read_bases, len AS mapped_bases, CAST((len << 4) AS INT) AS first_word FROM f""")
def x10_cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and words of CIGAR strings, parsed and put together again."""
    text = F.concat(F.col("len").cast("string"), F.lit("M"), F.col("part").cast("string"), F.lit("I5S"))
    rows = fragment_rows(spark, sf_dir).select("cluster", "part", sq.cigar_ops(text).alias("ops"))
    first = F.get("ops", F.lit(0))
    return rows.select("cluster", "part", sq.cigar_text(F.col("ops")).alias("cigar"), sq.read_length(F.col("ops")).alias("read_bases"), sq.mapped_length(F.col("ops")).alias("mapped_bases"), sq.cigar_word(first["len"], first["op"]).alias("first_word"))


@query(f"""WITH {FRAGMENTS}
SELECT cluster, part, CAST(1 + CASE WHEN edits = 0 THEN 2 ELSE 0 END + CASE WHEN reverse THEN 16 ELSE 0 END + CASE WHEN part = 1 THEN 64 ELSE 128 END + CASE WHEN library = 'N' THEN 512 ELSE 0 END AS INT) AS flag,
  CAST(CASE WHEN edits = 0 THEN least(60, greatest(score, len)) ELSE least(60, score) END AS INT) AS mapq,
  CAST(CASE WHEN pos >> 14 = (pos + len - 1) >> 14 THEN 4681 + (pos >> 14) WHEN pos >> 17 = (pos + len - 1) >> 17 THEN 585 + (pos >> 17) ELSE 73 + (pos >> 20) END AS BIGINT) AS bin FROM f""")
def m12_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag, mapping quality and index bin of every fragment."""
    c = F.col
    flag = sc.bam_flag(paired=F.lit(True), proper=c("edits") == 0, reverse=c("reverse"), first=c("part") == 1, second=c("part") != 1, fail=c("library") == "N")
    return fragment_rows(spark, sf_dir).select("cluster", "part", flag.alias("flag"), sc.mapq(c("score"), c("len"), c("edits") == 0).alias("mapq"), sc.bam_bin(c("pos"), c("pos") + c("len")).alias("bin"))


@query(f"""WITH {FRAGMENTS} SELECT contig, pos, cluster, part, row_number() OVER (PARTITION BY contig ORDER BY pos, cluster, part) AS place FROM f""")
def o05_bam_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each fragment in the order of its contig's part of a BAM file."""
    order = build.bam_order("contig", "pos", "cluster", "cluster", F.lit(False), F.col("part"))
    return fragment_rows(spark, sf_dir).select("contig", "pos", "cluster", "part", F.row_number().over(Window.partitionBy("contig").orderBy(*order)).cast("long").alias("place"))


@query(f"""WITH {FRAGMENTS}, h AS (SELECT contig, pos // 2048 AS bin, count(*) AS matches FROM f GROUP BY ALL) SELECT contig, bin, matches FROM h""")
def a16_bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments in stretches of each contig."""
    return build.match_distribution(fragment_rows(spark, sf_dir), "contig", "pos")


@query(f"""WITH RECURSIVE {FRAGMENTS}, h AS (SELECT contig, pos * 64 // 2048 AS bin, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY bin) AS k FROM h),
w AS (SELECT contig, k, bin, n AS size, CAST(0 AS BIGINT) AS output_bin FROM o WHERE k = 1
  UNION ALL SELECT o.contig, o.k, o.bin, CASE WHEN size + n > 40 THEN n ELSE size + n END, CASE WHEN size + n > 40 THEN output_bin + 1 ELSE output_bin END FROM w JOIN o ON o.contig = w.contig AND o.k = w.k + 1)
SELECT contig, bin, output_bin FROM w""")
def w09_output_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output bins of at most 40 fragments from consecutive stretches; positions are spread to 64 times as far."""
    f = fragment_rows(spark, sf_dir).withColumn("pos", F.col("pos") * 64)
    return build.plan_bins(build.match_distribution(f, "contig", "pos"), "contig", 40)


@query("""
WITH d AS (SELECT l_suppkey AS source, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS day, bool_or(l_returnflag = 'R') AS flag FROM lineitem GROUP BY ALL),
g AS (SELECT *, day - row_number() OVER (PARTITION BY source, flag ORDER BY day) AS run FROM d)
SELECT source, min(day) AS first, max(day) AS last, flag, count(*) AS length FROM g GROUP BY source, flag, run""")
def w08_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive days with equal flag of each supplier, as intervals."""
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source"), day.alias("day")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("flag"))
    return index.islands(rows, ["source"], "day", "flag")


@query(f"""WITH {FRAGMENTS}, c AS (SELECT lane, contig % 10 AS tile, cluster, list_sort(list(part)) AS cycles FROM f GROUP BY ALL),
t AS (SELECT lane, tile, count(*) AS n FROM c GROUP BY ALL), u AS (SELECT lane, tile, unnest(cycles) AS cycle, unnest(range(len(cycles))) AS k FROM c),
g AS (SELECT lane, tile, cycle, {', '.join(f'count(*) FILTER (WHERE k = {k}) AS c{k}' for k in range(5))} FROM u WHERE k < 5 GROUP BY ALL)
SELECT lane, tile, cycle, {', '.join(f'CAST(n - sum(c{k}) OVER (PARTITION BY lane, tile ORDER BY cycle) AS BIGINT) AS at_most_{k}' for k in range(5))} FROM g JOIN t USING (lane, tile)""")
def w07_mismatch_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tile and cycle the clusters with at most k mismatches so far."""
    c = fragment_rows(spark, sf_dir).groupBy("lane", (F.col("contig") % 10).alias("tile"), "cluster").agg(F.array_sort(F.collect_list("part")).alias("cycles"))
    return stats.mismatch_curves(c, ["lane", "tile"], "cycles")


@query(f"""WITH {FRAGMENTS}, q AS (SELECT cluster, list_sort(list(struct_pack(p := part, len := len, e := edits))) AS l FROM f GROUP BY 1)
SELECT cluster, CAST(list_sum(list_transform(l, lambda x: x.len)) AS BIGINT) AS quality_sum, CAST(list_sum(list_transform(l, lambda x: x.e)) AS BIGINT) AS edit_sum FROM q""")
def a14_template_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and edits summed over the fragments of each template."""
    return fragment_rows(spark, sf_dir).groupBy("cluster").agg(F.sum("len").alias("quality_sum"), F.sum("edits").alias("edit_sum"))


@query(f"""WITH {FRAGMENTS}, n AS (SELECT contig FROM f GROUP BY 1 HAVING count(*) > 50) SELECT f.cluster, f.part, contig IN (FROM n) AS high_repeat FROM f WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = contig AND s_acctbal > 0)""")
def j14_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of contigs in use, and whether their contig is a repeat."""
    f = fragment_rows(spark, sf_dir)
    used = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("contig"))
    kept = f.join(used, "contig", "left_semi")
    repeats = f.groupBy("contig").agg(F.count(F.lit(1)).alias("n")).where("n > 50").select("contig", F.lit(True).alias("high_repeat"))
    return kept.join(repeats, "contig", "left").select("cluster", "part", F.coalesce("high_repeat", F.lit(False)).alias("high_repeat"))


@query(f"""WITH {FRAGMENTS}
SELECT 'FC:' || lane || ':' || contig || ':' || cluster || ':0' AS qname, CAST(1 + CASE WHEN reverse THEN 16 ELSE 0 END + CASE WHEN part = 1 THEN 64 ELSE 0 END AS INT) AS flag, 'chr' || contig AS rname, pos + 1 AS pos,
  CAST(least(60, score) AS INT) AS mapq, len || 'M' AS cigar, '=' AS rnext, pos + 2 AS pnext, CAST(0 AS INT) AS tlen, repeat('A', len) AS seq, chr(len + 33) AS qual FROM f""")
def k02_sam_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of SAM of every fragment."""
    c = F.col
    f = fragment_rows(spark, sf_dir)
    name = F.concat(F.lit("chr"), c("contig").cast("string"))
    return build.sam_columns(f.select(
        sq.read_name(F.lit("FC"), c("lane"), c("contig"), c("cluster")).alias("name"), F.lit(True).alias("paired"), F.lit(False).alias("proper"), "reverse", (c("part") == 1).alias("first"),
        name.alias("contig_name"), "pos", c("score").alias("single_score"), F.lit(None).cast("int").alias("template_score"), F.concat(c("len").cast("string"), F.lit("M")).alias("cigar"),
        name.alias("mate_contig_name"), (c("pos") + 1).alias("mate_pos"), F.lit(0).alias("tlen"), F.expr("repeat('A', len)").alias("seq"), F.array(c("len")).alias("qual"),
    ))


@query(f"""WITH {FRAGMENTS} SELECT cluster, part, (CAST(contig % 4096 AS BIGINT) << 52) | (CAST(len AS BIGINT) << 40) | (CAST(cluster AS BIGINT) << 9) | (CAST(part AS BIGINT) << 1) | CAST(reverse AS BIGINT) AS seed_id, contig % 4096 AS tile, len AS barcode FROM f WHERE contig % 4096 < 2048""")
def m05_seed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed identities of seeds, and two of their parts taken out again.

    Tiles from 2,048 on set the sign bit, so their identities are negative; the SQL leaves these out.
    """
    c = F.col
    f = fragment_rows(spark, sf_dir).withColumn("tile", c("contig") % 4096)
    rows = f.select("cluster", "part", sc.seed_id(c("tile"), c("len"), c("cluster"), c("part"), c("reverse")).alias("seed_id"))
    parts = sc.seed_parts(c("seed_id"))
    return rows.select("cluster", "part", "seed_id", parts["tile"].alias("tile"), parts["barcode"].cast("int").alias("barcode"))


@query(f"""WITH {_TLS},
c AS (SELECT cluster, lane, contig % 5 AS contig, pos, len, reverse, edits AS cost, -len / 10.0 AS lp, part FROM f),
a AS (SELECT * FROM c WHERE part % 2 = 1), b AS (SELECT * FROM c WHERE part % 2 = 0),
cd AS (SELECT a.cluster, a.lane, a.contig, a.pos AS pos1, b.pos AS pos2, a.reverse AS r1, b.reverse AS r2, greatest(a.pos + a.len, b.pos + b.len) - least(a.pos, b.pos) AS t,
  CASE WHEN a.pos > b.pos THEN 4 ELSE 0 END + CASE WHEN a.reverse THEN 2 ELSE 0 END + CASE WHEN b.reverse THEN 1 ELSE 0 END AS model FROM a JOIN b ON a.cluster = b.cluster AND a.contig = b.contig),
fit AS (SELECT DISTINCT cd.cluster FROM cd JOIN mm ON cd.lane = mm.lane WHERE t <= 50000 AND (model = best_model OR model = second_model))
SELECT cluster, CASE WHEN cluster IN (FROM fit) THEN 'paired' WHEN cluster IN (SELECT cluster FROM a) AND cluster IN (SELECT cluster FROM b) THEN 'apart' ELSE 'single' END AS kind FROM (SELECT DISTINCT cluster FROM c)""")
def g15_template_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ends of each cluster make a pair under the model of its lane."""
    return g17_templates(spark, sf_dir).select("cluster", F.when(F.col("kind").isin("proper", "pair"), "paired").otherwise(F.col("kind")).alias("kind"))


@query()
def g17_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template of each cluster: odd line items are candidates of the first end, even ones of the second."""
    f = fragment_rows(spark, sf_dir)
    c = f.select("cluster", "lane", "part", (F.col("contig") % 5).alias("contig"), "pos", "len", "reverse", F.col("edits").alias("cost"), (-F.col("len") / 10.0).alias("lp"))
    models = template.template_length_stats(end_pairs(spark, sf_dir), ["lane"], "template_length", "model")
    return template.build_templates(c.where("part % 2 = 1"), c.where("part % 2 = 0"), models, "lane", F.lit(2e-5))


@query(f"""WITH {FRAGMENTS} SELECT cluster, part FROM f WHERE CASE WHEN edits = 0 THEN len ELSE score END >= 30""")
def f05_above_mapq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments above a score, proper pairs by that of their template."""
    f = fragment_rows(spark, sf_dir).select("cluster", "part", (F.col("edits") == 0).alias("proper"), F.col("len").alias("template_score"), F.col("score").alias("single_score"))
    return build.above_mapq(f, 30).select("cluster", "part")


@query(f"""{_MARKED}, s AS (SELECT library, lane, count(*) AS total, count(*) FILTER (WHERE NOT duplicate) AS uniq FROM d GROUP BY ALL)
SELECT library, lane, '<BuildStats>' || chr(10) || '    <library>' || library || '</library>' || chr(10) || '    <lane>' || lane || '</lane>' || chr(10) || '    <total>' || total || '</total>' || chr(10)
  || '    <unique_fragments>' || uniq || '</unique_fragments>' || chr(10) || '</BuildStats>' AS xml FROM s""")
def k10_stats_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate statistics of each library and lane as XML."""
    return stats.as_xml(a09_duplicate_stats(spark, sf_dir), ["library", "lane"], "BuildStats")
