"""Assignment of reads to samples by their barcodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as sq

#: Unknown barcodes reported for each lane.
TOP_UNKNOWN = 10
#: Mismatches of a first component up to which it is cut into pieces; with more, all samples of the lane are compared.
MOST_CUT = 2


def expand_barcodes(sheet: DataFrame) -> DataFrame:
    """(flowcell, lane, barcode_id, variant, mismatched): all spellings of each barcode within its mismatches.

    Each of the two components may have 0, 1 or 2 mismatches (``mismatches``; 1 where absent). The
    sheet has one row for each sample of a lane; the result has up to hundreds of thousands for it.
    """
    parts = F.split(F.upper("barcode_seq"), "-")
    rows = sheet.where(F.col("barcode_seq").isNotNull()).select("flowcell", "lane", "barcode_id", parts.alias("p"), "mismatches")
    for c in (0, 1):
        part = F.coalesce(F.get("p", F.lit(c)), F.lit(""))
        allowed = F.coalesce(F.get("mismatches", F.lit(c)), F.lit(1))
        none = F.array(part)
        once = F.array_union(none, sq.variants(part))
        twice = F.array_distinct(F.flatten(F.transform(once, sq.variants)))
        rows = rows.withColumn(f"c{c}", F.explode(F.when((allowed == 0) | (part == ""), none).when(allowed == 1, once).otherwise(twice)))
        rows = rows.withColumn(f"d{c}", F.when(part == "", 0).otherwise(sq.hamming(F.col(f"c{c}"), part)))
    variant = F.when(F.col("c1") == "", F.col("c0")).otherwise(F.concat_ws("-", "c0", "c1"))
    return rows.select("flowcell", "lane", "barcode_id", variant.alias("variant"), (F.col("d0") + F.col("d1")).alias("mismatched"))


def collisions(variants: DataFrame) -> DataFrame:
    """Spellings that belong to several barcodes of a lane."""
    by = variants.groupBy("flowcell", "lane", "variant").agg(F.count_distinct("barcode_id").alias("barcodes"))
    return by.where("barcodes > 1")


def require_no_collisions(variants: DataFrame) -> DataFrame:
    """The variants; reading them fails if a spelling belongs to several barcodes."""
    w = Window.partitionBy("flowcell", "lane", "variant")
    n = F.max("barcode_id").over(w) != F.min("barcode_id").over(w)
    message = F.concat(F.lit("barcode collision: "), "variant")
    return variants.withColumn("barcode_id", F.when(n, F.raise_error(message)).otherwise(F.col("barcode_id")))


def _pieces(part: Column, m: int) -> list[Column]:
    """(m, place, text): a part cut into m + 1 pieces; beyond two mismatches one empty piece, which every part has."""
    if m > MOST_CUT:
        return [F.struct(F.lit(m).alias("m"), F.lit(0).alias("i"), F.lit("").alias("text"))]
    edge = lambda i: F.floor(F.length(part) * i / (m + 1)).cast("int")
    return [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.substring(part, edge(i) + 1, edge(i + 1) - edge(i)).alias("text")) for i in range(m + 1)]


def demultiplex(observed: DataFrame, sheet: DataFrame, barcode: str) -> DataFrame:
    """Observed rows (with flowcell, lane) and ``found_id`` and ``mismatched``; null where no barcode fits.

    Of several the one with fewest mismatches is taken, then the lowest id. Spellings aren't listed, as
    a sample can have hundreds of thousands: two first components within m mismatches have one of
    m + 1 pieces in common, so the distinct barcodes of a lane meet by a piece the samples that they
    may belong to, and the mismatches of these pairs are counted. Any letter but the sample's is a mismatch.
    """
    component = lambda text, c: F.coalesce(F.get(F.split(text, "-"), F.lit(c)), F.lit(""))
    allowed = [F.coalesce(F.get("mismatches", F.lit(c)), F.lit(1)) for c in (0, 1)]
    sizes = lambda a, b: [F.length(a).alias("la"), F.length(b).alias("lb")]
    text = F.upper("barcode_seq")
    samples = sheet.where(text.isNotNull()).select("flowcell", "lane", "barcode_id", component(text, 0).alias("a"), component(text, 1).alias("b"), allowed[0].alias("ma"), allowed[1].alias("mb"))
    own = F.when(F.col("ma") > MOST_CUT, F.array(*_pieces(F.col("a"), MOST_CUT + 1)))
    for m in range(MOST_CUT + 1):
        own = own.when(F.col("ma") == m, F.array(*_pieces(F.col("a"), m)))
    samples = samples.select("*", *sizes("a", "b"), F.explode(own).alias("piece"))
    codes = observed.where(F.col(barcode).isNotNull()).select("flowcell", "lane", barcode).distinct()
    codes = codes.select("*", component(F.col(barcode), 0).alias("x"), component(F.col(barcode), 1).alias("y"))
    every = F.array(*(p for m in range(MOST_CUT + 2) for p in _pieces(F.col("x"), m)))
    codes = codes.select("*", *sizes("x", "y"), F.explode(every).alias("piece"))
    pairs = codes.join(samples, ["flowcell", "lane", "la", "lb", "piece"]).where((F.col("lb") > 0) | ~F.contains(barcode, F.lit("-")))
    pairs = pairs.withColumns({"da": sq.hamming(F.col("x"), F.col("a")), "db": sq.hamming(F.col("y"), F.col("b"))}).where("da <= ma AND db <= mb")
    one = pairs.groupBy("flowcell", "lane", barcode).agg(F.min(F.struct((F.col("da") + F.col("db")).alias("mismatched"), "barcode_id")).alias("m"))
    one = one.select("flowcell", "lane", barcode, F.col("m.barcode_id").alias("found_id"), F.col("m.mismatched").alias("mismatched"))
    return observed.join(one, ["flowcell", "lane", barcode], "left")


def demux_stats(assigned: DataFrame) -> DataFrame:
    """(flowcell, lane, found_id, total, perfect, one_mismatch); the row without id counts the unknown."""
    return assigned.groupBy("flowcell", "lane", "found_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("mismatched") == 0).alias("perfect"), F.count_if(F.col("mismatched") == 1).alias("one_mismatch")
    )


def top_unknown(assigned: DataFrame, barcode: str, k: int = TOP_UNKNOWN) -> DataFrame:
    """The most frequent barcodes of each lane that no sample has, exactly; ties by the barcode."""
    counts = assigned.where(F.col("found_id").isNull() & F.col(barcode).isNotNull()).groupBy("flowcell", "lane", barcode).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("flowcell", "lane").orderBy(F.desc("n"), barcode)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
