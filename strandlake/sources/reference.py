"""Tables of an indexed reference: written once, read with pruning; their merge and their XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases of a k-mer that name its partition.
PREFIX = 3


def write_index(index: DataFrame, path: str, files: int | None = None) -> None:
    """The k-mer index as parquet, ranged and sorted by k-mer within folders of its prefix."""
    rows = index.withColumn("prefix", F.substring("kmer", 1, PREFIX))
    rows = rows.repartitionByRange(files, "kmer") if files else rows.repartitionByRange("kmer")
    rows.sortWithinPartitions("kmer").write.mode("overwrite").partitionBy("prefix").parquet(path)


def read_index(spark: SparkSession, path: str, prefixes: list[str] | None = None) -> DataFrame:
    """The index, or only the folders of some prefixes."""
    rows = spark.read.parquet(path)
    return (rows.where(F.col("prefix").isin(prefixes)) if prefixes else rows).drop("prefix")


def merge_contigs(parts: list[DataFrame], keys: tuple = ("contig",)) -> DataFrame:
    """One contig table of several partial ones, whose rows for a contig must be equal."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.distinct()
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    checked = rows.join(n, list(keys))
    wrong = F.raise_error(F.concat_ws(" ", F.lit("parts differ in contig"), *(F.col(k).cast("string") for k in keys)))
    return checked.withColumn("__n", F.when(F.col("__n") > 1, wrong.cast("long")).otherwise(F.col("__n"))).where("__n = 1").drop("__n")


def write_reference_xml(contigs: DataFrame, path: str) -> None:
    """Contigs as XML; a genome has few of them, hence one file."""
    contigs.coalesce(1).write.mode("overwrite").format("xml").option("rootTag", "SortedReference").option("rowTag", "Contig").save(path)


def read_reference_xml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Contig").schema(schema).load(path)
