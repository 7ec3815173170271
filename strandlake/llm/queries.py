"""Queries pN_ over the documents, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, packing, splitting
from strandlake.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    """Registers a query under its own name; the docstring of the function says what it gives."""
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids of all documents decode to."""
    return bpe.decode_corpus(p6_ids(spark, sf_dir), "doc_id", "ids")


SQL["p6_texts"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def _budget(spark: SparkSession, sf_dir: str, name: str) -> int:
    """A size in tokens from the fixed table of budgets."""
    return table(spark, sf_dir, "token_budget").where(F.col("budget_name") == name).agg(F.max("tokens")).first()[0]


@query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of a document larger than a container."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", _budget(spark, sf_dir, "container"))


@query
def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    size, overlap = _budget(spark, sf_dir, "piece"), _budget(spark, sf_dir, "overlap")
    return splitting.split(table(spark, sf_dir, "documents"), "doc_id", "text", size, overlap)


@query
def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the pieces of all documents put together again, without what they share."""
    own = F.expr("substring(text, overlap_chars + 1)")
    pieces = p8_pieces(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("p"))
    return pieces.select("doc_id", F.array_join(F.transform("p", lambda x: x["own"]), "").alias("text"))


SQL["p8_texts"] = "SELECT doc_id, text FROM documents WHERE text <> ''"


@query
def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is wrong with its places: gaps or repeats, a split below the capacity, a container too full."""
    capacity = _budget(spark, sf_dir, "container")
    rows = p7_containers(spark, sf_dir)
    full = rows.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    each = rows.join(full, "container").groupBy("doc_id").agg(
        (F.sum("n_tokens") != F.max(F.col("start_token") + F.col("n_tokens"))).alias("broken"),
        ((F.count(F.lit(1)) > 1) & (F.sum("n_tokens") <= capacity)).alias("split_below_capacity"),
        F.bool_or(F.col("held") > capacity).alias("overfull"),
    )
    return each


SQL["p7_placed"] = "SELECT doc_id, FALSE AS broken, FALSE AS split_below_capacity, FALSE AS overfull FROM documents"
