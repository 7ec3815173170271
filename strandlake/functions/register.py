"""SQL names for the engine's functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators import kernels, rescue

#: Functions that are plain SQL expressions, by name: parameters and body.
SQL_FUNCTIONS = {
    "reverse_complement": ("s STRING", "STRING", "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))"),
    "pack_kmer": ("s STRING", "BIGINT", "CASE WHEN s RLIKE '^[ACGT]{1,31}$' THEN CAST(conv(translate(s, 'ACGT', '0123'), 4, 10) AS BIGINT) END"),
    "packed_mismatches": ("a BIGINT, b BIGINT", "INT", "bit_count(((a ^ b) | shiftright(a ^ b, 1)) & 6148914691236517205)"),
    "bam_bin": (
        "a BIGINT, e BIGINT", "BIGINT",
        "CASE WHEN shiftright(a, 14) = shiftright(e - 1, 14) THEN 4681 + shiftright(a, 14) WHEN shiftright(a, 17) = shiftright(e - 1, 17) THEN 585 + shiftright(a, 17)"
        " WHEN shiftright(a, 20) = shiftright(e - 1, 20) THEN 73 + shiftright(a, 20) WHEN shiftright(a, 23) = shiftright(e - 1, 23) THEN 9 + shiftright(a, 23)"
        " WHEN shiftright(a, 26) = shiftright(e - 1, 26) THEN 1 + shiftright(a, 26) ELSE 0 END",
    ),
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions, Arrow kernels and table functions of a session."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("banded_sw", kernels.banded_sw)
    spark.udf.register("rescue_mate", rescue.rescue_mate)

    @F.udtf(returnType=T.StructType([T.StructField("i", T.IntegerType()), T.StructField("kmer", T.StringType())]))
    class Kmers:
        """The k-mers of a sequence without other letters."""

        def eval(self, seq: str, k: int) -> Iterator[tuple]:
            for i in range(len(seq or "") - k + 1):
                if not set(seq[i : i + k]) - set("ACGT"):
                    yield i, seq[i : i + k]

    spark.udtf.register("kmers", Kmers)
