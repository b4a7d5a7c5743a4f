"""What changed between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that ``right`` adds to or lacks from ``left``, with their number of copies: one aggregate over all columns."""
    signed = left.withColumn("_n", F.lit(-1)).unionByName(right.withColumn("_n", F.lit(1)))
    return (
        signed.groupBy(*left.columns)
        .agg(F.sum("_n").alias("_n"))
        .filter("_n <> 0")
        .withColumn("change", F.when(F.col("_n") > 0, "added").otherwise("removed"))
        .withColumn("copies", F.abs("_n"))
        .drop("_n")
    )
