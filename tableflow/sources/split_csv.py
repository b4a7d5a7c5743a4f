"""Large CSV files whose quoted fields hold line breaks, read by many tasks.

Whether a line break ends a row depends on the quotes before it, back to the
start of the file. So lines are read by byte range, as text; within a range
both cases are followed, a range that begins inside a field and one that does
not. The quotes of whole ranges, a few bytes each, then tell which case holds,
and lines come together as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.session import new_path

RANGE = ["file", "block"]


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file below ``path``; executors list them, none is opened."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def read_split(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of UTF-8 CSV files with a header each, split among tasks by byte range.

    A quote stands only around fields or doubled within them. Rows end with a
    line feed, a carriage return before it goes. Empty lines between rows are
    left out. Equal to Spark's reader with ``multiLine``; the lines are shuffled
    and written once, sorted within their range.
    """
    lines = _kept(_lines(spark, path), "csv-lines")
    ranges = _kept(_ranges(lines), "csv-ranges")  # one row per byte range: written, so its size is known to the join
    own = F.when(F.col("inside") == 0, F.col("even_start")).otherwise(F.col("odd_start"))
    placed = lines.join(ranges, RANGE).withColumn("own", own)
    alone = F.col("own").eqNullSafe(F.col("line")) & (F.col("odd") == 0)
    single = placed.where(alone & ~F.col("header")).select("value")
    start = F.when(F.col("own").isNotNull(), F.struct("block", F.col("own").alias("line"))).otherwise(F.col("carried"))
    several = (
        placed.where(~alone)
        .groupBy("file", start.alias("start"))
        .agg(F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
        .where(~F.col("header"))
        .select(F.array_join("parts.value", "\n").alias("value"))
    )
    rows = single.unionByName(several).select(F.regexp_replace("value", r"\r\z", "").alias("value")).where("value != ''")
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"escape": '"', "multiLine": "true", "lineSep": "\n"}
    return rows.select(F.from_csv("value", kinds, options).alias("row")).select("row.*")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with the last line up to it that begins a row, should its range begin outside a field or inside one."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    quotes = F.octet_length("value") - F.octet_length(F.translate("value", '"', ""))
    upto = Window.partitionBy(*RANGE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    filled = ~F.col("value").isin("", "\r")
    return (
        text.withColumn("odd", (quotes % 2).cast("int"))
        .withColumn("before", (F.sum("odd").over(upto) - F.col("odd")) % 2)
        .withColumn("header", (F.col("block") == 0) & filled & (F.count_if(filled).over(upto) == 1))
        .withColumn("even_start", F.max(F.when(F.col("before") == 0, F.col("line"))).over(upto))
        .withColumn("odd_start", F.max(F.when(F.col("before") == 1, F.col("line"))).over(upto))
        .drop("before")
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """Per byte range: whether it begins inside a field, and the last row start in the ranges before it."""
    sums = lines.groupBy(*RANGE).agg(
        F.sum("odd").alias("odd"), F.max("even_start").alias("even_last"), F.max("odd_start").alias("odd_last")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("inside") == 0, F.col("even_last")).otherwise(F.col("odd_last"))
    last = F.when(own.isNotNull(), F.struct("block", own.alias("line")))
    return (
        sums.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
        .withColumn("carried", F.last(last, ignorenulls=True).over(earlier))
        .select(*RANGE, "inside", "carried")
    )


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
