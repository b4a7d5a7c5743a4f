"""Writing tables and handing small results on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.session import new_path, write_counted
from tableflow.sources.scan import sample_rows

# Fixed value: cached results above this size are reported as large.
LARGE_CACHE_BYTES = 50 * 1024 * 1024


def write_table(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def replace_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """Create or replace a warehouse table kept at ``path``."""
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header, doubled quotes, and every blank kept."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def export_extract(df: DataFrame, where: Column, n: int, key: str, path: str) -> str:
    """Filter, draw a fixed sample, and copy it to a file."""
    return write_table(sample_rows(df.filter(where), n, key), path)


def write_partitions(df: DataFrame, col: str, path: str, rebalance: bool = False) -> str:
    """One folder per value of ``col``, in one pass.

    For a few values nothing is shuffled: each task writes its rows of each
    value, so a value with much of the data is spread over all tasks. For many
    values set ``rebalance``: adaptive execution then merges small values into
    one file each and splits large ones.
    """
    out = df.hint("rebalance", col) if rebalance else df
    out.write.mode("overwrite").partitionBy(col).parquet(path)
    return path


def partition_manifest(spark: SparkSession, path: str, col: str) -> DataFrame:
    """Rows and folder of each value written by ``write_partitions``; the folder is that of the files themselves.

    Rows are counted per file from the footers, no data column is read, and a
    file's folder is decoded once.
    """
    file = F.col("_metadata.file_path").alias("file")
    files = spark.read.parquet(path).groupBy(col, file).agg(F.count(F.lit(1)).alias("n"))
    name = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(name, "([^/]*)/[^/]*$", 1).alias("path")
    return files.groupBy(col, folder).agg(F.sum("n").alias("rows")).select(col, "rows", "path")


def materialize(df: DataFrame, path: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Write a mid-job result and go on from the written table.

    Returns the table and its rows and bytes. The plan above is cut: a lost
    executor re-reads files, it does not recompute what made them.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "mid")
    rows = write_counted(df, path)["rows"]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(target).getLength()
    table = spark.read.schema(df.schema).parquet(path)
    return table, {"rows": rows, "bytes": size, "large": size > LARGE_CACHE_BYTES}


def export_arrow(df: DataFrame, max_rows: int | None = None) -> pa.Table:
    """A result as an Arrow table. With ``max_rows`` a larger one is refused, not cut off."""
    if max_rows is None:
        return df.toArrow()
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise ValueError(f"more than {max_rows} rows: write a table instead")
    return table


def import_arrow(spark: SparkSession, table: pa.Table, schema: T.StructType | None = None) -> DataFrame:
    return spark.createDataFrame(table, schema) if schema else spark.createDataFrame(table)


def rows_to_json(df: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """Rows of an aggregate as one JSON array per key, in the order of a column.

    For report rows (one per day and the like): an array is one cell, so it
    has to fit the memory of a task.
    """
    keys = keys or []
    values = [c for c in df.columns if c not in keys]
    row = F.struct(order, *[c for c in values if c != order])
    names = ", ".join(f"'{c}', r.`{c}`" for c in values)
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    ordered = F.expr(f"to_json(transform(rows, r -> named_struct({names})))")
    return packed.withColumn("rows_json", ordered).drop("rows")
