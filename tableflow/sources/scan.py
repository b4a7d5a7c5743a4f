"""Reading tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.sources.split_csv import largest_file, read_split


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Lazy Parquet scan; with ``columns`` only those reach the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_union(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """Many Parquet files as one table, by column name; a missing column is NULL.

    Files whose columns agree in type are one scan. Types that differ between
    files widen (bigint and double to double), with one scan per schema; the
    schema of each path is then read by itself. With a schema each file is cast
    to it.
    """
    try:
        # One job reads all footers on the executors, however many files there are.
        parts = [spark.read.option("mergeSchema", True).parquet(*paths)]
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE" not in str(error):
            raise
        kinds: dict[str, list[str]] = {}
        for path in paths:
            kinds.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
        parts = [spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(*same) for kind, same in kinds.items()]
    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        parts = [
            part.select(*[(F.col(f"`{f.name}`") if f.name in part.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
            for part in parts
        ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, line_breaks: bool = True, split_bytes: int | None = None
) -> DataFrame:
    """CSV with a header and doubled quotes. The schema is given, so the file is read once.

    Fields may hold line breaks. Spark then reads a file with one task, so a
    folder with a file above ``split_bytes`` (by default the most a task reads
    of other formats) is read by byte range instead, with the same rows; one
    with partition folders is not. Files without such breaks are split by
    Spark itself when ``line_breaks`` is off.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = spark.read.schema(fields).option("header", True).option("escape", '"').option("multiLine", line_breaks).csv(path)
    if not line_breaks or len(plain.columns) > len(fields):
        return plain
    if split_bytes is None:
        split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return read_split(spark, path, fields) if largest_file(spark, path) > split_bytes else plain


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Pick the reader by the ending of the path. The cells of a CSV without a schema are text."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        if schema is None:  # the names come from the first row of one file
            schema = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).schema
        return read_csv(spark, path, schema)
    if kind in ("parquet", "json", "orc"):
        reader = spark.read.format(kind)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    raise ValueError(f"no reader for {path!r}")


def project_scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return read_table(spark, path, columns)


def range_table(spark: SparkSession, n: int, name: str = "x") -> DataFrame:
    return spark.range(n).toDF(name)


def literal_rows(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def rows_from_json(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Turn a column with a JSON array of objects into rows."""
    parsed = F.from_json(F.col(col), f"array<struct<{schema}>>")
    return df.select(F.inline(parsed))


def describe_table(df: DataFrame) -> DataFrame:
    """One row per column: name, type, position. Reads no data."""
    rows = [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string, position int")


def sample_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """A fixed random sample: exactly the ``n`` rows whose key hashes lowest. The key must be unique.

    Two scans and no job of its own. The first counts rows per bucket, the
    first four hex digits of the hash, which adds up within each task; the
    counts tell the bucket where the ``n``-th row lies. The second reads the
    rows up to that bucket, some ``n`` of them, and ranks them bucket by
    bucket, so no task sorts more than a 65,536th of the table.
    """
    digest = F.md5(F.col(key).cast("string"))
    bucket = F.substring(digest, 1, 4)
    counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("b"))  # over at most 65,536 counts
    edge = counts.select("b", (F.lit(n) - upto + F.col("c")).alias("left"), upto.alias("upto")).where(F.col("upto") >= n)
    edge = edge.agg(F.min(F.struct("b", "left")).alias("edge")).scalar()
    rows = df.select(F.struct(*df.columns).alias("row"), bucket.alias("b"), digest.alias("h"))
    rows = rows.where(F.coalesce(F.col("b") <= edge["b"], F.lit(True)))
    nth = F.row_number().over(Window.partitionBy("b").orderBy("h", F.col(f"row.{key}")))
    kept = rows.withColumn("nth", nth).where(F.coalesce((F.col("b") < edge["b"]) | (F.col("nth") <= edge["left"]), F.lit(True)))
    return kept.select("row.*")
