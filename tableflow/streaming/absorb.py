"""Pending deltas as a file stream, with the winning rows kept as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.history import TABLES
from tableflow.operators.joins import delta_keys
from tableflow.operators.merge import BATCH, RULES, _order, merge_table

EPOCH = "epoch"


def _winner(name: str, rows: DataFrame) -> DataFrame:
    """One row per key that does not depend on the order in which batches arrive.

    The earliest row, the latest row, or the newest batch, as the table's rule
    has it: an aggregate whose state is one row per key.
    """
    rule, keys, when = RULES[name]
    if rule == "replace":
        return rows.groupBy(*keys).agg(F.max(BATCH).alias(BATCH))
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    if rule == "insert":
        best = F.min_by(rest, F.struct(*_order(rows, keys, when)))
    else:
        best = F.max_by(rest, F.struct(when, "fingerprint"))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def absorb_stream(
    spark: SparkSession, name: str, folder: str, out: str, checkpoint: str, files_per_trigger: int = 1000
) -> None:
    """Run all pending deltas of one run table through the stream, then stop.

    The state store holds the winning row of every key; the checkpoint holds
    the state and the files already read. An epoch's changed winners go to
    their own folder below ``out`` by a plain write that replaces what a failed
    attempt at the same epoch left, so every delta counts once. Start it again
    with the same checkpoint to take what came since.
    """
    rows = spark.readStream.schema(f"{TABLES[name]}, {BATCH} string").option("basePath", folder)
    winners = _winner(name, rows.option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{BATCH}=*"))

    def write(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/{EPOCH}={epoch}")

    query = winners.writeStream.outputMode("update").foreachBatch(write)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_winners(spark: SparkSession, name: str, out: str) -> DataFrame:
    """What the stream holds: of every key the row of its last epoch."""
    keys = RULES[name][1]
    columns = f"{TABLES[name]}, {BATCH} string" if RULES[name][0] != "replace" else f"{', '.join(f'{k} string' for k in keys)}, {BATCH} string"
    schema = T.StructType(T.StructType.fromDDL(columns).fields + [T.StructField(EPOCH, T.IntegerType())])
    rows = spark.read.schema(schema).option("basePath", out).parquet(out)
    rest = F.struct(*[c for c in rows.columns if c not in (*keys, EPOCH)])
    return rows.groupBy(*keys).agg(F.max_by(rest, EPOCH).alias("_row")).select(*keys, "_row.*")


def read_absorbed(spark: SparkSession, name: str, target: DataFrame, folder: str, out: str) -> DataFrame:
    """``target`` with everything the stream has taken merged in.

    For a table whose rows replace each other by batch the state holds only
    the newest batch of a key; its rows are read from the batches themselves.
    """
    winners = read_winners(spark, name, out)
    if RULES[name][0] == "replace":
        schema = f"{TABLES[name]}, {BATCH} string"
        rows = spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/{BATCH}=*")
        winners = rows.join(delta_keys(winners, [*RULES[name][1], BATCH]), [*RULES[name][1], BATCH], "left_semi")
    return merge_table(name, target, winners)
