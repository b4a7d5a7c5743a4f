"""Idempotent merge of partial results into the run tables.

A delta is a table with the columns of its target plus ``batch_id``, which
sorts by the time the batch was written. All pending batches merge in one job.
Keys are non-null.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableflow.operators.history import TABLES
from tableflow.operators.joins import as_typed, delta_keys, replace_rows, touched, unseen, untouched
from tableflow.operators.windows import latest_per_key
from tableflow.session import drop_path, list_names, path_exists

BATCH = "batch_id"

# How each run table merges: the rule, the key, and the column that tells which row came first.
RULES = {
    "pipeline_runs": ("insert", ["run_id"], "started_at"),
    "task_runs": ("insert", ["run_id", "task_name", "attempt"], "started_at"),
    "task_cache": ("insert", ["task_name", "fingerprint"], "created_at"),
    "task_fingerprints": ("latest", ["task_name"], "updated_at"),
    "task_lineage": ("replace", ["task_name"], None),
}


def first_per_key(delta: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key inside a delta: the first in ``order``, by a combining aggregate."""
    rest = [c for c in delta.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return delta.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*delta.columns)


def new_rows(target: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The delta rows an insert-if-absent would add."""
    return unseen(target, first_per_key(delta, keys, order), keys).select(*target.columns)


def insert_if_absent(
    target: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Add the rows whose key the target lacks; of several in the delta, the first in ``order``."""
    return target.unionByName(new_rows(target, delta, keys, order))


def newest_batch(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of each key's newest batch.

    The newest batch per key is a combining aggregate, joined back as one row
    per key, so a key with very many rows is never gathered.
    """
    if BATCH not in delta.columns:
        return delta
    newest = delta.groupBy(*keys).agg(F.max(BATCH).alias(BATCH))
    return delta.join(newest, [*keys, BATCH], "left_semi")


def replace_by_key(target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of a key are replaced by those of its newest batch."""
    return replace_rows(target, newest_batch(delta, keys), keys)


def upsert_latest(
    target: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Of every key in the delta the row greatest in ``order`` wins, whatever the batch order was.

    Target rows of keys that the delta does not touch stay as they are, however
    large the delta is.
    """
    rivals = touched(target, delta, keys).unionByName(delta.select(*target.columns))
    return untouched(target, delta, keys).unionByName(latest_per_key(rivals, keys, order))


def merge_conflicts(task_runs: DataFrame) -> DataFrame:
    """Runs of one task and attempt that were recorded with different outcomes.

    The merge keeps only one row of such a key, so the others would be lost.
    """
    return (
        task_runs.groupBy("run_id", "task_name", "attempt")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("status").alias("n_statuses"))
        .filter("n_statuses > 1")
    )


def join_shared_run(runs: DataFrame, worker_runs: DataFrame) -> DataFrame:
    """Rows of many workers under one run id: the run is entered once, first start wins."""
    return insert_if_absent(runs, worker_runs, ["run_id"], ["started_at", "module_path"])


def merge_table(name: str, target: DataFrame, delta: DataFrame) -> DataFrame:
    """The merged content of one run table."""
    rule, keys, when = RULES[name]
    if rule == "insert":
        return insert_if_absent(target, delta, keys, _order(delta, keys, when))
    if rule == "latest":
        return upsert_latest(target, delta, keys, [when, "fingerprint"])
    return replace_by_key(target, delta, keys)


def absorb(targets: Mapping[str, DataFrame], deltas: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Merge the deltas of all run tables. Doing it again changes nothing."""
    return {n: merge_table(n, t, deltas[n]) if n in deltas else t for n, t in targets.items()}


def absorb_folders(spark: SparkSession, base: str, pending_: str, out: str) -> dict[str, list[str]]:
    """Merge what waits for all run tables in one call: ``base`` and ``pending_`` have one folder per table.

    Every merged table is written plainly to its folder below ``out``, which
    has to be a new one; ``base`` and the batches are left alone, so a call
    that failed half way is simply made again. Answers the batches merged.
    """
    merged = {}
    for name, columns in TABLES.items():
        target = spark.read.schema(columns).parquet(f"{base}/{name}")
        batches = pending(spark, f"{pending_}/{name}")
        if batches:
            target = merge_table(name, target, read_deltas(spark, name, f"{pending_}/{name}", batches))
        target.write.parquet(f"{out}/{name}")
        merged[name] = batches
    return merged


def batch_id() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def write_delta(rows: DataFrame, folder: str, name: str | None = None) -> str:
    """Add one batch to the pending folder and return its name.

    A batch is one folder that Spark commits as a whole; batches never share a
    file, so no lock is needed.
    """
    name = name or batch_id()
    rows.write.parquet(f"{folder}/{BATCH}={name}")
    return name


def pending(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete batches that wait in a folder; Spark marks a folder as complete when it commits it."""
    names = [n.removeprefix(f"{BATCH}=") for n in list_names(spark, folder) if n.startswith(f"{BATCH}=")]
    return [n for n in names if path_exists(spark, f"{folder}/{BATCH}={n}/_SUCCESS")]


def read_deltas(spark: SparkSession, name: str, folder: str, batches: Sequence[str]) -> DataFrame:
    """The rows of some batches, with their batch name."""
    reader = spark.read.schema(f"{TABLES[name]}, {BATCH} string").option("basePath", folder)
    return reader.parquet(*[f"{folder}/{BATCH}={b}" for b in batches])


def store_bucketed(df: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int, dealt: bool = False) -> DataFrame:
    """Write a table to ``path`` in sorted buckets of its key, under a name in Spark's catalog.

    A join on the key then reads it bucket by bucket and shuffles the other
    side only. ``dealt`` says that the rows already come one bucket per task.
    """
    rows = df if dealt else df.repartition(buckets, *keys)
    writer = rows.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def merge_bucketed(name: str, target: DataFrame, delta: DataFrame, buckets: int) -> DataFrame:
    """As ``merge_table`` for a target stored by ``store_bucketed``: one scan of it, and no shuffle above that scan.

    The delta comes down to one row per key (or to its newest batches) and is
    dealt to the buckets, where it meets the rows of its keys.
    """
    rule, keys, when = RULES[name]
    columns = target.columns
    delta = as_typed(delta, target, keys)
    if rule == "replace":
        fresh = newest_batch(delta, keys).select(*columns).repartition(buckets, *keys)
        kept = target.hint("merge").join(delta_keys(delta, keys).hint("merge"), keys, "left_anti")
        return kept.select(*columns).unionByName(fresh)
    if rule == "insert":
        best = first_per_key(delta, keys, _order(delta, keys, when))
        old = target.select(*keys, F.struct(*columns).alias("old"))
    else:
        order = [when, "fingerprint"]
        best = latest_per_key(delta.select(*columns), keys, order)
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order]))
        old = target.select(*keys, F.struct(*columns).alias("old"), nth.alias("nth"))
    new = best.select(*keys, F.struct(*columns).alias("new"))
    both = old.hint("merge").join(new.hint("merge"), keys, "full")
    if rule == "insert":
        return both.select(F.coalesce("old", "new").alias("row")).select("row.*")
    later = F.struct(*[F.col(f"new.{c}") for c in order]) > F.struct(*[F.col(f"old.{c}") for c in order])
    row = F.when(F.col("old").isNull() | later, F.col("new")).otherwise(F.col("old"))
    return both.where("new IS NULL OR coalesce(nth, 1) = 1").select(row.alias("row")).select("row.*")


def compact(
    spark: SparkSession, name: str, table: str, folder: str, new_table: str, path: str, buckets: int
) -> list[str]:
    """Fold every pending batch of ``folder`` into a bucketed table, as a new one at ``path``; answers the batches folded.

    The result is a plain bucketed write to a folder that the caller names, so
    readers of the old table are not disturbed. The folded batches are dropped
    once it stands. With nothing pending nothing is written.
    """
    batches = pending(spark, folder)
    if not batches:
        return []
    delta = read_deltas(spark, name, folder, batches)
    merged = merge_bucketed(name, spark.table(table), delta, buckets)
    store_bucketed(merged, new_table, path, RULES[name][1], buckets, dealt=True)
    for b in batches:
        drop_path(spark, f"{folder}/{BATCH}={b}")
    return batches


def _order(delta: DataFrame, keys: Sequence[str], when: str) -> list[str]:
    """Oldest batch first, then the earliest row; the other columns settle ties."""
    first = [BATCH, when] if BATCH in delta.columns else [when]
    return first + [c for c in delta.columns if c not in keys and c not in first]
