"""Run-history views over the run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.functions import elapsed_ms
from tableflow.operators.aggregates import failed, key_stats, recent, slowest, tally, upstream_list
from tableflow.operators.joins import left_rollup
from tableflow.operators.windows import latest_per_key

# The run tables and their columns.
TABLES = {
    "pipeline_runs": "run_id string, module_path string, started_at timestamp_ntz,"
    " ended_at timestamp_ntz, status string",
    "task_runs": "run_id string, task_name string, status string, started_at timestamp_ntz,"
    " ended_at timestamp_ntz, duration_ms double, error string, fingerprint string, attempt int",
    "task_fingerprints": "task_name string, fingerprint string, updated_at timestamp_ntz",
    "task_lineage": "task_name string, upstream_task_name string",
    "task_cache": "task_name string, fingerprint string, backend string, path string,"
    " n_rows bigint, size_bytes bigint, created_at timestamp_ntz",
}


def latest_status(task_runs: DataFrame, tie: str = "run_id") -> DataFrame:
    """The newest run of every task; equal end times go by ``tie``."""
    return latest_per_key(task_runs, ["task_name"], ["ended_at", tie])


def run_summary(pipeline_runs: DataFrame, task_runs: DataFrame) -> DataFrame:
    """Every run with its task, success, skip and failure counts."""
    counts = [
        F.count("task_name").alias("task_count"),
        tally(F.col("status") == "success").alias("succeeded_count"),
        tally(F.col("status") == "skipped").alias("skipped_count"),
        tally(failed()).alias("failed_count"),
    ]
    return left_rollup(pipeline_runs, task_runs, "run_id", counts).na.fill(
        0, ["task_count", "succeeded_count", "skipped_count", "failed_count"]
    )


def task_stats(task_runs: DataFrame) -> DataFrame:
    """Runs, durations, skips, failures and last end per task, in one pass."""
    return key_stats(
        task_runs,
        "task_name",
        tally(F.col("status") == "skipped").alias("skipped_count"),
        tally(failed()).alias("failed_count"),
    )


def recent_runs(pipeline_runs: DataFrame, n: int = 20) -> DataFrame:
    return recent(pipeline_runs, "started_at", n, tie="run_id")


def slowest_tasks(task_runs: DataFrame) -> DataFrame:
    return slowest(task_stats(task_runs)).select(
        "task_name", "runs", "avg_duration_ms", "max_duration_ms", "skipped_count", "failed_count"
    )


def run_outcome(task_runs: DataFrame) -> DataFrame:
    """``success`` for a run without any failure, else ``failed``."""
    good = F.bool_and(~failed())
    return task_runs.groupBy("run_id").agg(F.when(good, "success").otherwise("failed").alias("outcome"))


def append_task_runs(events: DataFrame) -> DataFrame:
    """Outcome rows with the duration worked out from start and end."""
    return events.withColumn("duration_ms", elapsed_ms(F.col("started_at"), F.col("ended_at")))


def close_runs(pipeline_runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Set end and status of the runs named in ``outcomes`` (run_id, ended_at, status)."""
    done = outcomes.select(
        "run_id", F.col("ended_at").alias("_ended"), F.col("status").alias("_status")
    )
    return pipeline_runs.join(done, "run_id", "left").select(
        *[c for c in pipeline_runs.columns if c not in ("ended_at", "status")],
        F.coalesce("_ended", "ended_at").alias("ended_at"),
        F.coalesce("_status", "status").alias("status"),
    )


def unclosed_runs(pipeline_runs: DataFrame, task_runs: DataFrame) -> DataFrame:
    """Runs still marked running, with the outcome their tasks show so far."""
    is_open = pipeline_runs.filter(F.col("status") == "running").select("run_id", "started_at")
    seen = task_runs.groupBy("run_id").agg(
        F.when(F.bool_and(~failed()), "success").otherwise("failed").alias("outcome"),
        F.max("ended_at").alias("last_task_end"),
    )
    return is_open.join(seen, "run_id", "left")


def task_adjacency(lineage: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Every task with its sorted upstreams; a task without any has an empty list."""
    lists = upstream_list(lineage)
    every = lineage.select("task_name").union(lineage.select("upstream_task_name"))
    if nodes is not None:
        every = every.union(nodes.select("task_name"))
    none = F.array().cast("array<string>")
    return every.distinct().join(lists, "task_name", "left").select(
        "task_name",
        F.coalesce(F.col("depends_on").cast("array<string>"), none).alias("depends_on"),
    )
