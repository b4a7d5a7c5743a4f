"""Aggregations, top rows and set operations.

All aggregates here combine inside each task before the shuffle, so a group
that holds a third of the rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.functions import (
    as_date, cents, day_start, hour_of, matches, mean, modulo, money_sum, total,
)
from tableflow.operators.clean import clean_positive, equals, maybe_equals
from tableflow.operators.joins import is_small

# The statuses that count as a failure.
FAILURES = ["failed", "upstream_failed", "oom"]

def n_rows() -> Column:
    """Number of rows of a group."""
    return F.count(F.lit(1))



def daily_fares(trips: DataFrame) -> DataFrame:
    """Trips, fares, tips and mean total per day."""
    return trips.groupBy("trip_date").agg(
        n_rows().alias("trip_count"),
        money_sum(F.col("fare_amount")).alias("total_fare"),
        money_sum(F.col("tip_amount")).alias("total_tip"),
        cents(mean(F.col("total_amount"))).alias("avg_total"),
    )


def daily_revenue(trips: DataFrame) -> DataFrame:
    """Revenue and trips per day and payment type, over paid trips."""
    return (
        trips.filter(F.col("fare_amount") > 0)
        .groupBy(as_date(F.col("pickup_ts")).alias("trip_date"), "payment_type")
        .agg(total(F.col("total_amount")).alias("revenue"), n_rows().alias("trip_count"))
    )


def by_payment(trips: DataFrame) -> DataFrame:
    return trips.groupBy("payment_type").agg(
        n_rows().alias("trip_count"), money_sum(F.col("fare_amount")).alias("total_fare")
    )


def by_hour(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(hour_of(F.col(ts)).alias("hour")).agg(n_rows().alias("trip_count"))


def borough_day(trips: DataFrame, zones: DataFrame, small_bytes: int | None = None) -> DataFrame:
    """Trips and revenue per borough and day.

    Zones read from small tables are broadcast and trips are not shuffled
    before the aggregate. Otherwise trips are summed per zone and day first,
    so that a busy zone joins as one row per day.
    """
    zone = zones.select(F.col("location_id").alias("pu_location_id"), "borough")
    day = day_start(F.col("pickup_ts")).alias("day")
    count, fare = n_rows().alias("trips"), F.col("fare_amount")
    if is_small(zone, small_bytes):
        found = trips.join(F.broadcast(zone), "pu_location_id")
        return found.groupBy("borough", day).agg(count, money_sum(fare).alias("revenue"))
    cells = trips.groupBy("pu_location_id", day).agg(count, total(fare).alias("fare"))
    return (
        cells.join(zone, "pu_location_id")
        .groupBy("borough", "day")
        .agg(
            F.sum("trips").alias("trips"),
            money_sum(F.col("fare")).alias("revenue"),
        )
    )


def daily_totals(trips: DataFrame) -> DataFrame:
    """Day totals. The one column that is not aggregated is the key."""
    return trips.groupBy(as_date(F.col("pickup_ts")).alias("trip_date")).agg(
        n_rows().alias("trip_count"), money_sum(F.col("fare_amount")).alias("total_fare")
    )


def payment_daily(trips: DataFrame, code: int | None = None) -> DataFrame:
    """Trips and revenue per payment type and day, for one type when a code is given."""
    paid = maybe_equals(clean_positive(trips, ["fare_amount"]), "payment_type", code)
    return paid.groupBy("payment_type", as_date(F.col("pickup_ts")).alias("trip_date")).agg(
        n_rows().alias("trip_count"), money_sum(F.col("fare_amount")).alias("total_revenue")
    )


def totals(df: DataFrame, count: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Totals over an aggregate: its rows, the sum of a count and of an amount."""
    return df.groupBy(*keys).agg(
        n_rows().alias("n_rows"),
        F.sum(count).cast("bigint").alias("total_trips"),
        money_sum(F.col(value)).alias("total_revenue"),
    )


def borough_totals(daily: DataFrame) -> DataFrame:
    """Borough × day to borough, rounded once at the end."""
    return daily.groupBy("borough").agg(money_sum(F.col("revenue")).alias("revenue"))


def first_max(value: str, key: str) -> Column:
    """Key of the greatest value; of equal values the smallest key, as the first in key order. NULL is no value."""
    return F.min_by(key, F.when(F.col(value).isNotNull(), F.struct(-F.col(value), F.col(key))))


def best_row(df: DataFrame, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(first_max(value, key).alias(key), F.max(value).alias(value))


def tally(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def failed(status: str = "status") -> Column:
    return F.col(status).isin(FAILURES)


def status_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        tally(F.col("status") == "success").alias("succeeded_count"),
        tally(F.col("status") == "skipped").alias("skipped_count"),
        tally(failed()).alias("failed_count"),
    )


def key_stats(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """Runs, mean and longest duration, and last end per key, with further aggregates."""
    return df.groupBy(key).agg(
        n_rows().alias("runs"),
        mean(F.col("duration_ms")).alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"),
        F.max("ended_at").alias("last_run_at"),
        *more,
    )


def measures(trips: DataFrame, value: str) -> DataFrame:
    """Two filtered counts and a mean, in one pass."""
    return trips.agg(
        tally(F.col("payment_type") == 1).alias("card_trips"),
        tally(F.col("payment_type") == 2).alias("cash_trips"),
        mean(F.col(value)).alias("mean_value"),
    )


def bucket_sums(df: DataFrame, col: str, divisor: int) -> DataFrame:
    """Count and sum of every remainder, in one group-by."""
    return df.groupBy(modulo(F.col(col), divisor).alias("bucket")).agg(
        n_rows().alias("n"), F.sum(F.col(col).cast("decimal(20,0)")).cast("bigint").alias("total")
    )


def non_null(df: DataFrame) -> DataFrame:
    """Non-null count of every column, as one row."""
    return df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])


def match_ratios(df: DataFrame, patterns: Mapping[str, str], cols: Sequence[str]) -> DataFrame:
    """Non-null count and pattern matches of every column: one scan, one row of counts.

    Answers one row per column and pattern.
    """
    aggs = []
    for i, c in enumerate(cols):
        value = F.col(f"`{c}`")
        aggs.append(F.count(value).alias(f"n{i}"))
        aggs += [F.count_if(matches(value, p)).alias(f"m{i}_{j}") for j, p in enumerate(patterns.values())]
    found = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(i).alias("position"),
            F.lit(label).alias("pattern"),
            F.col(f"n{i}").alias("non_null"),
            F.col(f"m{i}_{j}").alias("matches"),
        )
        for i, c in enumerate(cols)
        for j, label in enumerate(patterns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*found)))


def upstream_list(edges: DataFrame) -> DataFrame:
    """One sorted list of upstream names for each task; it holds no more names than there are tasks."""
    return edges.distinct().groupBy("task_name").agg(F.sort_array(F.collect_list("upstream_task_name")).alias("depends_on"))


def partition_count(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.countDistinct(col).alias("partitions"))


def ordered(df: DataFrame, *cols: str) -> DataFrame:
    return df.orderBy(*cols)


def recent(df: DataFrame, ts: str, n: int = 20, tie: str | None = None) -> DataFrame:
    """The newest ``n`` rows: a top-k per task, not a full sort."""
    return df.orderBy(F.desc(ts), *([F.col(tie)] if tie else [])).limit(n)


def slowest(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("avg_duration_ms"), "task_name")


def last_status(df: DataFrame, task: str) -> DataFrame:
    """Status and end of the newest run of one task."""
    return recent(equals(df, "task_name", task), "ended_at", 1).select("status", "ended_at")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)
