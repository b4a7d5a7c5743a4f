"""The end-to-end jobs, each a composition of operators over the shipped tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.functions import as_date, label_of, money_sum, slug, total
from tableflow.operators import aggregates as agg
from tableflow.operators.clean import clean_positive, drop_null, exclude_values, in_range, pipe, project
from tableflow.operators.joins import with_zone
from tableflow.operators.windows import rolling_mean
from tableflow.plans import fixtures as fx
from tableflow.session import list_names, new_path
from tableflow.sources import (
    export_extract,
    materialize,
    partition_manifest,
    read_csv,
    read_table,
    read_union,
    replace_table,
    rows_to_json,
    write_csv,
    write_partitions,
)

# Payment labels. Code 5 has none here, so that the default occurs.
PAYMENT_LABELS = {1: "Credit card", 2: "Cash", 3: "No charge", 4: "Dispute", 6: "Voided trip"}

# Regions that stand for the boroughs a report leaves out.
LEFT_OUT = ["AFRICA", "ASIA"]

MEASURES = ["fare_amount", "trip_distance", "passenger_count"]


def load_daily_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract, clean, and load one row per day into a table, from which it is read."""
    name = "daily_fares_" + uuid.uuid4().hex[:8]
    return agg.ordered(replace_table(daily_fares(spark, sf_dir), name, new_path(spark, "daily-fares")), "trip_date")


def daily_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cleaned row per day."""
    return pipe(
        fx.trips(spark, sf_dir),
        lambda t: clean_positive(t, MEASURES),
        lambda t: project(
            t,
            {
                "trip_date": as_date(F.col("pickup_ts")),
                "fare_amount": "fare_amount",
                "tip_amount": "tip_amount",
                "total_amount": "total_amount",
            },
        ),
        agg.daily_fares,
        lambda t: agg.ordered(t, "trip_date"),
    )


def borough_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boroughs with at least one trip. Trips shrink to their distinct zones before the join."""
    used = fx.trips(spark, sf_dir).select(F.col("pu_location_id").alias("location_id")).distinct()
    found = fx.zones(spark, sf_dir).join(used, "location_id", "left_semi")
    return agg.distinct_values(exclude_values(found, "borough", LEFT_OUT), "borough")


def write_boroughs(spark: SparkSession, sf_dir: str) -> str:
    """All trips in one folder per borough, in one pass over the source."""
    zones = exclude_values(fx.zones(spark, sf_dir), "borough", LEFT_OUT)
    zones = zones.select("location_id", slug(F.col("borough")).alias("borough"))
    return write_partitions(with_zone(fx.trips(spark, sf_dir), zones), "borough", new_path(spark, "boroughs"))


def borough_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_manifest(spark, write_boroughs(spark, sf_dir), "borough")


def borough_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.partition_count(borough_manifest(spark, sf_dir), "borough")


def rolling_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue, written once, then its mean over three rows and a label.

    A payment type has one row per calendar day here, so a plain window is
    safe (``max_group=None``).
    """
    daily, _ = materialize(agg.daily_revenue(fx.order_trips(spark, sf_dir)))
    rolled = rolling_mean(daily, "payment_type", "trip_date", "revenue", 3, "revenue_3d_avg", max_group=None)
    shown = rolled.withColumn("revenue", F.round("revenue", 4)).withColumn("revenue_3d_avg", F.round("revenue_3d_avg", 4))
    return shown.withColumn("payment_type_label", label_of(F.col("payment_type"), PAYMENT_LABELS))


def revenue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling report as CSV, and what a reader of that file finds per label."""
    rolled = rolling_revenue(spark, sf_dir)
    path = write_csv(rolled, new_path(spark, "report"))
    return read_csv(spark, path, rolled.schema).groupBy("payment_type_label").agg(agg.n_rows().alias("n_rows"))


def payment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.ordered(agg.by_payment(fx.order_trips(spark, sf_dir)), "payment_type")


def hour_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.ordered(agg.by_hour(fx.table(spark, sf_dir, "events"), "ts"), "hour")


def combined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the two aggregates, side by side."""
    payments = agg.by_payment(fx.order_trips(spark, sf_dir)).agg(agg.n_rows().alias("n"))
    hours = agg.by_hour(fx.table(spark, sf_dir, "events"), "ts").agg(agg.n_rows().alias("by_hour_rows"))
    return hours.select(payments.scalar().alias("by_payment_type_rows"), "by_hour_rows")


def day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.daily_totals(clean_positive(fx.trips(spark, sf_dir), ["fare_amount", "trip_distance"]))


def payment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pay = agg.by_payment(fx.order_trips(spark, sf_dir))
    return agg.totals(pay, "trip_count", "total_fare").select(
        F.col("n_rows").alias("payment_types"), F.col("total_revenue").alias("total_fare")
    )


def payment_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card and cash, per day, in one grouped job."""
    chosen = fx.order_trips(spark, sf_dir).filter(F.col("payment_type").isin(1, 2))
    return agg.payment_daily(chosen)


def card_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card report alone."""
    return agg.payment_daily(fx.order_trips(spark, sf_dir), 1)


def payment_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and best day of the card and the cash report."""
    daily = payment_days(spark, sf_dir)
    return daily.groupBy("payment_type").agg(
        F.sum("trip_count").cast("bigint").alias("total_trips"),
        money_sum(F.col("total_revenue")).alias("total_revenue"),
        agg.first_max("total_revenue", "trip_date").alias("best_day"),
    )


def payment_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rows of each report as one JSON array: one entry per calendar day."""
    daily = payment_days(spark, sf_dir).select("payment_type", "trip_date", "trip_count", "total_revenue")
    return rows_to_json(daily, "trip_date", ["payment_type"])


def three_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.measures(fx.order_trips(spark, sf_dir), "fare_amount")
    return found.withColumn("mean_value", F.round("mean_value", 6))


def borough_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of the whole table to borough × day."""
    trips = clean_positive(fx.trips(spark, sf_dir), ["fare_amount", "trip_distance"])
    return agg.borough_day(drop_null(trips, ["pu_location_id"]), fx.zones(spark, sf_dir))


def borough_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals and the borough that earned most.

    Borough × day comes down to boroughs first, then to the one row.
    """
    return report_of(borough_days(spark, sf_dir))


def report_of(days: DataFrame) -> DataFrame:
    """The one row of a borough × day table."""
    per_borough = days.groupBy("borough").agg(
        agg.n_rows().alias("n"),
        F.sum("trips").alias("trips"),
        total(F.col("revenue")).alias("revenue"),
    )
    return per_borough.agg(
        F.sum("n").cast("bigint").alias("day_borough_rows"),
        F.sum("trips").cast("bigint").alias("total_trips"),
        money_sum(F.col("revenue")).alias("total_revenue"),
        agg.first_max("revenue", "borough").alias("top_borough_by_revenue"),
    )


def year_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borough × day over many files read as one table, reported with the number of files: one file for each month."""
    trips = fx.trips(spark, sf_dir).withColumn("month", F.month("pickup_ts"))
    root = new_path(spark, "months")
    trips.repartition("month").write.partitionBy("month").parquet(root)
    paths = [f"{root}/{name}" for name in list_names(spark, root)]
    cleaned = clean_positive(read_union(spark, paths), ["fare_amount", "trip_distance"])
    days = agg.borough_day(drop_null(cleaned, ["pu_location_id"]), fx.zones(spark, sf_dir))
    return report_of(days).withColumn("sources", F.lit(len(paths)))


def extract_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a period, a fixed sample of them, copied to a file and read again."""
    orders = fx.table(spark, sf_dir, "orders")
    lo, hi = (F.to_timestamp_ntz(F.lit(day)) for day in ("1996-01-01", "1999-01-01"))
    where = (F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)
    path = export_extract(orders, where, 2000, "o_orderkey", new_path(spark, "extract"))
    return read_table(spark, path)


def ranged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = (F.to_timestamp_ntz(F.lit(day)) for day in ("1996-01-01", "1997-01-01"))
    return in_range(fx.table(spark, sf_dir, "orders"), "o_orderdate", lo, hi)
