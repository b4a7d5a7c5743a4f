"""Cost and energy of past runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.functions import as_date, memory_tier
from tableflow.operators.joins import with_scenarios

# Power per vCPU in kW at rest and at full load, memory that
# comes with one vCPU, list prices, overhead factors, and the standing node.
KW_MIN = 4.34e-4
KW_MAX = 1.948e-3
MB_PER_VCPU = 1769
USD_PER_GB_SECOND = 1.66667e-5
USD_PER_REQUEST = 0.20 / 1_000_000
SCENARIOS = {"hyperscale": 1.09, "industry avg": 1.54}
STANDING_VCPU = 4
STANDING_LOAD = 0.15
RUNS_PER_YEAR = 365


def with_tier(runs: DataFrame) -> DataFrame:
    """Memory tier from the peak (``peak_mb``)."""
    return runs.withColumn("tier_mb", memory_tier(F.col("peak_mb")))


def seconds(duration_ms: str = "duration_ms") -> Column:
    return F.col(duration_ms) / F.lit(1000.0)


def energy_kwh(runs: DataFrame) -> DataFrame:
    """Energy of each run under each overhead scenario; the job runs at full load."""
    kw = F.col("tier_mb") / F.lit(float(MB_PER_VCPU)) * F.lit(KW_MAX)
    wide = with_scenarios(runs, SCENARIOS, "pue")
    return wide.withColumn("kwh", kw * (seconds() / F.lit(3600.0)) * F.col("pue"))


def cost_usd(runs: DataFrame) -> DataFrame:
    """Price of each run: memory-seconds plus one request."""
    gb_seconds = F.col("tier_mb") / F.lit(1024.0) * seconds()
    return runs.withColumn("usd", gb_seconds * F.lit(USD_PER_GB_SECOND) + F.lit(USD_PER_REQUEST))


def standing_kwh_per_year(pue: Column) -> Column:
    load = KW_MIN + (KW_MAX - KW_MIN) * STANDING_LOAD
    return F.lit(STANDING_VCPU * 24 * 365 * load) * pue


def cost_rollup(runs: DataFrame) -> DataFrame:
    """Energy and price per task, day and scenario, beside a node that is always on.

    ``multiple`` compares a year of that node with a year of such days.

    Energy and price are linear in tier × duration, so memory-milliseconds are
    summed once per task and day, exactly, before the scenarios widen the rows.
    """
    sized = with_tier(runs)
    work = F.col("tier_mb").cast("bigint") * F.round(F.col("duration_ms") * 1000).cast("bigint")
    daily = sized.groupBy("task_name", as_date(F.col("started_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(work.cast("decimal(20,0)")).alias("mb_us")
    )
    mb_s = F.col("mb_us").cast("double") / F.lit(1e6)
    wide = with_scenarios(daily, SCENARIOS, "pue")
    kwh = mb_s / F.lit(float(MB_PER_VCPU)) * F.lit(KW_MAX) / F.lit(3600.0) * F.col("pue")
    usd = mb_s / F.lit(1024.0) * F.lit(USD_PER_GB_SECOND) + F.col("runs") * F.lit(USD_PER_REQUEST)
    standing = standing_kwh_per_year(F.col("pue"))
    return wide.select(
        "task_name",
        "day",
        "scenario",
        "runs",
        kwh.alias("kwh"),
        usd.alias("usd"),
        standing.alias("standing_kwh"),
        F.try_divide(standing, kwh * RUNS_PER_YEAR).alias("multiple"),
    )
