"""The shipped test tables in the shape the operators expect. Each view is lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Given schemas save the job that reads a file footer for each table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trips."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate AS pickup_ts",
        "l_suppkey AS pu_location_id",
        "l_extendedprice AS fare_amount",
        "l_discount AS trip_distance",
        "l_tax AS passenger_count",
        "l_extendedprice * l_tax AS tip_amount",
        "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total_amount",
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as zones. The 25 nations and 5 regions are fixed, so they are broadcast."""
    nations = F.broadcast(table(spark, sf_dir, "nation"))
    regions = F.broadcast(table(spark, sf_dir, "region"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr("s_suppkey AS location_id", "r_name AS borough", "n_name AS zone")
    )


def order_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trips with a payment type."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_orderdate AS pickup_ts",
        "cast(substr(o_orderpriority, 1, 1) AS int) AS payment_type",
        "o_totalprice AS fare_amount",
        "o_totalprice AS total_amount",
    )


def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as task runs; status and peak memory come from ``props.k``."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .selectExpr(
            "user_id AS run_id",
            "event_type AS task_name",
            "ts AS started_at",
            "timestampadd(MICROSECOND, cast(floor(value * 1000 + 0.5) AS bigint), ts) AS ended_at",
            "value AS duration_ms",
            "event_id",
            "CASE WHEN k < 70 THEN 'success' WHEN k < 85 THEN 'skipped' WHEN k < 93 THEN 'failed'"
            " WHEN k < 97 THEN 'upstream_failed' ELSE 'oom' END AS status",
            "1 AS attempt",
            "100 + k * 30 AS peak_mb",
        )
    )


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user, every tenth still open, and a few runs without tasks."""
    closed = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"))
        .selectExpr(
            "user_id AS run_id",
            "concat('job_', cast(user_id % 7 AS string)) AS module_path",
            "started_at",
            "CASE WHEN user_id % 10 <> 0 THEN last_ts END AS ended_at",
            "CASE WHEN user_id % 10 = 0 THEN 'running' WHEN user_id % 3 = 0 THEN 'failed'"
            " ELSE 'success' END AS status",
        )
    )
    idle = table(spark, sf_dir, "region").selectExpr(
        "cast(-1 - r_regionkey AS bigint) AS run_id",
        "'job_idle' AS module_path",
        "timestamp_ntz'2024-01-01 00:00:00' AS started_at",
        "cast(NULL AS timestamp_ntz) AS ended_at",
        "'running' AS status",
    )
    return closed.unionByName(idle)


def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task runs in the columns of the run table. The day stands in for the attempt."""
    return task_runs(spark, sf_dir).selectExpr(
        "cast(run_id AS string) AS run_id",
        "task_name",
        "status",
        "started_at",
        "ended_at",
        "duration_ms",
        "CASE WHEN status IN ('failed', 'oom') THEN 'stopped' END AS error",
        "md5(task_name) AS fingerprint",
        "day(started_at) AS attempt",
        "event_id",
    )


def run_slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Run rows as a base and two overlapping delta batches that together hold every row."""
    runs = state_runs(spark, sf_dir)
    rest = F.col("event_id") % 4
    batches = (
        F.when(rest == 0, F.array(F.lit("d1")))
        .when(rest == 1, F.array(F.lit("d1"), F.lit("d2")))
        .when(rest == 2, F.array(F.lit("d2")))
    )
    base = runs.filter(rest.isin(0, 3)).drop("event_id")
    return base, runs.select("*", F.explode(batches).alias("batch_id")).drop("event_id")


def five_tables(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, dict[str, DataFrame]]]:
    """For every run table rows that stand and two batches ``d1`` and ``d2`` that partly repeat or contradict them."""
    runs = pipeline_runs(spark, sf_dir).withColumn("run_id", F.col("run_id").cast("string"))
    third = F.expr("pmod(cast(run_id AS bigint), 3)")
    base, delta = run_slices(spark, sf_dir)
    prints, edges = stored_prints(spark, sf_dir), named_edges(spark, sf_dir)
    number = F.expr("cast(substr(task_name, 6) AS bigint)")
    results = all_results(spark, sf_dir).selectExpr(
        "task_name", "fingerprint", "'parquet' AS backend", "cast(NULL AS string) AS path", "n_rows", "size_bytes",
        "timestamp_ntz'2024-01-01 00:00:00' AS created_at",
    )

    def at(text: str):
        return F.expr(f"timestamp_ntz'{text} 00:00:00'")

    return {
        "pipeline_runs": (runs.where(third < 2), {
            "d1": runs.where(third > 0).withColumn("module_path", F.lit("late")),
            "d2": runs.where(third == 2).withColumn("module_path", F.lit("later")),
        }),
        "task_runs": (base, {b: delta.where(F.col("batch_id") == b).drop("batch_id") for b in ("d1", "d2")}),
        "task_fingerprints": (prints, {
            "d1": prints.where(number % 3 == 1).withColumn("fingerprint", F.md5("fingerprint")).withColumn("updated_at", at("2024-01-02")),
            "d2": prints.where(number % 3 < 2).withColumn("fingerprint", F.lit("old")).withColumn("updated_at", at("2023-12-31")),
        }),
        "task_lineage": (edges, {
            "d1": edges.where(number % 4 == 1).select("task_name", F.lit("x").alias("upstream_task_name")).distinct(),
            "d2": edges.where(number % 8 == 1).select("task_name").distinct().selectExpr("task_name", "explode(array('y', 'z')) AS upstream_task_name"),
        }),
        "task_cache": (results.where(number % 3 < 2), {
            "d1": results.where(number % 3 > 0).withColumn("backend", F.lit("csv")),
            "d2": results.where(number % 3 == 2).withColumn("backend", F.lit("orc")),
        }),
    }


def fingerprint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items for hashing in two engines: money as whole cents, no floating text."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS flag",
        "l_orderkey",
        "l_linenumber",
        "cast(floor(l_extendedprice * 100 + 0.5) AS bigint) AS cents",
        "cast(floor(l_tax * 100 + 0.5) AS bigint) AS tax",
        "l_shipdate",
    )


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next version of the line items: tax of A raised, R gone, a partition X added."""
    old = fingerprint_rows(spark, sf_dir)
    kept = old.filter("flag <> 'R'").withColumn("tax", F.expr("CASE WHEN flag = 'A' THEN tax + 1 ELSE tax END"))
    extra = table(spark, sf_dir, "orders").selectExpr(
        "'X' AS flag",
        "o_orderkey AS l_orderkey",
        "1 AS l_linenumber",
        "cast(floor(o_totalprice * 100 + 0.5) AS bigint) AS cents",
        "cast(0 AS bigint) AS tax",
        "o_orderdate AS l_shipdate",
    )
    return kept.unionByName(extra)


def part_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as task definitions."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('part_', cast(p_partkey AS string)) AS task_name",
        "p_name AS source",
        "concat(p_brand, '/', p_type) AS config",
        "sha2(concat(p_name, p_type), 256) AS fingerprint",
        "p_size % 7 <> 0 AS cacheable",
        "p_size",
        "p_partkey",
    )


def stored_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last run stored: some definitions have changed since, some are new."""
    return part_defs(spark, sf_dir).filter("p_size % 11 <> 0").selectExpr(
        "task_name",
        "CASE WHEN p_size % 3 = 0 THEN md5(fingerprint) ELSE fingerprint END AS fingerprint",
        "timestamp_ntz'2024-01-01 00:00:00' AS updated_at",
    )


def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached results of four fifths of the parts: the others have none."""
    return all_results(spark, sf_dir).filter("n_rows % 5000 <> 0")


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialization log of the parts: rows and bytes of each result."""
    return part_defs(spark, sf_dir).selectExpr(
        "task_name",
        "fingerprint",
        "cast(p_size AS bigint) * 1000 AS n_rows",
        "cast(p_size AS bigint) * 2000000 AS size_bytes",
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with derived contact columns."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "c_name",
        "CASE WHEN c_custkey % 10 < 7 THEN concat('user', cast(c_custkey AS string), '@example.com')"
        " WHEN c_custkey % 10 < 9 THEN 'n/a' END AS email",
        "concat('555-555-01', lpad(cast(c_custkey % 100 AS string), 2, '0')) AS phone",
        "concat('192.0.2.', cast(c_custkey % 250 AS string)) AS signup_ip",
        "cast(NULL AS string) AS address",
        "c_mktsegment AS plan",
    )


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS task_name")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layered graph: node p depends on p div 2 and p div 3 while these are positive."""
    return (
        part_nodes(spark, sf_dir)
        .selectExpr("task_name", "explode(array(task_name div 2, task_name div 3)) AS upstream_task_name")
        .filter("upstream_task_name > 0")
        .distinct()
    )


def named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph with the names of ``part_defs``."""
    return part_edges(spark, sf_dir).selectExpr(
        "concat('part_', cast(task_name AS string)) AS task_name",
        "concat('part_', cast(upstream_task_name AS string)) AS upstream_task_name",
    )


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain through all parts: part p depends on part p - 1."""
    return part_nodes(spark, sf_dir).selectExpr("task_name", "task_name - 1 AS upstream_task_name").filter("upstream_task_name > 0")


def prefix_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part p depends on p div 2 and p div 20: the name of one upstream begins with that of the other."""
    return (
        part_nodes(spark, sf_dir)
        .selectExpr("task_name", "explode(array(task_name div 2, task_name div 20)) AS upstream_task_name")
        .filter("upstream_task_name > 0")
        .distinct()
        .selectExpr("concat('part_', task_name) AS task_name", "concat('part_', upstream_task_name) AS upstream_task_name")
    )


def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph with some edges turned back: node p div 2 also depends on p."""
    back = part_nodes(spark, sf_dir).filter("task_name % 50 = 7").selectExpr(
        "task_name div 2 AS new_task", "task_name AS upstream_task_name"
    )
    return part_edges(spark, sf_dir).unionByName(back.withColumnRenamed("new_task", "task_name"))


def part_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome for every part, with some failures."""
    return part_nodes(spark, sf_dir).selectExpr(
        "task_name",
        "CASE WHEN task_name % 97 = 30 THEN 'failed' WHEN task_name % 89 = 40 THEN 'oom'"
        " ELSE 'success' END AS status",
    )
