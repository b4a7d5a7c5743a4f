"""Every registered query: name -> (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.functions import (
    array_bucket, array_join, array_map, chain_hash, contains_any, decode_rows, elapsed_ms, encode_rows, label_of,
    money_sum, open_end, slug,
)
from tableflow.operators import aggregates as agg
from tableflow.operators import clean, cost, history, joins, lineage, merge, quality, refresh, windows
from tableflow.operators import snapshots as snap
from tableflow.plans import fixtures as fx
from tableflow.plans import jobs
from tableflow.session import new_path
from tableflow.sources import (
    literal_rows,
    materialize,
    project_scan,
    read_any,
    read_csv,
    read_table,
    read_union,
    replace_table,
    rows_from_json,
    write_csv,
    write_table,
)
from tableflow.streaming import absorb_stream, read_absorbed

Query = Callable[[SparkSession, str], DataFrame]

RUN_KEY = ["run_id", "task_name", "attempt"]


# ---- scans, sinks and filters ------------------------------------------------


def io_parquet(spark, sf_dir):
    path = write_table(fx.zones(spark, sf_dir), new_path(spark, "zones"))
    return read_table(spark, path)


def io_csv(spark, sf_dir):
    zones = fx.zones(spark, sf_dir)
    return read_csv(spark, write_csv(zones, new_path(spark, "zones")), zones.schema)


def io_csv_text(spark, sf_dir):
    """Whole documents with quotes and a line break through CSV."""
    docs = _notes(spark, sf_dir)
    return _digests(read_csv(spark, write_csv(docs, new_path(spark, "notes")), docs.schema))


def io_csv_split(spark, sf_dir):
    """The same through files that are read by byte range."""
    docs = _notes(spark, sf_dir)
    return _digests(read_csv(spark, write_csv(docs, new_path(spark, "notes")), docs.schema, split_bytes=0))


def _notes(spark, sf_dir):
    noted = F.concat(F.lit('say "'), F.col("text"), F.lit('", ok\n'), F.col("source"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", noted.alias("note"))


def _digests(notes):
    return notes.select("doc_id", F.length("note").cast("bigint").alias("n"), F.md5("note").alias("digest"))


def io_any(spark, sf_dir):
    orders = fx.order_trips(spark, sf_dir)
    csv = write_csv(orders, new_path(spark, "orders") + ".csv")
    parquet = write_table(fx.zones(spark, sf_dir), new_path(spark, "zones") + ".parquet")
    rows = read_any(spark, csv, orders.schema).agg(agg.n_rows().alias("n"), F.max("pickup_ts").alias("t"))
    more = read_any(spark, parquet).agg(agg.n_rows().alias("n"))
    return rows.select(
        F.col("n").alias("csv_rows"), F.col("t").alias("last_ts"), more.scalar().alias("parquet_rows")
    )


def io_replaced_table(spark, sf_dir):
    name, path = "payment_summary_" + new_path(spark, "t")[-8:], new_path(spark, "warehouse")
    replace_table(jobs.hour_summary(spark, sf_dir), name, path)
    return replace_table(jobs.payment_summary(spark, sf_dir), name, path)


def io_union(spark, sf_dir):
    """Two Parquet slices that split the table by line number; the later one lacks a column."""
    cols = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"]
    items = project_scan(spark, f"{sf_dir}/lineitem.parquet", cols)
    first = write_table(items.filter("l_linenumber <= 3"), new_path(spark, "slice"))
    second = write_table(items.filter("l_linenumber > 3").drop("l_tax"), new_path(spark, "slice"))
    both = read_union(spark, [first, second])
    return both.groupBy("l_linenumber").agg(
        agg.n_rows().alias("n"),
        F.count("l_tax").alias("with_tax"),
        money_sum(F.col("l_extendedprice")).alias("price"),
    )


def io_union_types(spark, sf_dir):
    """Two Parquet slices that hold the same column as bigint and as double."""
    items = project_scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])
    whole = items.filter("l_linenumber <= 3").withColumn("l_quantity", F.col("l_quantity").cast("bigint"))
    first = write_table(whole, new_path(spark, "slice"))
    second = write_table(items.filter("l_linenumber > 3"), new_path(spark, "slice"))
    both = read_union(spark, [first, second])
    return both.groupBy("l_linenumber").agg(agg.n_rows().alias("n"), F.sum("l_quantity").alias("quantity"))


def io_materialize(spark, sf_dir):
    """A mid-job result is written once; the row count of that pass and of the file agree."""
    table, seen = materialize(fx.order_trips(spark, sf_dir))
    return table.agg(agg.n_rows().alias("n_rows")).select(
        "n_rows", (F.col("n_rows") == seen["rows"]).alias("same"), F.lit(seen["bytes"] > 0).alias("sized")
    )


def json_rows(spark, sf_dir):
    """Daily rows packed as JSON per payment type, and unpacked again."""
    packed = jobs.payment_json(spark, sf_dir)
    return rows_from_json(packed, "rows_json", "trip_date date, trip_count bigint, total_revenue double")


def json_codec(spark, sf_dir):
    """The properties of every event decoded, and encoded again in a row list."""
    events = fx.table(spark, sf_dir, "events")
    rows = F.array(F.struct(decode_rows(F.col("props"), "k int").k.alias("k"), F.col("event_id").alias("id")))
    return events.select("event_id", encode_rows(rows).alias("encoded"))


def literal_join(spark, sf_dir):
    """A literal table of labels joined to the orders."""
    labels = literal_rows(spark, list(jobs.PAYMENT_LABELS.items()), "payment_type int, label string")
    orders = fx.order_trips(spark, sf_dir).groupBy("payment_type").agg(agg.n_rows().alias("n"))
    return orders.join(F.broadcast(labels), "payment_type", "left")


def filter_chain(spark, sf_dir):
    """Half-open range, excluded values, non-null, equality and an unset optional filter."""
    orders = jobs.ranged_orders(spark, sf_dir)
    return clean.pipe(
        orders,
        lambda t: clean.drop_null(t, ["o_totalprice"]),
        lambda t: clean.exclude_values(t, "o_orderpriority", ["5-LOW", "3-MEDIUM"]),
        lambda t: clean.equals(t, "o_orderstatus", "F"),
        lambda t: clean.maybe_equals(t, "o_custkey", None),
    )


def derived_orders(spark, sf_dir):
    """Columns added to whole orders: label, slug, name hint, and an open end."""
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    code = F.substring("o_orderpriority", 1, 1).cast("int")
    return clean.derive(
        orders,
        {
            "label": label_of(code, jobs.PAYMENT_LABELS),
            "tag": slug(F.col("o_orderpriority")),
            "hint": contains_any(F.col("o_orderpriority"), ["high", "low"]),
            "ended_at": open_end(),
            "to_midnight_ms": elapsed_ms(F.col("o_orderdate"), F.to_timestamp_ntz(F.lit("2000-01-01"))),
        },
    )


def matching_orders(spark, sf_dir):
    """Orders with at least one returned line: one side of a join is kept."""
    lines = clean.equals(fx.table(spark, sf_dir, "lineitem"), "l_returnflag", "R")
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.keep_matching(fx.table(spark, sf_dir, "orders"), lines, ["o_orderkey"])


def distinct_rows(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    return clean.distinct_rows(lines.select("l_returnflag", "l_linestatus", "l_quantity", "l_tax"))


def bucket_sums(spark, sf_dir):
    return agg.bucket_sums(fx.table(spark, sf_dir, "lineitem"), "l_orderkey", 7)


def bucket_filter(spark, sf_dir):
    """Rows of each remainder: the bucket filters of a fan-out in one pass."""
    return clean.buckets(fx.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3)


def bucket_union(spark, sf_dir):
    """Two branches of that fan-out put together again, by position."""
    keys = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return agg.union_all(clean.bucket(keys, "o_orderkey", 3, 0), clean.bucket(keys, "o_custkey", 3, 1))


def array_ops(spark, sf_dir):
    """Map, filter by remainder, and concatenation on an array per line item."""
    arr = F.array("l_orderkey", "l_partkey", "l_suppkey")
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arr.alias("a"))
    a = F.col("a")
    doubled, raised = array_map(a, lambda x: x * 2), array_map(a, lambda x: x + 100)
    text = {
        "doubled": doubled,
        "joined": array_join(doubled, raised),
        "thirds": array_bucket(a, 3, 0),
    }
    return lines.select(
        "l_orderkey", "l_linenumber", *[F.concat_ws(",", v.cast("array<string>")).alias(k) for k, v in text.items()]
    )


def borough_totals(spark, sf_dir):
    return agg.borough_totals(jobs.borough_days(spark, sf_dir))


def best_payment_day(spark, sf_dir):
    return agg.best_row(jobs.payment_days(spark, sf_dir), "trip_date", "total_revenue", ["payment_type"])


def rolling_events(spark, sf_dir):
    """Trailing mean over the raw events of each type, cut into ranges of time."""
    events = fx.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    cents = F.floor(F.col("value") * 100 + 0.5)
    rolled = windows.rolling_mean(events.withColumn("cents", cents), "event_type", "ts", "cents", 3, "mean_cents")
    return rolled.select("event_id", F.round("mean_cents", 4).alias("mean_cents"))


# ---- run history ---------------------------------------------------------------


def _runs(spark, sf_dir):
    return fx.task_runs(spark, sf_dir)


def history_latest(spark, sf_dir):
    latest = history.latest_status(_runs(spark, sf_dir), "event_id")
    return latest.select("run_id", "task_name", "status", "started_at", "ended_at", "duration_ms")


def history_last_status(spark, sf_dir):
    return agg.last_status(_runs(spark, sf_dir), "click")


def history_run_summary(spark, sf_dir):
    return history.run_summary(fx.pipeline_runs(spark, sf_dir), _runs(spark, sf_dir))


def history_status_counts(spark, sf_dir):
    return agg.status_counts(_runs(spark, sf_dir), ["run_id", "task_name"])


def _shown(stats: DataFrame) -> DataFrame:
    """The mean to a millionth: its last digits depend on the order of the tasks."""
    return stats.withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


def history_task_stats(spark, sf_dir):
    return _shown(history.task_stats(_runs(spark, sf_dir)))


def history_recent(spark, sf_dir):
    return history.recent_runs(fx.pipeline_runs(spark, sf_dir), 20)


def history_slowest(spark, sf_dir):
    return _shown(history.slowest_tasks(_runs(spark, sf_dir)))


def history_outcome(spark, sf_dir):
    return history.run_outcome(_runs(spark, sf_dir))


def history_appended(spark, sf_dir):
    rows = _runs(spark, sf_dir).drop("duration_ms")
    return history.append_task_runs(rows).select("event_id", "run_id", "task_name", "status", "duration_ms")


def history_closed(spark, sf_dir):
    """Open runs closed with the outcome and last end of their tasks."""
    runs = fx.pipeline_runs(spark, sf_dir)
    seen = history.unclosed_runs(runs, _runs(spark, sf_dir)).filter("outcome IS NOT NULL")
    ends = seen.select("run_id", F.col("last_task_end").alias("ended_at"), F.col("outcome").alias("status"))
    return history.close_runs(runs, ends)


def history_unclosed(spark, sf_dir):
    return history.unclosed_runs(fx.pipeline_runs(spark, sf_dir), _runs(spark, sf_dir))


# ---- merge ---------------------------------------------------------------------


def merge_insert_absent(spark, sf_dir):
    base, delta = fx.run_slices(spark, sf_dir)
    return merge.insert_if_absent(base, delta, RUN_KEY, ["batch_id", "started_at"])


def merge_anti_insert(spark, sf_dir):
    """Insert-only by run id: runs the base has never seen."""
    base, delta = fx.run_slices(spark, sf_dir)
    return joins.anti_insert(base.select("run_id").distinct(), merge.delta_keys(delta, ["run_id"]), ["run_id"])


def merge_replace_key(spark, sf_dir):
    base, delta = fx.run_slices(spark, sf_dir)
    return merge.replace_by_key(base, delta, RUN_KEY)


def merge_upsert_latest(spark, sf_dir):
    base, delta = fx.run_slices(spark, sf_dir)
    one, _ = materialize(windows.latest_per_key(base, RUN_KEY, ["started_at"]))
    return merge.upsert_latest(one, delta, RUN_KEY, ["started_at"])


def merge_absorb_twice(spark, sf_dir):
    base, delta = fx.run_slices(spark, sf_dir)
    once = merge.absorb({"task_runs": base}, {"task_runs": delta})
    return merge.absorb(once, {"task_runs": delta})["task_runs"]


def merge_conflicts(spark, sf_dir):
    return merge.merge_conflicts(fx.state_runs(spark, sf_dir))


def merge_shared_run(spark, sf_dir):
    """Runs entered by many workers: each event's worker claims to have started its run."""
    runs = fx.pipeline_runs(spark, sf_dir).filter("status <> 'running'")
    claims = _runs(spark, sf_dir).selectExpr(
        "run_id", "concat('job_', task_name) AS module_path", "started_at",
        "cast(NULL AS timestamp_ntz) AS ended_at", "'running' AS status",
    )
    return merge.join_shared_run(runs, claims)


def merge_delta_keys(spark, sf_dir):
    return merge.delta_keys(fx.state_runs(spark, sf_dir), ["task_name", "attempt"])


def _from_nothing(name: str, rows: DataFrame) -> DataFrame:
    """Two batches that both hold all rows, merged into a run table that has none yet."""
    both = rows.withColumn("batch_id", F.explode(F.array(F.lit("d1"), F.lit("d2"))))
    return merge.absorb({name: rows.limit(0)}, {name: both})[name]


def merge_first_runs(spark, sf_dir):
    return _from_nothing("pipeline_runs", fx.pipeline_runs(spark, sf_dir))


def merge_first_cache(spark, sf_dir):
    results = fx.all_results(spark, sf_dir)
    return _from_nothing("task_cache", results.withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'")))


def merge_first_prints(spark, sf_dir):
    return _from_nothing("task_fingerprints", fx.stored_prints(spark, sf_dir))


def merge_first_lineage(spark, sf_dir):
    return _from_nothing("task_lineage", fx.named_edges(spark, sf_dir))


def _pending(spark, delta) -> str:
    folder = new_path(spark, "pending")
    for name in ("d1", "d2"):
        merge.write_delta(delta.filter(F.col("batch_id") == name).drop("batch_id"), folder, name)
    return folder


def merge_compacted(spark, sf_dir):
    """Two pending batches folded into a table that is stored in buckets of its key."""
    base, delta = fx.run_slices(spark, sf_dir)
    name, buckets = "task_runs_" + new_path(spark, "t")[-8:], 8
    merge.store_bucketed(base, name, new_path(spark, "base"), RUN_KEY, buckets)
    merge.compact(spark, "task_runs", name, _pending(spark, delta), f"{name}_new", new_path(spark, "compacted"), buckets)
    return spark.table(f"{name}_new")


def stream_absorb(spark, sf_dir):
    """The same batches through the stream, whose state holds the winner of each key."""
    base, delta = fx.run_slices(spark, sf_dir)
    folder, out = _pending(spark, delta), new_path(spark, "winners")
    absorb_stream(spark, "task_runs", folder, out, new_path(spark, "stream"))
    return read_absorbed(spark, "task_runs", base, folder, out)


def merge_all_tables(spark, sf_dir):
    """Two batches for each of the five run tables, merged by one call into tables that hold rows."""
    root = new_path(spark, "five")
    for name, (base, batches) in fx.five_tables(spark, sf_dir).items():
        base.write.parquet(f"{root}/base/{name}")
        for batch, rows in batches.items():
            merge.write_delta(rows, f"{root}/pending/{name}", batch)
    merge.absorb_folders(spark, f"{root}/base", f"{root}/pending", f"{root}/out")
    shown = []
    for name, value in {
        "pipeline_runs": "concat_ws('|', run_id, module_path, status)",
        "task_runs": "concat_ws('|', run_id, task_name, attempt, status, duration_ms > 50)",
        "task_fingerprints": "concat_ws('|', task_name, fingerprint)",
        "task_lineage": "concat_ws('|', task_name, upstream_task_name)",
        "task_cache": "concat_ws('|', task_name, fingerprint, backend, n_rows, size_bytes)",
    }.items():
        rows = spark.read.schema(history.TABLES[name]).parquet(f"{root}/out/{name}")
        shown.append(rows.selectExpr(f"'{name}' AS table_name", f"{value} AS row_text"))
    out = shown[0]
    for more in shown[1:]:
        out = out.unionByName(more)
    return out.groupBy("table_name", "row_text").agg(agg.n_rows().alias("copies"))


# ---- refresh ---------------------------------------------------------------------

PRINT_COLUMNS = ["l_orderkey", "l_linenumber", "cents", "tax", "l_shipdate"]


def fp_table(spark, sf_dir):
    return refresh.table_fingerprint(fx.fingerprint_rows(spark, sf_dir), "flag", PRINT_COLUMNS)


PRINT_SCHEMA = "l_orderkey bigint, l_linenumber int, cents bigint, tax bigint, l_shipdate timestamp_ntz, flag string"


def fp_tree(spark, sf_dir):
    """Fingerprints from a hash tree after the lines of one order changed: only its key ranges are read again."""
    path, width = new_path(spark, "ranges"), 1 << 13
    rows = fx.fingerprint_rows(spark, sf_dir)
    refresh.write_ranges(rows, path, "flag", "l_orderkey", width)
    refresh.build_tree(spark, path, f"{path}-tree1", PRINT_SCHEMA, "flag", PRINT_COLUMNS)
    raised = F.when(F.col("l_orderkey") == 0, F.col("cents") + 1).otherwise(F.col("cents"))
    ranges = rows.where(f"l_orderkey < {width}").withColumn("cents", raised)
    refresh.overwrite_ranges(ranges, path, "flag", "l_orderkey", width)
    refresh.refresh_tree(spark, path, f"{path}-tree1", f"{path}-tree2", PRINT_SCHEMA, "flag", PRINT_COLUMNS)
    return refresh.tree_fingerprint(spark, f"{path}-tree2", "flag")


def fp_changed_partitions(spark, sf_dir):
    new = refresh.table_fingerprint(fx.changed_rows(spark, sf_dir), "flag", PRINT_COLUMNS)
    return refresh.changed_partitions(fp_table(spark, sf_dir), new, "flag")


def _flag_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("flag", "l_linenumber").agg(
        agg.n_rows().alias("n"), F.sum("cents").alias("cents"), F.sum("tax").alias("tax")
    )


def refresh_result(spark, sf_dir):
    """Totals per flag and line number, recomputed only for the flags that changed."""
    target, _ = materialize(_flag_totals(fx.fingerprint_rows(spark, sf_dir)))
    changes, _ = materialize(fp_changed_partitions(spark, sf_dir))
    return refresh.refresh(target, fx.changed_rows(spark, sf_dir), "flag", changes, _flag_totals)


def refresh_stored(spark, sf_dir):
    """The same refresh on a stored table: only the folders of changed flags are written."""
    path = new_path(spark, "flags")
    _flag_totals(fx.fingerprint_rows(spark, sf_dir)).write.partitionBy("flag").parquet(path)
    changes, _ = materialize(fp_changed_partitions(spark, sf_dir))
    refresh.refresh_stored(path, fx.changed_rows(spark, sf_dir), "flag", changes, _flag_totals)
    return read_table(spark, path)


def refresh_preview(spark, sf_dir):
    return refresh.refresh_preview(
        fx.part_defs(spark, sf_dir), fx.stored_prints(spark, sf_dir), fx.cached_results(spark, sf_dir)
    )


def ready_to_run(spark, sf_dir):
    return refresh.ready_to_run(
        fx.part_defs(spark, sf_dir), fx.named_edges(spark, sf_dir), fx.stored_prints(spark, sf_dir)
    )


def cache_report(spark, sf_dir):
    return refresh.cache_report(fx.all_results(spark, sf_dir))


def hash_chain(spark, sf_dir):
    """SHA-256 over the columns of every part."""
    parts = fx.table(spark, sf_dir, "part")
    return parts.select("p_partkey", chain_hash(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("hash"))


def fp_definitions(spark, sf_dir):
    ups = F.array(F.concat(F.lit("size="), F.col("p_size").cast("string")), F.concat(F.lit("a="), "source"))
    defs = fx.part_defs(spark, sf_dir).select("task_name", "source", "config", ups.alias("upstreams"))
    return refresh.definition_fingerprint(defs).select("task_name", "fingerprint")


def fp_propagated(spark, sf_dir):
    defs = fx.part_defs(spark, sf_dir).select("task_name", "source", "config")
    return refresh.propagate_fingerprints(defs, fx.named_edges(spark, sf_dir))


def fp_prefix_names(spark, sf_dir):
    """Fingerprints where every task has upstreams such as ``part_1`` and ``part_10``."""
    defs = fx.part_defs(spark, sf_dir).select("task_name", "source", "config")
    return refresh.propagate_fingerprints(defs, fx.prefix_edges(spark, sf_dir))


# ---- snapshots -------------------------------------------------------------------


def snap_diff(spark, sf_dir):
    """What a version without the skipped runs lacks; several events may share all run columns."""
    runs = fx.state_runs(spark, sf_dir).drop("event_id")
    return snap.rows_diff(runs, runs.filter("status <> 'skipped'"))


# ---- sensitive columns -------------------------------------------------------------


def pii_profile(spark, sf_dir):
    return quality.profile(fx.contacts(spark, sf_dir))


def pii_scan(spark, sf_dir):
    return quality.scan_sensitive(fx.contacts(spark, sf_dir))


def _triage(df: DataFrame) -> DataFrame:
    report = quality.triage_report(df, quality.scan_sensitive(df))
    one = "d -> transform(d.found, f -> concat(d.column_name, ':', f.pattern, '=', cast(f.ratio AS string)))"
    return report.select(
        "n_rows",
        "columns_scanned",
        F.concat_ws(",", "confirmed").alias("confirmed"),
        F.concat_ws(",", "worth_a_look").alias("worth_a_look"),
        F.concat_ws(",", F.expr(f"flatten(transform(detail, {one}))")).alias("detail"),
        "verdict",
    )


def pii_triage(spark, sf_dir):
    return _triage(fx.contacts(spark, sf_dir))


def pii_triage_hint(spark, sf_dir):
    """No pattern among the suppliers, but a column name to look at."""
    return _triage(fx.table(spark, sf_dir, "supplier"))


def pii_triage_clean(spark, sf_dir):
    """Nothing to be found in the documents."""
    return _triage(fx.table(spark, sf_dir, "documents"))


def pii_documents(spark, sf_dir):
    """The same scan on whole documents."""
    return quality.scan_sensitive(fx.table(spark, sf_dir, "documents"))


def non_null_counts(spark, sf_dir):
    return agg.non_null(fx.contacts(spark, sf_dir))


# ---- lineage -----------------------------------------------------------------------


def lineage_levels(spark, sf_dir):
    return lineage.levels(fx.part_edges(spark, sf_dir), fx.part_nodes(spark, sf_dir))


def lineage_roots(spark, sf_dir):
    return lineage.roots(fx.part_edges(spark, sf_dir), fx.part_nodes(spark, sf_dir))


def lineage_descendants(spark, sf_dir):
    """Everything below node 2."""
    start = fx.part_nodes(spark, sf_dir).filter("task_name = 2")
    return lineage.descendants(fx.part_edges(spark, sf_dir), start)


def lineage_deep_levels(spark, sf_dir):
    """Levels of a chain through all parts: as deep as the table is long."""
    return lineage.levels(fx.chain_edges(spark, sf_dir), fx.part_nodes(spark, sf_dir))


def lineage_deep_descendants(spark, sf_dir):
    """Everything below the tenth part of that chain."""
    start = fx.part_nodes(spark, sf_dir).filter("task_name = 10")
    return lineage.descendants(fx.chain_edges(spark, sf_dir), start)


def lineage_failure(spark, sf_dir):
    return lineage.propagate_failure(fx.part_edges(spark, sf_dir), fx.part_outcomes(spark, sf_dir))


def lineage_cycles(spark, sf_dir):
    return lineage.cycle_members(fx.cyclic_edges(spark, sf_dir), fx.part_nodes(spark, sf_dir))


def lineage_adjacency(spark, sf_dir):
    rows = history.task_adjacency(fx.named_edges(spark, sf_dir), fx.part_defs(spark, sf_dir))
    return rows.select("task_name", F.concat_ws(",", "depends_on").alias("depends_on"))


def lineage_upstreams(spark, sf_dir):
    rows = agg.upstream_list(fx.named_edges(spark, sf_dir))
    return rows.select("task_name", F.concat_ws(",", "depends_on").alias("depends_on"))


def lineage_resume(spark, sf_dir):
    return lineage.resume_set(refresh_preview(spark, sf_dir), fx.named_edges(spark, sf_dir))


def lineage_duplicates(spark, sf_dir):
    """Part types used for one brand as if a task had several definitions."""
    parts = fx.table(spark, sf_dir, "part")
    defs = parts.selectExpr("concat(p_brand, p_size) AS task_name", "md5(p_type) AS fingerprint")
    return lineage.duplicate_names(defs)


# ---- cost --------------------------------------------------------------------------


def cost_per_run(spark, sf_dir):
    """Tier, price and energy of every run under every scenario."""
    sized = cost.cost_usd(cost.with_tier(_runs(spark, sf_dir)))
    return cost.energy_kwh(sized).select(
        "event_id", "tier_mb", "scenario", F.round(F.col("kwh") * 1e9, 3).alias("kwh_e9"),
        F.round(F.col("usd") * 1e9, 3).alias("usd_e9"),
    )


def cost_rollup(spark, sf_dir):
    rolled = cost.cost_rollup(_runs(spark, sf_dir))
    return rolled.select(
        "task_name", "day", "scenario", "runs",
        F.round(F.col("kwh") * 1e9, 3).alias("kwh_e9"),
        F.round(F.col("usd") * 1e9, 3).alias("usd_e9"),
        F.round("standing_kwh", 4).alias("standing_kwh"),
        F.round("multiple", 2).alias("multiple"),
    )


QUERIES: dict[str, Query] = {
    "z1_daily_fares": jobs.load_daily_fares,
    "z2_borough_list": jobs.borough_list,
    "z2_partition_manifest": jobs.borough_manifest,
    "z2_partition_count": jobs.borough_count,
    "z3_rolling_revenue": jobs.rolling_revenue,
    "z3_report": jobs.revenue_report,
    "z4_by_payment": jobs.payment_summary,
    "z4_by_hour": jobs.hour_summary,
    "z4_combined": jobs.combined_rows,
    "z5_daily_totals": jobs.day_totals,
    "z6_totals": jobs.payment_totals,
    "z8_payment_days": jobs.payment_days,
    "z8_card_days": jobs.card_days,
    "z8_payment_reports": jobs.payment_reports,
    "z9_measures": jobs.three_measures,
    "z10_borough_day": jobs.borough_days,
    "z10_report": jobs.borough_report,
    "z10_year_of_files": jobs.year_of_files,
    "z11_extract": jobs.extract_file,
    **{
        f.__name__: f
        for f in (
            io_parquet, io_csv, io_csv_text, io_csv_split, io_any, io_replaced_table, io_union, io_union_types, io_materialize,
            json_rows, json_codec, literal_join,
            filter_chain, derived_orders, matching_orders, distinct_rows, bucket_sums, bucket_filter, bucket_union,
            array_ops, borough_totals, best_payment_day, rolling_events,
            history_latest, history_last_status, history_run_summary, history_status_counts,
            history_task_stats, history_recent, history_slowest, history_outcome, history_appended,
            history_closed, history_unclosed,
            merge_insert_absent, merge_anti_insert, merge_replace_key, merge_upsert_latest,
            merge_absorb_twice, merge_conflicts, merge_shared_run, merge_delta_keys, merge_compacted, merge_all_tables,
            fp_table, fp_tree, fp_changed_partitions, refresh_result, refresh_stored, refresh_preview, ready_to_run, cache_report,
            hash_chain, fp_definitions, fp_propagated, fp_prefix_names,
            snap_diff,
            merge_first_runs, merge_first_cache, merge_first_prints, merge_first_lineage,
            pii_profile, pii_scan, pii_triage, pii_triage_hint, pii_triage_clean, pii_documents, non_null_counts,
            lineage_levels, lineage_roots, lineage_descendants, lineage_deep_levels,
            lineage_deep_descendants, lineage_failure, lineage_cycles,
            lineage_adjacency, lineage_upstreams, lineage_resume, lineage_duplicates,
            cost_per_run, cost_rollup, stream_absorb,
        )
    },
}
