from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tableflow.operators import history, joins, merge
from tableflow.operators.history import TABLES
from tableflow.session import list_names, new_path
from tableflow.streaming import absorb, absorb_stream, read_absorbed, read_winners

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def task_run(run, task, status, minute=0, attempt=1):
    return (run, task, status, at(minute), at(minute + 1), 60000.0, None, "f", attempt)


def frame(spark, name, rows, batch=None):
    df = spark.createDataFrame(rows, TABLES[name])
    return df.withColumn("batch_id", F.lit(batch)) if batch else df


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.fixture
def pieces(spark):
    def lineage(rows, batch=None):
        return frame(spark, "task_lineage", rows, batch)

    base = {
        "pipeline_runs": frame(spark, "pipeline_runs", [("r1", "m", T0, None, "running")]),
        "task_runs": frame(spark, "task_runs", [task_run("r1", "a", "success")]),
        "task_cache": frame(spark, "task_cache", [("a", "f1", "parquet", "p", 1, 10, T0)]),
        "task_fingerprints": frame(spark, "task_fingerprints", [("a", "f1", T0), ("k", "f0", T0)]),
        "task_lineage": lineage([("b", "a"), ("b", "x"), ("c", "a")]),
    }
    one = {
        "pipeline_runs": frame(spark, "pipeline_runs", [("r1", "m", at(5), None, "running")], "1"),
        "task_runs": frame(
            spark, "task_runs", [task_run("r1", "a", "failed"), task_run("r1", "b", "success", 1)], "1"
        ),
        "task_cache": frame(spark, "task_cache", [("a", "f2", "parquet", "q", 2, 20, at(1))], "1"),
        "task_fingerprints": frame(spark, "task_fingerprints", [("a", "f3", at(9))], "1"),
        "task_lineage": lineage([("b", "a")], "1"),
    }
    two = {
        "task_runs": frame(spark, "task_runs", [task_run("r1", "b", "failed", 2), task_run("r2", "a", "oom")], "2"),
        "pipeline_runs": frame(spark, "pipeline_runs", [("r2", "m", at(6), None, "running")], "2"),
        "task_fingerprints": frame(spark, "task_fingerprints", [("a", "f2", at(3)), ("n", "f1", T0)], "2"),
    }
    return base, one, two


def joined(one, two):
    out = dict(one)
    for name, df in two.items():
        out[name] = out[name].unionByName(df) if name in out else df
    return out


def test_absorb_follows_the_rule_of_each_table(pieces):
    base, one, two = pieces
    got = merge.absorb(base, joined(one, two))
    runs = {(r.run_id, r.task_name): r.status for r in got["task_runs"].collect()}
    assert runs == {("r1", "a"): "success", ("r1", "b"): "success", ("r2", "a"): "oom"}
    assert {r.task_name: r.fingerprint for r in got["task_fingerprints"].collect()} == {
        "a": "f3", "k": "f0", "n": "f1",
    }
    assert {tuple(r) for r in got["task_lineage"].collect()} == {("b", "a"), ("c", "a")}
    assert {r.run_id: r.started_at for r in got["pipeline_runs"].collect()} == {"r1": T0, "r2": at(6)}
    assert got["task_cache"].count() == 2


def test_absorb_twice_is_once(pieces):
    base, one, two = pieces
    deltas = joined(one, two)
    once = merge.absorb(base, deltas)
    twice = merge.absorb(once, deltas)
    assert all(same(once[name], twice[name]) for name in base)


def test_one_by_one_and_all_together_agree(pieces):
    base, one, two = pieces
    together = merge.absorb(base, joined(one, two))
    stepwise = merge.absorb(merge.absorb(base, one), two)
    assert all(same(together[name], stepwise[name]) for name in base)


def test_fingerprints_do_not_depend_on_batch_order(pieces):
    base, one, two = pieces
    a = merge.absorb(merge.absorb(base, one), two)["task_fingerprints"]
    b = merge.absorb(merge.absorb(base, two), one)["task_fingerprints"]
    assert same(a, b)


def test_conflicts_name_the_key_that_loses_a_row(spark):
    rows = [task_run("r", "a", "failed"), task_run("r", "a", "success", 3), task_run("r", "b", "success")]
    got = merge.merge_conflicts(frame(spark, "task_runs", rows)).collect()
    assert [(r.task_name, r.n_rows, r.n_statuses) for r in got] == [("a", 2, 2)]


def pending_of(spark, name, *batches):
    """Batches in a pending folder, named in the order given."""
    folder = new_path(spark, "pending")
    for i, rows in enumerate(batches):
        merge.write_delta(frame(spark, name, rows), folder, f"b{i}")
    return folder


def bucketed(spark, name, rows):
    table = "t_" + new_path(spark, name)[-12:]
    return table, merge.store_bucketed(frame(spark, name, rows), table, new_path(spark, name), merge.RULES[name][1], 4)


CASES = {
    "task_runs": (
        [task_run("r", "a", "success"), task_run("r", "x", "success"), task_run("r", "x", "failed", 2)],
        [task_run("r", "a", "failed"), task_run("r", "b", "failed", 3), task_run("r", "b", "oom", 1)],
        [task_run("r", "c", "failed"), task_run("r", "b", "success")],
    ),
    "task_fingerprints": (
        [("a", "f1", at(5)), ("k", "f0", at(0)), ("d", "f1", at(1)), ("d", "f2", at(2)), ("u", "f1", at(1)), ("u", "f1", at(1))],
        [("a", "f9", at(9)), ("d", "f0", at(0)), ("n", "f1", None)],
        [("a", "f3", at(7)), ("n", "f2", at(0))],
    ),
    "task_lineage": (
        [("b", "a"), ("b", "x"), ("c", "a"), ("d", "a")],
        [("b", "a"), ("b", "q"), ("e", "z")],
        [("b", "p"), ("b", "r"), ("d", "a")],
    ),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_compaction_equals_the_merge_and_does_not_shuffle_the_table(spark, name):
    base, one, two = CASES[name]
    table, target = bucketed(spark, name, base)
    folder = pending_of(spark, name, one, two)
    delta = merge.read_deltas(spark, name, folder, merge.pending(spark, folder))
    plan = merge.merge_bucketed(name, target, delta, 4)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "Bucketed: true" in line]
    assert len(scans) == 1
    lines = plan.splitlines()
    at_ = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = len(lines[at_]) - len(lines[at_].lstrip(" :+-"))
    for line in reversed(lines[:at_]):  # the operators above the scan, up to the root
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            depth = indent
            assert "Exchange" not in line
    want = merge.merge_table(name, frame(spark, name, base), delta)
    new, path = table + "_new", new_path(spark, "compacted")
    rows = sorted(map(str, want.collect()))
    assert merge.compact(spark, name, table, folder, new, path, 4) == ["b0", "b1"]
    assert merge.pending(spark, folder) == [] and merge.compact(spark, name, table, folder, new + "2", path + "2", 4) == []
    assert sorted(map(str, spark.table(new).select(*want.columns).collect())) == rows
    assert spark.table(table).count() == len(base)


def test_a_batch_is_pending_once_it_is_whole(spark):
    folder = pending_of(spark, "task_runs", [task_run("r", "a", "success")])
    half = f"{folder}/{merge.BATCH}=half"
    frame(spark, "task_runs", [task_run("r", "b", "success")]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(half)
    assert merge.pending(spark, folder) == ["b0"]


def test_five_tables_merge_in_one_call(spark, pieces):
    base, one, two = pieces
    root = new_path(spark, "five")
    for name in TABLES:
        base[name].write.parquet(f"{root}/base/{name}")
        for tag, delta in (("1", one), ("2", two)):
            if name in delta:
                merge.write_delta(delta[name].drop("batch_id"), f"{root}/pending/{name}", tag)
    folded = merge.absorb_folders(spark, f"{root}/base", f"{root}/pending", f"{root}/out")
    assert folded["task_runs"] == ["1", "2"] and folded["task_cache"] == ["1"]
    want = merge.absorb(base, joined(one, two))
    for name, columns in TABLES.items():
        assert same(want[name], spark.read.schema(columns).parquet(f"{root}/out/{name}")), name


def jobs_of(spark, work):
    """How many Spark jobs a piece of work starts."""
    tracker, group = spark.sparkContext.statusTracker(), new_path(spark, "g")
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_merges_of_large_tables_start_no_job_and_cut_the_target_in_its_scan(spark, monkeypatch):
    monkeypatch.setattr(joins, "is_small", lambda df, most=None: False)
    path = new_path(spark, "target")
    target = spark.range(4000).selectExpr("concat('k', id % 900) AS k", "cast(id AS int) AS t", "concat('v', id) AS v")
    target.write.parquet(path)
    target = spark.read.schema(target.schema).parquet(path)
    delta = spark.range(60).selectExpr("concat('k', id * 31) AS k", "cast(5000 AS int) AS t", "'new' AS v")
    plans = {}

    def build():
        plans["new"] = merge.new_rows(target, delta, ["k"], ["t"])
        plans["replace"] = merge.replace_by_key(target, delta, ["k"])
        plans["upsert"] = merge.upsert_latest(target, delta, ["k"], ["t"])

    assert jobs_of(spark, build) == 0
    text = plans["new"]._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "ReadSchema: struct<k:string>" in text
    known = {f"k{i}" for i in range(900)}
    keys = {f"k{i * 31}" for i in range(60)}
    assert {r.k for r in plans["new"].collect()} == keys - known
    replaced = plans["replace"].collect()
    assert len(replaced) == len(target.where(~F.col("k").isin(*keys)).collect()) + 60
    assert all(r.v == "new" for r in replaced if r.k in keys)
    upserted = plans["upsert"].collect()
    assert sorted(map(str, upserted)) == sorted(map(str, replaced))


def test_key_filter_lets_little_through_and_loses_nothing(spark):
    held = spark.range(5000).selectExpr("id * 7 AS k", "concat('s', id) AS s")
    table = spark.range(200_000).selectExpr("id AS k", "concat('s', id div 7) AS s")
    through = table.where(joins.key_filter(held, ["k", "s"], 1 << 17))
    assert through.join(held, ["k", "s"]).count() == 5000
    assert through.count() < 5000 + 0.02 * 200_000
    assert table.where(joins.key_filter(held.limit(0), ["k", "s"], 1 << 10)).count() == 0


def test_stream_keeps_its_state_over_restarts(spark):
    name, base = "task_runs", [task_run("r", "a", "success")]
    folder = pending_of(spark, name, [task_run("r", "a", "failed"), task_run("r", "b", "failed", 5), task_run("r", "b", "oom", 2)])
    out, checkpoint = new_path(spark, "out"), new_path(spark, "stream")
    target = frame(spark, name, base)
    absorb_stream(spark, name, folder, out, checkpoint)
    got = {r.task_name: r.status for r in read_absorbed(spark, name, target, folder, out).collect()}
    assert got == {"a": "success", "b": "oom"}
    merge.write_delta(frame(spark, name, [task_run("r", "b", "success", 1), task_run("r", "c", "success")]), folder, "b1")
    absorb_stream(spark, name, folder, out, checkpoint)
    winners = read_winners(spark, name, out)
    assert {(r.task_name, r.status, r.batch_id) for r in winners.collect()} == {("a", "failed", "b0"), ("b", "oom", "b0"), ("c", "success", "b1")}
    epochs = [n for n in list_names(spark, out)]
    absorb_stream(spark, name, folder, out, checkpoint)  # nothing new
    assert same(winners, read_winners(spark, name, out)) and len(epochs) >= 2


def test_an_epoch_that_failed_half_way_counts_once(spark, monkeypatch):
    from pyspark.errors import StreamingQueryException

    name = "task_runs"
    folder = pending_of(spark, name, [task_run("r", "a", "failed")], [task_run("r", "b", "success")])
    out, checkpoint = new_path(spark, "out"), new_path(spark, "stream")
    writer = type(spark.range(1).write)
    parquet = writer.parquet

    def broken(self, path, *a, **k):
        parquet(self, path, *a, **k)
        if f"{absorb.EPOCH}=" in path:
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(writer, "parquet", broken)
    with pytest.raises(StreamingQueryException):
        absorb_stream(spark, name, folder, out, checkpoint, files_per_trigger=1)
    monkeypatch.setattr(writer, "parquet", parquet)
    absorb_stream(spark, name, folder, out, checkpoint, files_per_trigger=1)
    assert sorted(r.task_name for r in read_winners(spark, name, out).collect()) == ["a", "b"]
    rows = spark.read.schema(TABLES[name]).parquet(out).collect()
    assert len(rows) == 2


def test_history_counts_oom_as_a_failure(spark):
    runs = frame(spark, "pipeline_runs", [("r1", "m", T0, None, "running"), ("r2", "m", T0, None, "running")])
    tasks = frame(
        spark, "task_runs", [task_run("r1", "a", "oom"), task_run("r1", "b", "upstream_failed"), task_run("r1", "c", "skipped")]
    )
    got = {r.run_id: r for r in history.run_summary(runs, tasks).collect()}
    assert (got["r1"].task_count, got["r1"].failed_count, got["r1"].skipped_count) == (3, 2, 1)
    assert (got["r2"].task_count, got["r2"].failed_count) == (0, 0)
    assert history.run_outcome(tasks).first().outcome == "failed"


def test_latest_status_is_the_later_one(spark):
    tasks = frame(spark, "task_runs", [task_run("r1", "a", "failed"), task_run("r2", "a", "success", 5)])
    assert [r.status for r in history.latest_status(tasks).collect()] == ["success"]


@pytest.mark.parametrize("per_trigger", [1, 1000])
@pytest.mark.parametrize("name", sorted(CASES))
def test_stream_equals_the_merge(spark, name, per_trigger):
    base, one, two = CASES[name]
    folder = pending_of(spark, name, one, two)
    out = new_path(spark, "out")
    absorb_stream(spark, name, folder, out, new_path(spark, "stream"), per_trigger)
    target = frame(spark, name, base)
    want = merge.merge_table(name, target, merge.read_deltas(spark, name, folder, ["b0", "b1"]))
    assert same(want, read_absorbed(spark, name, target, folder, out))


def test_upsert_leaves_rows_of_untouched_keys_alone(spark):
    target = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, t int")
    delta = spark.createDataFrame([("b", 2)], "k string, t int")
    rows = merge.upsert_latest(target, delta, ["k"], ["t"]).collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("a", 1), ("b", 2)]


def test_best_row_ignores_null_values(spark):
    from tableflow.operators.aggregates import best_row

    rows = spark.createDataFrame([("a", None), ("b", 5.0), ("c", 4.0)], "key string, value double")
    assert [tuple(r) for r in best_row(rows, "key", "value").collect()] == [("b", 5.0)]
