import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tableflow.operators import history, lineage, refresh

DIAMOND = [("double", "extract"), ("shift", "extract"), ("load", "double"), ("load", "shift")]


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "task_name string, upstream_task_name string")


def names_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "task_name string")


def test_diamond(spark):
    edges, nodes = edges_of(spark, DIAMOND), names_of(spark, ["extract", "double", "shift", "load", "alone"])
    got = {r.task_name: r.level for r in lineage.levels(edges, nodes).collect()}
    assert got == {"extract": 1, "alone": 1, "double": 2, "shift": 2, "load": 3}
    assert {r.task_name for r in lineage.roots(edges, nodes).collect()} == {"extract", "alone"}
    below = lineage.descendants(edges, names_of(spark, ["extract"]))
    assert {r.task_name: r.distance for r in below.collect()} == {"double": 1, "shift": 1, "load": 2}
    lists = {r.task_name: r.depends_on for r in history.task_adjacency(edges, nodes).collect()}
    assert lists == {"extract": [], "alone": [], "double": ["extract"], "shift": ["extract"], "load": ["double", "shift"]}


def test_failure_reaches_descendants_and_spares_siblings(spark):
    edges = edges_of(spark, [("boom", "ok_root"), ("sibling", "ok_root"), ("down", "boom"), ("deep", "down")])
    status = [("ok_root", "success"), ("boom", "failed"), ("sibling", "success"), ("down", "success"), ("deep", "success")]
    got = lineage.propagate_failure(edges, spark.createDataFrame(status, "task_name string, status string"))
    assert {r.task_name: r.status for r in got.collect()} == {
        "ok_root": "success", "boom": "failed", "sibling": "success", "down": "upstream_failed", "deep": "upstream_failed",
    }


def test_cycle(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "a"), ("c", "b"), ("b", "root")])
    assert [r.task_name for r in lineage.cycle_members(edges).collect()] == ["a", "b", "c"]
    assert [r.task_name for r in lineage.levels(edges).collect()] == ["root"]
    assert lineage.cycle_members(edges_of(spark, DIAMOND)).count() == 0
    assert {r.task_name for r in lineage.descendants(edges, names_of(spark, ["a"])).collect()} == {"a", "b", "c"}


def test_no_edges_and_no_sources(spark):
    none = edges_of(spark, [])
    assert [tuple(r) for r in lineage.levels(none, names_of(spark, ["x"])).collect()] == [("x", 1)]
    assert lineage.descendants(edges_of(spark, DIAMOND), names_of(spark, [])).count() == 0


def plain_walks(pairs, nodes, sources):
    """Levels, nodes without one, and distances below the sources, in plain Python."""
    ups, below = {}, {}
    for task, up in set(pairs):
        ups.setdefault(task, set()).add(up)
        below.setdefault(up, set()).add(task)
    level, names = {}, set(nodes) | {n for pair in pairs for n in pair}
    while True:
        free = [n for n in names - set(level) if ups.get(n, set()) <= set(level)]
        if not free:
            break
        level.update({n: 1 + max((level[u] for u in ups.get(n, ())), default=0) for n in free})
    distance, ring, step = {}, set(sources), 0
    while ring:
        step += 1
        ring = {t for n in ring for t in below.get(n, ())} - set(distance)
        distance.update({n: step for n in ring})
    return level, names - set(level), distance


@pytest.mark.parametrize("growth", [0, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_walks_equal_brute_force(spark, monkeypatch, growth, seed):
    monkeypatch.setattr(lineage, "GROWTH", growth)
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(40)]
    pairs = [(names[i], names[rng.randrange(max(0, i - 6), i)]) for i in range(1, 40) for _ in range(2)]
    if seed > 1:  # some cycles, one of them a task that waits for itself
        pairs += [(names[20], names[30]), ("loop", "loop"), ("after", "loop")]
    nodes, sources = [*names, "alone"], rng.sample(names, 3)
    level, stuck, distance = plain_walks(pairs, nodes, sources)
    edges = edges_of(spark, pairs)
    assert {r.task_name: r.level for r in lineage.levels(edges, names_of(spark, nodes)).collect()} == level
    assert {r.task_name for r in lineage.cycle_members(edges, names_of(spark, nodes)).collect()} == stuck
    got = lineage.descendants(edges, names_of(spark, sources)).collect()
    assert {r.task_name: r.distance for r in got} == distance and len(got) == len(distance)


def test_a_long_chain_takes_few_rounds_over_fewer_and_fewer_pairs(spark, monkeypatch):
    chain = spark.range(1, 2000).selectExpr("id AS task_name", "id - 1 AS upstream_task_name")
    rounds, sizes = [], []
    add, materialize = lineage.Rounds.add, lineage.materialize
    monkeypatch.setattr(lineage.Rounds, "add", lambda self, *a, **k: rounds.append(1) or add(self, *a, **k))

    def counted(df, *a):
        table, seen = materialize(df, *a)
        sizes.append(seen["rows"])
        return table, seen

    monkeypatch.setattr(lineage, "materialize", counted)
    got = {r.task_name: r.distance for r in lineage.descendants(chain, spark.range(1).toDF("task_name")).collect()}
    assert got == {i: i for i in range(1, 2000)}
    assert len(rounds) <= 15 and len(sizes) <= 15 and sizes == sorted(sizes, reverse=True) and sizes[-1] == 0
    rounds.clear()
    got = {r.task_name: r.level for r in lineage.levels(chain).collect()}
    assert got == {i: i + 1 for i in range(2000)} and len(rounds) <= 15


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_below_the_peeled_waves(spark, monkeypatch, seed):
    monkeypatch.setattr(lineage, "WAVES", 3)
    rng = random.Random(seed)
    pairs = [(f"n{i:02}", f"n{rng.randrange(max(0, i - 4), i):02}") for i in range(1, 30) for _ in range(3)]
    if seed > 1:
        pairs += [("n10", "n20"), ("loop", "loop")]
    level, stuck, _ = plain_walks(pairs, [], [])
    assert max(level.values()) > 4
    edges = edges_of(spark, pairs + pairs[:5])
    assert {r.task_name: r.level for r in lineage.levels(edges).collect()} == level
    assert {r.task_name for r in lineage.cycle_members(edges).collect()} == stuck


def test_levels_of_a_branching_graph_make_no_pairs_and_touch_a_task_when_an_upstream_goes(spark, monkeypatch):
    n = 600
    pairs = {(i, j) for i in range(1, n) for j in (i // 2, i // 3) if j}
    edges = spark.createDataFrame(sorted(pairs), "task_name long, upstream_task_name long")
    sizes, rows = [], []
    materialize, add = lineage.materialize, lineage.Rounds.add

    def counted(df, *a):
        table, seen = materialize(df, *a)
        sizes.append(seen["rows"])
        return table, seen

    def noted(self, *a, **k):
        seen = add(self, *a, **k)
        rows.append(seen["rows"])
        return seen

    monkeypatch.setattr(lineage, "materialize", counted)
    monkeypatch.setattr(lineage.Rounds, "add", noted)
    got = {r.task_name: r.level for r in lineage.levels(edges).collect()}
    assert got == plain_walks(pairs, [], [])[0]
    assert max(sizes) <= len(pairs) and sum(rows) <= n + 2 * len(pairs)


def test_the_driver_gets_no_large_side_of_a_preview_or_walk(spark, tmp_path):
    rows = spark.range(40000).selectExpr("concat('t', id) AS task_name", "sha2(cast(id AS string), 256) AS fingerprint")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    preview = refresh.refresh_preview(rows.withColumn("cacheable", F.lit(True)), rows, rows)
    walk = lineage._look_up(rows, rows.select("task_name"), ["task_name"], "left_semi")
    for df in (preview, walk):
        assert len(df.collect()) == 40000  # so that the plan is the final one
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def combine(*parts):
    return hashlib.sha256(b"".join(p.encode() + b"\0" for p in parts)).hexdigest()


def prints_of(spark, change=None, edges=DIAMOND):
    names = sorted({n for pair in edges for n in pair})
    defs = [(n, f"src {n}" + ("!" if n == change else ""), "cfg") for n in names]
    df = spark.createDataFrame(defs, "task_name string, source string, config string")
    got = refresh.propagate_fingerprints(df, edges_of(spark, edges))
    return {r.task_name: r.fingerprint for r in got.collect()}


def test_fingerprints_chain_downstream(spark):
    base = prints_of(spark)
    assert base["extract"] == combine("src extract", "cfg")
    assert base["double"] == combine("src double", "cfg", "extract=" + base["extract"])
    assert base["load"] == combine("src load", "cfg", "double=" + base["double"], "shift=" + base["shift"])
    other = prints_of(spark, "double")
    assert {n for n in base if base[n] != other[n]} == {"double", "load"}


def test_upstreams_are_in_the_order_of_their_names(spark):
    base = prints_of(spark, edges=[("end", "part_10"), ("end", "part_1"), ("end", "part-1")])
    ups = [f"{n}={base[n]}" for n in ("part-1", "part_1", "part_10")]
    assert base["end"] == combine("src end", "cfg", *ups)
    defs = spark.createDataFrame([("t", "s", "c", list(reversed(ups)))], "task_name string, source string, config string, upstreams array<string>")
    assert refresh.definition_fingerprint(defs).first().fingerprint == combine("s", "c", *ups)


def test_hub_fingerprint_sees_every_upstream(spark):
    wide = [("hub", f"u{i:03}") for i in range(60)] + [("end", "hub")]
    base = prints_of(spark, edges=wide)
    other = prints_of(spark, "u031", edges=list(reversed(wide)))
    assert {n for n in base if base[n] != other[n]} == {"u031", "hub", "end"}


@pytest.fixture
def state(spark):
    defs = spark.createDataFrame(
        [("a", "f1", True), ("b", "f1", True), ("c", "f1", False), ("d", "f2", True), ("e", "f1", True)],
        "task_name string, fingerprint string, cacheable boolean",
    )
    stored = spark.createDataFrame(
        [("a", "f1"), ("b", "f0"), ("c", "f1"), ("d", "f2")], "task_name string, fingerprint string"
    )
    cache = spark.createDataFrame(
        [("a", "f1"), ("a", "f1"), ("b", "f1"), ("c", "f1"), ("d", "f1")], "task_name string, fingerprint string"
    )
    return defs, stored, cache


def test_preview_and_resume(spark, state):
    preview = refresh.refresh_preview(*state)
    assert {r.task_name: r.next_run for r in preview.collect()} == {
        "a": "skip (unchanged)", "b": "run (changed)", "c": "run (not cached)", "d": "run (changed)", "e": "run (changed)",
    }
    edges = edges_of(spark, [("a", "b"), ("x", "a")])
    assert {r.task_name for r in lineage.resume_set(preview, edges).collect()} == {"a", "b", "c", "d", "e", "x"}
    defs, stored, cache = state
    first = refresh.refresh_preview(defs, stored.limit(0), cache)
    assert {r.next_run for r in first.collect()} == {"run (no prior state)"}


def test_ready_names_the_blocker(spark, state):
    defs, stored, _ = state
    edges = edges_of(spark, [("a", "b"), ("a", "e"), ("d", "c")])
    got = {r.task_name: (r.ready, r.blockers, r.first_blocker) for r in refresh.ready_to_run(defs, edges, stored).collect()}
    assert got["a"] == (False, 2, "b") and got["d"] == (True, 0, None) and got["c"][0]


def test_duplicate_names(spark):
    defs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], "task_name string, fingerprint string")
    assert [r.task_name for r in lineage.duplicate_names(defs).collect()] == ["a"]


def test_refresh_recomputes_only_what_changed(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("r", 3)], "p string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 9), ("n", 4)], "p string, v int")
    changes = refresh.changed_partitions(
        refresh.table_fingerprint(old, "p", ["v"]), refresh.table_fingerprint(new, "p", ["v"]), "p"
    )
    assert {r.p: r.state for r in changes.collect()} == {"a": "same", "b": "changed", "r": "removed", "n": "added"}

    def total(rows, tag):
        return rows.groupBy("p").agg(F.sum("v").alias("s")).withColumn("tag", F.lit(tag))

    target = total(old, "old")
    got = refresh.refresh(target, new, "p", changes, lambda d: total(d, "new"))
    assert {(r.p, r.s, r.tag) for r in got.collect()} == {("a", 1, "old"), ("b", 9, "new"), ("n", 4, "new")}
    forced = refresh.refresh(target, new, "p", changes, lambda d: total(d, "new"), force=True)
    assert {(r.p, r.tag) for r in forced.collect()} == {("a", "new"), ("b", "new"), ("n", "new")}


def test_fingerprint_ignores_order_and_sees_copies_and_nulls(spark):
    def fp(rows):
        df = spark.createDataFrame([("p", *r) for r in rows], "p string, a string, b string").repartition(3)
        return refresh.table_fingerprint(df, "p", ["a", "b"]).first().fingerprint

    base = fp([("x", "y"), ("z", None)])
    assert fp([("z", None), ("x", "y")]) == base
    assert fp([("x", "\\N")]) != fp([("x", None)]) and fp([("a:b", "c")]) != fp([("a", "b:c")])
    assert len({base, fp([("x", "y"), ("z", "")]), fp([("x", "y"), ("z", None), ("z", None)]), fp([("x", "y"), (None, "z")])}) == 4


def test_a_changed_row_reads_one_range_of_the_hash_tree(spark):
    from tableflow.session import new_path

    cols, schema = ["k", "v"], "k int, v string, p string"
    path = new_path(spark, "ranged")
    rows = spark.range(4000).selectExpr("cast(id AS int) AS k", "concat('v', id % 7) AS v", "CASE WHEN id % 2 = 0 THEN 'a' WHEN id < 3000 THEN 'b c' END AS p")
    rows = rows.unionByName(spark.sql("SELECT cast(NULL AS int) AS k, 'x' AS v, 'a' AS p"))
    refresh.write_ranges(rows, path, "p", "k", 500)
    trees = [f"{path}-t{i}" for i in range(4)]
    refresh.build_tree(spark, path, trees[0], schema, "p", cols)
    assert spark.read.parquet(trees[0]).count() == 8 + 6 + 2 + 1

    def whole():
        return sorted(map(str, refresh.table_fingerprint(spark.read.schema(schema).parquet(path), "p", cols).collect()))

    def upper(tree):
        return sorted(map(str, refresh.tree_fingerprint(spark, tree, "p").collect()))

    assert upper(trees[0]) == whole()
    one = rows.where("p = 'b c' AND k >= 1000 AND k < 1500")
    refresh.overwrite_ranges(one.withColumn("v", F.when(F.col("k") == 1001, "new").otherwise(F.col("v"))), path, "p", "k", 500)
    seen = []
    leaves = refresh._leaves
    refresh._leaves = lambda rows, *a: seen.append(len(rows.inputFiles())) or leaves(rows, *a)
    try:
        changed = refresh.refresh_tree(spark, path, trees[0], trees[1], schema, "p", cols).collect()
    finally:
        refresh._leaves = leaves
    assert [r.state for r in changed] == ["changed"] and changed[0].folder.endswith("key_range=2") and seen == [1]
    assert upper(trees[1]) == whole() != upper(trees[0])
    refresh.overwrite_ranges(spark.sql("SELECT 9999 AS k, 'v' AS v, 'z' AS p"), path, "p", "k", 500)
    changed = refresh.refresh_tree(spark, path, trees[1], trees[2], schema, "p", cols).collect()
    assert [r.state for r in changed] == ["added"] and upper(trees[2]) == whole()
    assert refresh.refresh_tree(spark, path, trees[2], trees[3], schema, "p", cols).count() == 0


def test_refresh_keeps_and_drops_null_partitions(spark):
    from tableflow.session import new_path

    def table(*rows):
        return spark.createDataFrame(list(rows), "p string, v int")

    def prints(df):
        return refresh.table_fingerprint(df, "p", ["v"])

    def total(rows):
        return rows.groupBy("p").agg(F.sum("v").alias("s"))

    v1, v2, v3 = table((None, 1), ("a b", 2)), table((None, 1), ("a b", 3)), table(("c", 4))
    path = new_path(spark, "parts")
    total(v1).write.partitionBy("p").parquet(path)
    for old, new in ((v1, v2), (v2, v3)):
        changes = refresh.changed_partitions(prints(old), prints(new), "p")
        got = refresh.refresh(total(old), new, "p", changes, total)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in total(new).collect()}
        refresh.refresh_stored(path, new, "p", changes, total)
        stored = spark.read.schema("s bigint, p string").parquet(path).select("p", "s").collect()
        assert {tuple(r) for r in stored} == {tuple(r) for r in total(new).collect()}


def test_stored_refresh_drops_a_changed_partition_that_ends_empty(spark):
    from tableflow.session import new_path

    def kept(rows):
        return rows.filter("v > 0").groupBy("p").agg(F.sum("v").alias("s"))

    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "p string, v int")
    new = spark.createDataFrame([("a", -1), ("b", 5), ("c", 3)], "p string, v int")
    path = new_path(spark, "parts")
    kept(old).write.partitionBy("p").parquet(path)
    changes = spark.createDataFrame([("a", "changed"), ("b", "changed"), ("c", "same")], "p string, state string")
    refresh.refresh_stored(path, new, "p", changes, kept)
    assert {(r.p, r.s) for r in spark.read.schema("s bigint, p string").parquet(path).collect()} == {("b", 5), ("c", 3)}
    with pytest.raises(ValueError):
        refresh.refresh_stored(path, new, "p", spark.createDataFrame([("", "added")], "p string, state string"), kept)


def test_few_and_many_changed_partitions_take_different_ways(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "p string, v int")
    changes = spark.createDataFrame([("a", "changed"), (None, "added"), ("c", "same")], "p string, state string")
    for max_names in (0, 1000):
        got = refresh.only(df, changes, "p", "added", "changed", max_names=max_names)
        assert sorted(r.v for r in got.collect()) == [1, 3]
        assert refresh.only(df, changes, "p", "removed", max_names=max_names).count() == 0


def test_refresh_reads_only_changed_folders(spark):
    from tableflow.session import new_path

    path = new_path(spark, "source")
    spark.range(100).selectExpr("id AS v", "cast(id % 5 AS int) AS p").write.partitionBy("p").parquet(path)
    changes = spark.createDataFrame([(1, "changed"), (2, "same"), (3, "added")], "p int, state string")
    plan = refresh.only(spark.read.parquet(path), changes, "p", "added", "changed")
    assert {r.p for r in plan.collect()} == {1, 3}
    assert "PartitionFilters: [p" in plan._jdf.queryExecution().executedPlan().toString()
