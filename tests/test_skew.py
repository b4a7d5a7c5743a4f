"""The ways for large and hot inputs give the same rows as the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tableflow.operators import aggregates as agg
from tableflow.operators import joins, merge, windows


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows share one key; some keys have no match, some are NULL."""
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.34 else rng.randrange(2, 60), i) for i in range(3000)]
    rows += [(None, i) for i in range(9000, 9600)]
    return spark.createDataFrame(rows, "k int, v int").cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(spark, facts, how):
    dim = spark.range(40).selectExpr("cast(id AS int) AS k", "concat('d', id) AS name")
    plain = facts.join(dim, "k", how)
    split = joins.join_unique(facts, dim, ["k"], how, small_bytes=0)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_spread_in_one_plan(spark):
    """The rows of a key with a third of the table, and rows without a key, come out of many tasks."""
    facts = spark.range(90_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id ELSE NULL END AS k", "id AS v")
    dim = spark.range(90_000).selectExpr("id AS k", "id AS w")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = joins.join_unique(facts, dim, ["k"], "left", small_bytes=0)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 3 * 90_000 / 16 and got.where("k = 7 AND w = 7").count() == 30_001
        assert got.columns == ["k", "v", "w"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_sides_are_told_by_the_tables_they_come_from(spark, small):
    from tableflow.plans import fixtures as fx

    zones = fx.zones(spark, small)
    assert joins.is_small(zones) and 1000 < joins.read_bytes(zones) < 20_000 and not joins.is_small(zones, 1000)


@pytest.mark.parametrize("max_group", [None, 3, 20, 100, 1000])
@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_rolling_mean_equals_brute_force(spark, max_group, n):
    rng = random.Random((max_group or 0) * 10 + n)
    rows, want = [], {}
    for part, size in (("hot", 200), ("mid", 30), ("one", 1), ("late", 8), (None, 40)):
        start = 5000 if part == "late" else 0
        order = sorted(rng.sample(range(start, start + 1000), size))
        values = [float(rng.randrange(100)) for _ in order]
        for i, o in enumerate(order):
            rows.append((part, o, values[i]))
            last = values[max(0, i - n + 1) : i + 1]
            want[part, o] = round(sum(last) / len(last), 9)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "part string, o int, v double")
    got = windows.rolling_mean(df, "part", "o", "v", n, "m", max_group=max_group).collect()
    assert {(r.part, r.o): round(r.m, 9) for r in got} == want
    assert len(got) == len(rows)


def test_rolling_mean_over_timestamps_is_cut_alike(spark, small):
    from tableflow.plans import fixtures as fx

    events = fx.table(spark, small, "events").select("event_type", "ts", "value")
    plain = windows.rolling_mean(events, "event_type", "ts", "value", 4, "m", max_group=None)
    cut = windows.rolling_mean(events, "event_type", "ts", "value", 4, "m", max_group=50)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.select(*plain.columns).collect()))


def test_zone_day_totals_do_not_depend_on_the_way(spark, small):
    from tableflow.plans import fixtures as fx

    trips, zones = fx.trips(spark, small), fx.zones(spark, small)
    few = agg.borough_day(trips, zones)
    many = agg.borough_day(trips, zones, small_bytes=0)
    assert sorted(few.collect()) == sorted(many.collect())


def test_hub_has_one_sorted_list(spark):
    edges = spark.range(20_000).selectExpr("'hub' AS task_name", "concat('u', id) AS upstream_task_name")
    edges = edges.union(spark.sql("SELECT 'leaf', 'hub'")).union(spark.sql("SELECT 'leaf', 'a'"))
    lists = {r.task_name: r.depends_on for r in agg.upstream_list(edges).collect()}
    assert lists == {"hub": sorted(f"u{i}" for i in range(20_000)), "leaf": ["a", "hub"]}


def test_unseen_large_and_small_way(spark):
    target = spark.createDataFrame([(i % 5,) for i in range(100)], "k int")
    delta = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k int, v string")
    few = sorted(joins.unseen(target, delta, ["k"], small_bytes=1 << 62).collect())
    assert sorted(joins.unseen(target, delta, ["k"], small_bytes=0).collect()) == few
    assert [r.k for r in few] == [5, 6, 7, 8, 9]
    wide = delta.withColumn("k", F.col("k").cast("bigint"))
    assert [r.k for r in joins.unseen(target, wide, ["k"], small_bytes=0).orderBy("k").collect()] == [5, 6, 7, 8, 9]


def test_upsert_keeps_one_row_per_key(spark):
    target = spark.createDataFrame([(i, 5, "old") for i in range(6)], "k int, t int, v string")
    delta = spark.createDataFrame([(1, 9, "new"), (1, 7, "mid"), (2, 1, "late"), (8, 1, "add")], target.schema)
    want = {0: "old", 1: "new", 2: "old", 3: "old", 4: "old", 5: "old", 8: "add"}
    got = merge.upsert_latest(target, delta, ["k"], ["t", "v"]).collect()
    assert {r.k: r.v for r in got} == want and len(got) == len(want)
