import hashlib

import pytest
from pyspark.sql import functions as F

from tableflow.session import new_path
from tableflow.sources import (
    describe_table, export_arrow, export_extract, import_arrow, literal_rows, materialize, partition_manifest,
    range_table, read_any, read_csv, read_table, read_union, replace_table, rows_from_json, rows_to_json,
    sample_rows, write_csv, write_partitions, write_table,
)


def test_sample_is_exact_and_independent_of_the_split(spark):
    want = sorted(range(5000), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    for parts in (1, 7):
        df = spark.range(5000).repartition(parts)
        for n in (0, 1, 333, 5000, 9000):
            assert {r.id for r in sample_rows(df, n, "id").collect()} == set(want[:n])


def test_union_fills_a_missing_column(spark):
    a = write_table(spark.sql("SELECT 1 AS x, 'p' AS y"), new_path(spark, "a"))
    b = write_table(spark.sql("SELECT 2 AS x"), new_path(spark, "b"))
    want = [(1, "p"), (2, None)]
    assert sorted(tuple(r) for r in read_union(spark, [a, b]).collect()) == want
    assert sorted(tuple(r) for r in read_union(spark, [a, b], "x int, y string").collect()) == want


def test_union_widens_differing_types(spark):
    a = write_table(spark.sql("SELECT 1L AS x"), new_path(spark, "a"))
    b = write_table(spark.sql("SELECT 2.5D AS x"), new_path(spark, "b"))
    for schema in (None, "x double"):
        assert sorted(r.x for r in read_union(spark, [a, b], schema).collect()) == [1.0, 2.5]


def test_csv_keeps_quotes_line_breaks_and_blanks(spark):
    texts = ['say "hi", ok', "two\nlines", " blank ", "back\\slash", "a,b"]
    rows = literal_rows(spark, list(enumerate(texts)), "id int, t string")
    back = read_csv(spark, write_csv(rows, new_path(spark, "texts")), rows.schema)
    assert [r.t for r in back.orderBy("id").collect()] == texts


ODD_TEXTS = [
    'say "hi", ok', "two\nlines", " blank ", "back\\slash", "a,b", '"', '""', "\n", "\n\n\n", "", None, 'x"\ny,"z', "end\r\nof\r\nline",
    "é,ü\n日本", 'a line\n"of" quotes\n\n', "long " * 40 + "\n" + "longer " * 60, "plain", "plain too", "1,2,3", "N/A",
]


@pytest.fixture
def tiny_ranges(spark):
    """Byte ranges of some dozens of bytes, so that rows span several of them."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda n: [spark.conf.set(name, str(n if name == names[0] else 1)) for name in names]
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("size", [17, 64, 500, 1 << 20])
def test_split_csv_equals_the_written_rows(spark, tiny_ranges, size):
    texts = [ODD_TEXTS[i * 7 % len(ODD_TEXTS)] for i in range(60)]
    rows = [(i, t, None if i % 9 == 0 else i / 4) for i, t in enumerate(texts)]
    df = literal_rows(spark, rows, "id int, `a b` string, v double")
    path = write_csv(df.repartition(2, "id"), new_path(spark, "odd"))
    want = [tuple(r) for r in read_csv(spark, path, df.schema, split_bytes=1 << 40).orderBy("id").collect()]
    tiny_ranges(size)
    got = read_csv(spark, path, df.schema, split_bytes=0)
    assert got.schema.names == df.columns
    assert [tuple(r) for r in got.orderBy("id").collect()] == want
    assert [r[1] for r in want if r[1] is not None] == [t for t in texts if t]


def test_one_large_csv_is_read_by_many_tasks(spark, tiny_ranges):
    df = spark.range(400).selectExpr("id", "concat('first \"', id, '\"\nsecond') AS t")
    path = write_csv(df.coalesce(1), new_path(spark, "one"))
    tiny_ranges(1000)
    assert spark.read.text(path).rdd.getNumPartitions() > 8
    got = read_csv(spark, path, df.schema)  # above the most a task reads, so it is split unasked
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "csv-lines" in plan
    assert sorted(got.collect()) == sorted(df.collect())


def test_split_csv_by_hand(spark, tmp_path, tiny_ranges):
    """Line feeds after carriage returns, empty lines, a header of two lines, no line feed at the end; an empty file."""
    (tmp_path / "a.csv").write_bytes(b'\r\n"i\r\nd",t\r\n1,"x\r\ny"\r\n\r\n2,\r\n3,"said ""so"""')
    (tmp_path / "b.csv").write_bytes(b"id,t\n4,z\n")
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"id,t\n")
    for size in (3, 10, 1000):
        tiny_ranges(size)
        got = read_csv(spark, str(tmp_path), "id int, t string", split_bytes=0)
        assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "x\r\ny"), (2, None), (3, 'said "so"'), (4, "z")]


def test_manifest_names_the_folder_on_disk(spark):
    df = spark.createDataFrame([("a b/c", 1), ("x+y", 2), (None, 3)], "z string, v int")
    path = write_partitions(df, "z", new_path(spark, "odd"))
    got = {r.z: r.path for r in partition_manifest(spark, path, "z").collect()}
    assert got == {"a b/c": "z=a b%2Fc", "x+y": "z=x+y", None: "z=__HIVE_DEFAULT_PARTITION__"}


def test_manifest_reads_no_data_column(spark):
    path = write_partitions(spark.range(50).selectExpr("id", "id % 3 AS z"), "z", new_path(spark, "few"))
    plan = partition_manifest(spark, path, "z")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_sample_scans_twice_and_starts_no_job(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    plan = sample_rows(orders, 20, "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan and "TakeOrdered" not in plan
    assert sample_rows(orders, 20, "o_orderkey").count() == 20


def test_csv_keeps_the_text_n_a(spark):
    rows = literal_rows(spark, [(1, "N/A"), (2, "Unknown")], "id int, name string")
    path = write_csv(rows, new_path(spark, "zones") + ".csv")
    assert {r.name for r in read_csv(spark, path, "id int, name string").collect()} == {"N/A", "Unknown"}
    assert read_any(spark, path).count() == 2
    with pytest.raises(ValueError):
        read_any(spark, "/x/y.unknown")


@pytest.mark.parametrize("rebalance", [False, True])
def test_partitions_and_manifest(spark, rebalance):
    df = spark.range(900).withColumn("city", F.when(F.col("id") < 300, "a").otherwise("b"))
    path = write_partitions(df, "city", new_path(spark, "cities"), rebalance)
    got = {(r.city, r.rows, r.path) for r in partition_manifest(spark, path, "city").collect()}
    assert got == {("a", 300, "city=a"), ("b", 600, "city=b")}


def test_materialize_counts_in_the_same_pass(spark):
    table, seen = materialize(spark.range(50).filter("id % 2 = 0"))
    assert (seen["rows"], table.count(), seen["large"]) == (25, 25, False)
    assert seen["bytes"] > 0


def test_replaced_table_holds_the_last_version(spark):
    path = new_path(spark, "warehouse")
    replace_table(spark.range(3), "t_replaced", path)
    assert replace_table(spark.range(5), "t_replaced", path).count() == 5


def test_arrow_round_trip_and_refusal(spark):
    assert import_arrow(spark, export_arrow(range_table(spark, 4))).count() == 4
    assert export_arrow(range_table(spark, 100_001)).num_rows == 100_001
    with pytest.raises(ValueError):
        export_arrow(range_table(spark, 11), max_rows=10)


def test_json_hand_off(spark):
    daily = spark.createDataFrame(
        [("2024-01-02", 80, 987.65), ("2024-01-01", 100, 1234.56)], "day string, n int, rev double"
    )
    packed = rows_to_json(daily, "day")
    assert packed.first()[0].startswith('[{"day":"2024-01-01","n":100')
    back = rows_from_json(packed, "rows_json", "day string, n int, rev double")
    assert sorted(back.collect()) == sorted(daily.collect())
    keyed = rows_to_json(daily.withColumn("k", F.lit("x")), "day", ["k"])
    assert keyed.columns == ["k", "rows_json"] and keyed.count() == 1


def test_extract_and_describe(spark):
    path = export_extract(spark.range(100), F.col("id") >= 50, 10, "id", new_path(spark, "x"))
    rows = read_table(spark, path, ["id"])
    assert rows.count() == 10 and rows.agg(F.min("id")).first()[0] >= 50
    assert [tuple(r) for r in describe_table(rows).collect()] == [("id", "bigint", 1)]


def test_given_schemas_are_those_of_the_files(spark, small):
    from tableflow.plans.fixtures import SCHEMAS, table

    for name in SCHEMAS:
        assert table(spark, small, name).schema == spark.read.parquet(f"{small}/{name}.parquet").schema
