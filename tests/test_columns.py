import hashlib
import math

from pyspark.sql import functions as F

from tableflow.functions import (
    array_bucket, array_join, array_map, chain_hash, contains_any, day_start, elapsed_ms,
    label_of, matches, mean, memory_tier, money_sum, slug, total,
)


def one(spark, column, **values):
    rows = [tuple(values.values())] if values else [(1,)]
    return spark.createDataFrame(rows, list(values) or ["x"]).select(column.alias("v")).first()[0]


def test_small_values_count_in_sums(spark):
    df = spark.createDataFrame([(4e-7,), (2e-7,), (None,)], "v double")
    row = df.agg(total(F.col("v")).alias("t"), mean(F.col("v")).alias("m")).first()
    assert math.isclose(row.t, 6e-7) and math.isclose(row.m, 3e-7)
    assert df.filter("v > 9").agg(money_sum(F.col("v")).alias("s")).first().s is None


def test_half_a_cent_goes_up_in_any_order(spark):
    values = [0.001, 0.002, 1.1, 2.2, 3.3, 0.002]  # 6.605
    for order in (values, values[::-1], sorted(values)):
        df = spark.createDataFrame([(v,) for v in order], "v double")
        assert df.agg(money_sum(F.col("v")).alias("s")).first().s == 6.61
    df = spark.createDataFrame([(1e10,), (0.004,), (1.0,)], "v double")
    assert df.agg(money_sum(F.col("v")).alias("s")).first().s == 1e10 + 1


def test_sums_keep_large_infinite_and_nan_values(spark):
    def sums(*values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return df.agg(money_sum(F.col("v")).alias("m"), total(F.col("v")).alias("t")).first()

    assert sums(1.25, 3e12)[0] == 3e12 + 1.25 and sums(-4e10)[1] == -4e10
    assert sums(1.0, float("inf"))[0] == float("inf")
    assert math.isnan(sums(1.0, float("nan"))[0]) and math.isnan(sums(float("nan"))[1])


def test_regex_end_is_the_end_of_the_text(spark):
    assert one(spark, matches(F.col("t"), r"^\d+$"), t="12") is True
    assert one(spark, matches(F.col("t"), r"^\d+$"), t="12\n") is False


def test_labels_slug_words(spark):
    labels = {1: "Card", 2: "Cash"}
    assert one(spark, label_of(F.col("c"), labels), c=2) == "Cash"
    assert one(spark, label_of(F.col("c"), labels), c=9) == "Other"
    assert one(spark, slug(F.col("t")), t="Staten Island East") == "staten_island_east"
    assert one(spark, contains_any(F.col("t"), ["e-mail", "a.b"]), t="MY E-MAIL") is True
    assert one(spark, contains_any(F.col("t"), ["a.b"]), t="axb") is False


def test_arrays_of_the_toy_graph(spark):
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    doubled, raised = array_map(a, lambda x: x * 2), array_map(a, lambda x: x + 100)
    assert one(spark, array_join(doubled, raised)) == [2, 4, 6, 101, 102, 103]
    nine = F.sequence(F.lit(0), F.lit(8))
    assert [one(spark, array_bucket(nine, 3, r)) for r in range(3)] == [[0, 3, 6], [1, 4, 7], [2, 5, 8]]


def test_chain_hash_puts_a_zero_byte_after_every_part(spark):
    want = hashlib.sha256(b"a\0bc\0\0").hexdigest()
    assert one(spark, chain_hash(F.lit("a"), F.lit("bc"), F.lit(None))) == want


def test_memory_tiers(spark):
    peaks = [1.0, 102.4, 102.5, 819.2, 3276.8, 3277.0, 99999.0]
    df = spark.createDataFrame([(p,) for p in peaks], "p double")
    got = [r[0] for r in df.select(memory_tier(F.col("p"))).collect()]
    assert got == [128, 128, 256, 1024, 4096, 4096, 4096]


def test_times(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.5' AS a, timestamp_ntz'2024-01-02 03:04:06' AS b")
    row = df.select(day_start(F.col("a")).alias("d"), elapsed_ms(F.col("a"), F.col("b")).alias("ms"))
    assert row.schema["d"].dataType.simpleString() == "timestamp_ntz"
    assert row.first().ms == 500.0
