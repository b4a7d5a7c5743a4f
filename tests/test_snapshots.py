from tableflow.operators import snapshots as snap


def test_rows_diff_counts_copies_and_nulls(spark):
    old = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", None), ("b", None), ("d", 4)], "k string, v int")
    got = {tuple(r) for r in snap.rows_diff(old, new).collect()}
    assert got == {("a", 1, "removed", 1), ("b", None, "added", 1), ("c", 3, "removed", 1), ("d", 4, "added", 1)}
    assert snap.rows_diff(old, old).count() == 0
    assert snap.rows_diff(old.limit(0), new).count() == 3
