"""Shards and vector operators: odd rows, clashing names, and plain Python beside them."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableflow.llm import codes, negatives, sharding, vectors

INF, NAN = float("inf"), float("nan")


def shards_of(rows, n):
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < n for s in counts)
    sizes = [counts.get(s, 0) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    return sizes


def test_shards_hold_the_mixture(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 30}", f"t{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = sharding.interleave(sharding.sized(docs), 7).collect()
    shards_of(out, 7)
    of = Counter(r.source for r in out)
    for source, n in of.items():
        each = Counter(r.shard for r in out if r.source == source)
        assert all(abs(each[s] - n / 7) <= 1 + n / 6000 * len(of) / 4 + 1 for s in range(7)), source


def test_shards_do_not_depend_on_how_rows_are_stored(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    one = {tuple(r) for r in sharding.interleave(docs.coalesce(1), 5).collect()}
    two = {tuple(r) for r in sharding.interleave(docs.orderBy(F.rand(1)).repartition(9), 5).collect()}
    assert one == two
    assert one != {tuple(r) for r in sharding.interleave(docs, 5, seed=18).collect()}


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None, "x", 1), (None, None, None, "x", 1), (1, "", None, "x", 1), (1, "", "a", None, 2), (2, "é" * 200_000, "a", "y", 3)]
    rows += [(7, "same", "a", "same", 4)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, task string, Slot int")
    out = sharding.interleave(sharding.sized(docs), 24).collect()
    assert len(out) == 505 and out[0].__fields__ == ["doc_id", "text", "source", "task", "size", "text_crc32", "shard", "slot"]
    shards_of(out, 24)
    assert Counter(r.task for r in out) == {"x": 3, "y": 1, None: 1, "same": 500}
    assert {r.size for r in out if r.doc_id is None} == {8} and [r.size for r in out if r.doc_id == 2] == [400_008]
    assert sum(shards_of(sharding.interleave(docs.limit(3), 24).collect(), 24)) == 3
    assert sharding.interleave(docs.limit(0), 24).count() == 0


def test_a_row_repeated_often_is_dealt_to_many_tasks(spark):
    docs = spark.range(40_000).select(F.lit(1).alias("doc_id"), F.lit("hot").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = sharding._numbered(docs, [F.col("source"), F.col("doc_id")], "hot")
        sizes = [r["count"] for r in ranked.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 2 and max(sizes) < 30_000
    shards_of(sharding.interleave(docs, 3).collect(), 3)


def test_sharding_plan_has_no_python(spark, small):
    from tableflow.llm.queries import QUERIES

    plan = QUERIES["op11_interleaved_shards"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


VECTORS = [
    (0, [1.0, -0.5, 0.25, 0.1], 1), (1, [0.9, -0.5, 0.2, 0.1], 1), (1, [0.9, -0.5, 0.2, 0.1], 1), (2, None, 1), (3, [1.0, None, 0.0, 0.0], 1),
    (4, [1.0, NAN, 0.0, 0.0], 1), (5, [INF, 0.0, 0.0, 0.0], 1), (6, [0.5, 0.5], None), (None, [0.3, 0.3, 0.3, 0.3], 2), (8, [], 2),
    (9, [float(1 << 20), 0.0, 0.0, 0.0], 2), (10, [-0.001, 0.0, 0.001, 0.0], None), (100, [1.0, 0.0, 0.0, 0.1], 2), (100, [1.0, 0.0, 0.0, 0.1], 2),
    (12, [0.8, 0.0, 0.0, 0.1], 1), (13, [0.8, 0.0, 0.0, 0.1], 3),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*v, "c", "n") for v in VECTORS]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, Code string, number string")


def plain_codes(rows, parts, entries, rounds):
    width = -(-max(len(v) for _, v in rows) // parts)
    cells = np.zeros((len(rows), parts * width), np.int64)
    for i, (_, v) in enumerate(rows):
        cells[i, : len(v)] = [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, cells[i][: len(rows[i][1])].tolist()))
    cells = cells.reshape(len(rows), parts, width)
    books = cells[order[:entries]].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        far = ((cells[:, :, None, :] - books[None]) ** 2).sum(3)
        code = far.argmin(2)
        if step < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = cells[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    return Counter((rows[i][0], bytes(code[i].tolist()).hex(), int(far[i].min(1).sum())) for i in range(len(rows))), books


def kept(rows):
    return [(k, v) for k, v, _ in rows if v is not None and all(x is not None and abs(x) < 1 << 19 for x in v)]


@pytest.mark.parametrize("entries", [3, 64])
def test_codes_of_odd_rows(table, entries):
    coded, books = codes.compress(table, parts=2, entries=entries)
    rows = codes.with_label_error(coded).collect()
    expected, plain_books = plain_codes(kept(VECTORS), 2, entries, 2)
    assert Counter((r.vec_id, r.code, r.error) for r in rows) == expected
    assert (books.entries == plain_books).all()
    assert rows[0].__fields__ == ["vec_id", "label", "number", "code", "error", "label_error"] and {r.number for r in rows} == {"n"}
    for label in {r.label for r in rows}:
        assert {r.label_error for r in rows if r.label == label} == {sum(r.error for r in rows if r.label == label)}


def test_codes_of_random_vectors_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 32) / 7).astype(np.float32).tolist(), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    coded, books = codes.compress(df, parts=16, entries=64, rounds=2)
    expected, plain_books = plain_codes([r[:2] for r in rows], 16, 64, 2)
    assert (books.entries == plain_books).all()
    assert Counter((r.vec_id, r.code, r.error) for r in coded.collect()) == expected
    back = {r.vec_id: r.cells for r in codes.decompress(coded, books).collect()}
    for r in coded.collect()[:50]:
        own = [int(np.floor(x * 256)) for x in rows[r.vec_id][1]]
        assert sum((a - b) ** 2 for a, b in zip(own, back[r.vec_id], strict=True)) == r.error


def test_bounds_prune_without_a_change():
    rng = np.random.default_rng(5)
    points, entries = rng.integers(-200, 200, (500, 4)), rng.integers(-200, 200, (64, 4))
    pivots = codes.far_apart(entries, 4)
    entry, best = codes.nearest(points, codes.distances(points, pivots), entries, pivots)
    far = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (entry == far.argmin(1)).all() and (best == far.min(1)).all()


def test_codes_of_nothing(table):
    coded, books = codes.compress(table.limit(0))
    assert codes.with_label_error(coded).count() == 0 and books.entries.shape[1] == 0
    assert len(books.digest()) == 64
    assert codes.compress(table.where("vec_id = 2"))[0].count() == 0


def plain_negatives(rows):
    use = [(k, dict(enumerate(int(np.floor(np.float64(np.float32(x)) * 256)) for x in v)), y) for k, v, y in rows if y is not None and k is not None]
    out = []
    for i, (a, va, ya) in enumerate(use):
        if a % 100:
            continue
        scored = [(-sum(x * v.get(j, 0) for j, x in va.items()), k, y, n) for n, (k, v, y) in enumerate(use)]
        scored.sort(key=lambda s: s[:2])
        for p, pk, _, _ in [s for s in scored if s[2] == ya and s[3] != i][:5]:
            hard = [s for s in scored if s[2] != ya and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(a, pk, n + 1, s[1], -p, -s[0]) for n, s in enumerate(hard)]
    return Counter(out)


def test_negatives_of_odd_rows(table):
    got = negatives.mine(table, F.expr("vec_id % 100 = 0")).collect()
    usable = [v for v in VECTORS if v[1] is not None and all(x is not None and abs(x) < 1 << 19 for x in v[1])]
    assert Counter(map(tuple, got)) == plain_negatives(usable) and got
    assert negatives.mine(table.limit(0), F.expr("vec_id % 100 = 0")).count() == 0
    assert negatives.mine(table, F.lit(None).cast("boolean")).count() == 0


def test_negatives_with_many_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "TILE", 2)
    monkeypatch.setattr(negatives, "ROWS", 37)
    rng = np.random.default_rng(9)
    rows = [(i * 10, (rng.integers(-2, 3, 12) / 4).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert Counter(map(tuple, negatives.mine(df, F.expr("vec_id % 100 = 0")).collect())) == plain_negatives(rows)


@pytest.mark.parametrize("most", [3, 1 << 12, 1 << 26])
def test_subset_sums_give_the_inner_product(most):
    rng = np.random.default_rng(most)
    anchors, cells = rng.integers(-most, most, (9, 24)), rng.integers(-most, most, (50, 24))
    assert (negatives.scores(negatives.tables(anchors), negatives.planes(cells)) == cells @ anchors.T).all()


def test_usable_vectors(spark, table):
    assert table.where(vectors.usable("embedding")).count() == len(kept(VECTORS))
