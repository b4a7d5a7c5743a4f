"""Lineage as an edge table (task_name, upstream_task_name).

The graph walks run in rounds that double their reach, so a chain of n tasks
takes log2(n) of them. Every round writes its result to the shared work folder
and counts it in the same pass, so a lost executor costs one round and the plan
never grows. The driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.aggregates import FAILURES
from tableflow.operators.joins import WALK_BYTES, join_unique, shuffled
from tableflow.session import new_path, write_counted
from tableflow.sources.sink import materialize

#: Doubling a walk may make this many pairs for each edge of the graph; beyond that the walk goes on edge by edge.
GROWTH = 8

#: Levels are peeled off wave by wave, at most this many, where doubling the walks would make so many pairs an edge at once.
WAVES, BRANCHING = 32, 1.5


class Rounds:
    """Tables written one per round and read together, with the round number."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType | str):
        self.spark, self.base, self.schema, self.count = spark, base, schema, 0

    def add(self, df: DataFrame, **counts: Column) -> dict[str, int]:
        self.count += 1
        return write_counted(df, self.at(self.count), **counts)

    def at(self, n: int) -> str:
        return f"{self.base}/round={n}"

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.at(self.count))

    def read(self) -> DataFrame:
        schema = self.schema if isinstance(self.schema, T.StructType) else T.StructType.fromDDL(self.schema)
        numbered = T.StructType(schema.fields + [T.StructField("round", T.IntegerType())])
        return self.spark.read.schema(numbered).option("basePath", self.base).parquet(self.base)


def node_set(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    every = edges.select("task_name").union(edges.select("upstream_task_name"))
    if nodes is not None:
        every = every.union(nodes.select("task_name"))
    return every.distinct()


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without an upstream."""
    return nodes.select("task_name").distinct().join(edges.select("task_name").distinct(), "task_name", "left_anti")


def _look_up(df: DataFrame, unique: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``join_unique`` for the rounds of a walk, which are many: the driver holds small sides only."""
    return join_unique(df, unique, keys, how, WALK_BYTES)


def _composed(jumps: DataFrame) -> int:
    """Pairs that composing the jumps with themselves would make, before any is made."""
    into = jumps.groupBy(F.col("task_name").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    out = jumps.groupBy(F.col("upstream_task_name").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    return into.join(shuffled(out), "node").agg(F.sum(F.col("n_in") * F.col("n_out"))).first()[0] or 0


def _twice(jumps: DataFrame) -> DataFrame:
    """Pairs joined by two jumps, one after the other."""
    first = jumps.select(F.col("task_name").alias("middle"), "upstream_task_name")
    then = jumps.select("task_name", F.col("upstream_task_name").alias("middle"))
    return first.join(shuffled(then), "middle").select("task_name", "upstream_task_name").distinct()


def _depths(edges: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The level of every node that has one, and the nodes that have none.

    Where walks branch, doubling them makes many pairs, while most graphs are
    no deeper than ``WAVES``: the first waves are peeled, at the cost of one
    pass over nodes and edges in all. Only what is deeper, or does not branch,
    is doubled.
    """
    edges, seen = materialize(edges.distinct())
    if _composed(edges) <= BRANCHING * seen["rows"]:
        return _doubled(edges, nodes)
    waves, open_, n_open = peel(edges, nodes, WAVES)
    if not n_open:
        return waves, open_
    below, stuck = _doubled(_inner(edges, open_), open_)
    return waves.unionByName(below.select("task_name", (F.col("level") + WAVES).alias("level"))), stuck


def _inner(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between two of the nodes, which are distinct."""
    kept = _look_up(edges, nodes.select(F.col("task_name").alias("upstream_task_name")), ["upstream_task_name"], "left_semi")
    return _look_up(kept, nodes.select("task_name"), ["task_name"], "left_semi")


def _doubled(edges: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``_depths`` in rounds that double their reach.

    ``jumps`` holds the pairs that a walk of exactly ``step`` edges joins. A
    node's longest walk of fewer than ``2 * step`` edges is the better of the
    one found so far and ``step`` more than that of a node one jump up, so each
    round doubles the depth that is settled; a node that no jump reaches is
    settled for good. On or below a cycle walks never end: what jumps as long
    as there are nodes still reach has no level. Where doubling would make more
    than ``GROWTH`` pairs an edge, the nodes not settled are peeled instead.
    """
    spark = edges.sparkSession
    jumps, seen = materialize(edges)
    schema = T.StructType([jumps.schema["task_name"], T.StructField("level", T.IntegerType())])
    known = Rounds(spark, new_path(spark, "levels"), schema)
    n_nodes = known.add(node_set(jumps, nodes).select("task_name", F.lit(1).alias("level")))["rows"]
    first, budget, step = jumps, GROWTH * seen["rows"], 1
    while seen["rows"] and step < n_nodes:
        best = known.read().groupBy(F.col("task_name").alias("upstream_task_name")).agg(F.max("level").alias("level"))
        deeper = jumps.join(shuffled(best), "upstream_task_name").groupBy("task_name").agg((F.max("level") + step).alias("level"))
        known.add(deeper)
        if _composed(jumps) > budget:
            open_, _ = materialize(jumps.select("task_name").distinct())
            waves, stuck, _ = peel(_inner(first, open_), open_)
            settled = _look_up(known.read().select("task_name", "level"), open_, ["task_name"], "left_anti")
            found = settled.unionByName(waves.select("task_name", (F.col("level") + step).alias("level")))
            return found.groupBy("task_name").agg(F.max("level").alias("level")), stuck
        jumps, seen = materialize(_twice(jumps))
        step *= 2
    stuck, _ = materialize(jumps.select("task_name").distinct())
    found = known.read().groupBy("task_name").agg(F.max("level").alias("level"))
    return found.join(shuffled(stuck), "task_name", "left_anti"), stuck


def peel(edges: DataFrame, nodes: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Take off the nodes without open upstreams, in at most ``most`` waves.

    Answers the nodes with the wave they went in, the nodes that did not go,
    and how many of these might still go: 0 where none is left or all are stuck.
    Every edge carries how many upstreams its task needs. A wave counts the
    edges below the nodes gone last and adds them to those of the tasks that
    some upstreams have gone of; tasks it does not touch are not read. Used
    edges are dropped whenever half of the nodes that were left have gone.
    """
    spark = edges.sparkSession
    edges, _ = materialize(edges.distinct())
    zero, one = F.lit(0).cast("bigint").alias("open"), F.lit(1).cast("bigint").alias("open")
    start = edges.select("task_name", one).union(edges.select("upstream_task_name", zero))
    if nodes is not None:
        start = start.union(nodes.select("task_name", zero))
    counts = [T.StructField(name, T.LongType()) for name in ("need", "paid")]
    waves = Rounds(spark, new_path(spark, "peel"), T.StructType([edges.schema["task_name"], *counts]))
    start = start.groupBy("task_name").agg(F.sum("open").alias("need")).withColumn("paid", F.lit(0).cast("bigint"))
    seen = waves.add(start, free=F.col("need") == 0)
    begun = waves.last()
    held, free = seen["rows"], seen["free"]
    left = held - free
    if left and free:
        edges, _ = materialize(_needing(edges, begun))
    while left and free and waves.count != most:
        touched = waves.last()
        gone = touched.filter("paid = need").select(F.col("task_name").alias("upstream_task_name"))
        paid = _look_up(edges, gone, ["upstream_task_name"], "left_semi").groupBy("task_name")
        paid = paid.agg(F.max("need").alias("need"), F.count(F.lit(1)).alias("paid"))
        if waves.count > 1:  # the tasks of the first wave are all or nothing
            paid = touched.filter("paid < need").unionByName(paid).groupBy("task_name")
            paid = paid.agg(F.max("need").alias("need"), F.sum("paid").alias("paid"))
        free = waves.add(paid, free=F.col("paid") == F.col("need"))["free"]
        left -= free
        if left and left <= held / 2:
            held = left
            used = waves.read().filter(f"paid = need AND round < {waves.count}")  # the nodes that went last still count
            used = used.select(F.col("task_name").alias("upstream_task_name"))
            edges, _ = materialize(_look_up(edges, used, ["upstream_task_name"], "left_anti"))
    taken = waves.read().filter("paid = need").select("task_name", F.col("round").alias("level"))
    if not left:
        return taken, begun.select("task_name").where(F.lit(False)), 0
    marked = begun.select("task_name", F.lit(False).alias("gone")).unionByName(taken.select("task_name", F.lit(True).alias("gone")))
    rest, _ = materialize(marked.groupBy("task_name").agg(F.max("gone").alias("gone")).filter("NOT gone").select("task_name"))
    return taken, rest, left if free else 0


def _needing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``need``, how many upstreams their task has."""
    named, nameless = edges.filter("task_name IS NOT NULL"), edges.filter("task_name IS NULL")
    needs = nodes.filter("need > 0").select("task_name", "need")
    of_null = nameless.agg(F.count(F.lit(1))).scalar()
    return _look_up(named, needs, ["task_name"], "inner").unionByName(nameless.withColumn("need", of_null))


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Longest-path depth of every node: the wave in which it can start, from 1.

    Nodes on or below a cycle have no level; see ``cycle_members``.
    """
    return _depths(edges, nodes)[0]


def cycle_members(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes that are never free to start: on a cycle or below one, sorted."""
    return _depths(edges, nodes)[1].orderBy("task_name")


def descendants(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """All nodes below the sources, with the length of the shortest way.

    A source counts only when it is below a source itself. After each round
    all nodes up to ``step`` below are found and ``jumps`` holds the pairs that
    a walk of exactly ``step`` edges joins, so a jump from every found node
    doubles the reach. Jumps to a found node are dropped: a shortest way never
    needs them again. Where doubling would make more than ``GROWTH`` pairs an
    edge, the rest is walked edge by edge, on the edges not used yet.
    """
    spark = edges.sparkSession
    jumps, seen = materialize(edges.distinct())
    start = sources.select(F.col("task_name").alias("upstream_task_name")).distinct()
    schema = T.StructType([jumps.schema["task_name"], T.StructField("distance", T.IntegerType())])
    found = Rounds(spark, new_path(spark, "below"), schema)
    below = _look_up(jumps, start, ["upstream_task_name"], "left_semi")
    new = found.add(below.select("task_name").distinct().withColumn("distance", F.lit(1)))["rows"]
    budget, step = GROWTH * seen["rows"], 1
    jumps, seen = _unused(jumps, found)
    first = jumps
    while new and seen["rows"]:
        reached = found.read().select(F.col("task_name").alias("upstream_task_name"), "distance")
        ahead = jumps.join(shuffled(reached), "upstream_task_name").groupBy("task_name")
        new = found.add(ahead.agg((F.min("distance") + step).alias("distance")))["rows"]
        step *= 2
        if new and _composed(jumps) > budget:
            gone = found.read().select("task_name")
            _walk(_look_up(first, gone, ["task_name"], "left_anti"), found, step)
            break
        jumps, seen = _unused(_twice(jumps), found)
    return found.read().select("task_name", "distance")


def _unused(jumps: DataFrame, found: Rounds) -> tuple[DataFrame, dict[str, int]]:
    """The jumps to nodes that the last round did not find."""
    return materialize(_look_up(jumps, found.last().select("task_name"), ["task_name"], "left_anti"))


def _walk(edges: DataFrame, found: Rounds, distance: int) -> None:
    """Add one ring after the other below the nodes at ``distance``; an edge is dropped when its lower end is found."""
    edges, _ = materialize(edges)
    ring = found.read().filter(F.col("distance") == distance)
    size, kept = None, None
    while size != 0:
        ups = ring.select(F.col("task_name").alias("upstream_task_name"))
        below = _look_up(edges, ups, ["upstream_task_name"], "left_semi").select("task_name").distinct()
        if kept is not None:
            below = _look_up(below, kept, ["task_name"], "left_anti")
        distance += 1
        size = found.add(below.withColumn("distance", F.lit(distance)))["rows"]
        ring = found.last()
        kept = ring.select("task_name") if kept is None else kept.unionByName(ring.select("task_name"))
        if found.count % 4 == 0:  # the rings since the last drop stay few, and so does what is written again
            edges, _ = materialize(_look_up(edges, kept, ["task_name"], "left_anti"))
            kept = None


def propagate_failure(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes with every task below a failure set to ``upstream_failed``; siblings stay."""
    broken = outcomes.filter(F.col("status").isin(FAILURES))
    below = descendants(edges, broken).select("task_name", F.lit(True).alias("_below"))
    status = F.when(F.col("_below"), "upstream_failed").otherwise(F.col("status"))
    return outcomes.join(shuffled(below), "task_name", "left").select("task_name", status.alias("status"))


def duplicate_names(defs: DataFrame) -> DataFrame:
    """Names with more than one definition."""
    return (
        defs.groupBy("task_name")
        .agg(F.countDistinct("fingerprint").alias("definitions"))
        .filter("definitions > 1")
    )


def resume_set(preview: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks a resumed run has to run: those not skipped, and all below them."""
    again, _ = materialize(preview.filter(~F.col("next_run").startswith("skip")).select("task_name"))  # used twice
    return again.unionByName(descendants(edges, again).select("task_name")).distinct()
