"""Joins.

The side that is looked up has one row per key, so a hot key can sit on one
side only. ``join_unique`` is the way through which every such join goes. No
function here starts a job: what a plan has to know about its data (the most
frequent keys, which keys a delta holds) is a subquery of the plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch may name as frequent, and the places each of them is spread over.
HOT_KEYS, SPREAD = 64, 32

#: Bits of a key filter: 1 MB, one key in 16 falsely let through at half a million keys of a delta.
FILTER_BITS = 1 << 23


#: A job of very many joins broadcasts sides of up to this many bytes of files: a file's rows take many times its size on the driver.
WALK_BYTES = 1 << 18


def read_bytes(df: DataFrame) -> int:
    """Bytes of all tables that a plan reads, by Catalyst's statistics; starts no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether a side with one row per key comes from tables that Spark may broadcast."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() if most is None else most
    return read_bytes(df) <= limit


def shuffled(df: DataFrame, most: int = WALK_BYTES) -> DataFrame:
    """A side of a join that is not broadcast, neither by Catalyst's guess nor at run time, unless its tables are that small."""
    return df if is_small(df, most) else df.hint("merge")


def join_unique(
    df: DataFrame, unique: DataFrame, keys: Sequence[str], how: str, small_bytes: int | None = None
) -> DataFrame:
    """Join ``df`` to a side with one row per key (inner, left, left_semi or left_anti).

    A side read from small tables is broadcast. Otherwise both sides shuffle,
    salted: a sketch of the keys of ``df`` (one pass over the key columns, a few
    kilobytes) names the most frequent ones; their rows are spread over
    ``SPREAD`` places and the rows of ``unique`` for them are repeated there.
    Rows with a NULL key match nothing and are spread as well. A key that the
    sketch names without need costs ``SPREAD`` small rows and no more, and one
    that it misses holds too little of ``df`` to matter. With ``small_bytes``
    a larger side is not broadcast at run time either.
    """
    keys = list(keys)
    if is_small(unique, small_bytes):
        return df.join(F.broadcast(unique), keys, how)
    kinds = {k: unique.schema[k].dataType for k in keys}
    hashed = F.xxhash64(*[F.col(f"`{k}`").cast(kinds[k]) for k in keys])
    top = F.call_function("approx_top_k", hashed, F.lit(HOT_KEYS), F.lit(64 * HOT_KEYS))
    hot = df.agg(F.transform(top, lambda x: x["item"]).alias("hot")).scalar()
    is_hot = F.coalesce(F.array_contains(hot, hashed), F.lit(False))
    nothing = F.greatest(*[F.col(f"`{k}`").isNull() for k in keys], F.lit(False))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
    left = df.withColumn("_salt", F.when(is_hot | nothing, place).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = unique.withColumn("_salt", F.explode(copies))
    if small_bytes is not None:
        right = right.hint("merge")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def with_zone(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips with their zone; a trip without one drops. ``zones`` is unique per id."""
    return join_unique(trips, zones.withColumnRenamed("location_id", "pu_location_id"), ["pu_location_id"], "inner")


def keep_matching(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that have a match, without the columns of ``dim``."""
    return join_unique(df, dim.select(*on).distinct(), on, "left_semi")


def left_rollup(runs: DataFrame, tasks: DataFrame, key: str, aggs: Sequence) -> DataFrame:
    """Every run with aggregates over its tasks; a run without tasks stays, with NULLs.

    Tasks are aggregated first, so a run with very many tasks joins as one row.
    """
    return runs.join(tasks.groupBy(key).agg(*aggs), key, "left")


def key_filter(rows: DataFrame, keys: Sequence[str], bits: int = FILTER_BITS) -> Column:
    """A condition on any table with these keys: false only where no row of ``rows`` can have the key.

    A Bloom filter of two hashes, built by Spark as a subquery: every key sets
    two bits, bits are combined within each task and then per word, and the
    words come back as one array of ``bits`` / 64 numbers. Key columns must
    have the same types on both sides.
    """
    spark = rows.sparkSession

    def spots() -> list[Column]:
        first = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
        return [F.pmod(first, F.lit(bits)), F.pmod(F.xxhash64(first), F.lit(bits))]

    def bit(spot: Column) -> Column:
        return spot.bitwiseAND(F.lit(63)).cast("int")

    set_ = rows.select(F.explode(F.array(*spots())).alias("spot"))
    word = F.call_function("shiftright", F.col("spot"), F.lit(6)).alias("word")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("spot")))
    words = set_.groupBy(word).agg(F.bit_or(mask).alias("mask"))
    every = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("mask"))
    whole = words.unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    listed = whole.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words"))
    masks = listed.select(F.transform("words", lambda w: w["mask"]).alias("masks")).scalar()
    held = [
        F.call_function("shiftright", F.get(masks, F.call_function("shiftright", s, F.lit(6)).cast("int")), bit(s)).bitwiseAND(F.lit(1)) == 1
        for s in spots()
    ]
    return held[0] & held[1]


def as_typed(rows: DataFrame, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the key columns in the types they have in ``like``."""
    return rows.withColumns({k: F.col(f"`{k}`").cast(like.schema[k].dataType) for k in keys})


def unseen(target: DataFrame, delta: DataFrame, keys: Sequence[str], small_bytes: int | None = None) -> DataFrame:
    """Rows of ``delta`` whose key is not in ``target``.

    Of a large target only the key columns are read, and a filter of the
    delta's keys lets almost nothing else out of that scan.
    """
    keys = list(keys)
    delta = as_typed(delta, target, keys)
    known = target.select(*keys)
    if not is_small(target, small_bytes):
        known = known.where(key_filter(delta, keys))
    return delta.join(known.distinct(), keys, "left_anti")


def anti_insert(target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(unseen(target, delta, keys))


def delta_keys(delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return delta.select(*keys).distinct()


def untouched(target: DataFrame, delta: DataFrame, keys: Sequence[str], small_bytes: int | None = None) -> DataFrame:
    """Rows of ``target`` whose key is not in ``delta``.

    A small delta is broadcast. With a large one, the rows that the key filter
    excludes leave the scan at once, and only the others are shuffled.
    """
    keys = list(keys)
    wanted = delta_keys(as_typed(delta, target, keys), keys)
    if is_small(delta, small_bytes) or is_small(target, small_bytes):
        return target.join(wanted, keys, "left_anti").select(*target.columns)
    maybe = key_filter(wanted, keys)
    rest = target.where(maybe).join(wanted, keys, "left_anti").select(*target.columns)
    return target.where(~maybe).unionByName(rest)


def touched(target: DataFrame, delta: DataFrame, keys: Sequence[str], small_bytes: int | None = None) -> DataFrame:
    """Rows of ``target`` whose key is in ``delta``; a large target is cut in its scan."""
    keys = list(keys)
    wanted = delta_keys(as_typed(delta, target, keys), keys)
    if not (is_small(delta, small_bytes) or is_small(target, small_bytes)):
        target = target.where(key_filter(wanted, keys))
    return target.join(wanted, keys, "left_semi").select(*target.columns)


def replace_rows(target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the target rows of every key in the delta, then add the delta."""
    return untouched(target, delta, keys).unionByName(delta.select(*target.columns))


def lookup_state(defs: DataFrame, stored: DataFrame, cache: DataFrame) -> DataFrame:
    """Definitions with their stored fingerprint and whether that one is cached."""
    last = stored.select("task_name", F.col("fingerprint").alias("stored_fingerprint"))
    kept = cache.select("task_name", "fingerprint").distinct().withColumn("is_cached", F.lit(True))
    return (
        defs.join(shuffled(last), "task_name", "left")
        .join(shuffled(kept), ["task_name", "fingerprint"], "left")
        .withColumn("is_cached", F.coalesce("is_cached", F.lit(False)))
    )


def with_scenarios(df: DataFrame, scenarios: Mapping[str, float], name: str) -> DataFrame:
    """Every row once per scenario, from a handful of named settings; needs no join."""
    options = [F.struct(F.lit(k).alias("scenario"), F.lit(v).alias(name)) for k, v in scenarios.items()]
    return df.select("*", F.inline(F.array(*options)))
