"""Incremental refresh: fingerprints of data and of definitions, and what they let us skip."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.functions import chain_hash
from tableflow.operators.joins import WALK_BYTES, join_unique, lookup_state, shuffled
from tableflow.operators.lineage import Rounds, levels
from tableflow.session import drop_path, list_names, new_path
from tableflow.sources.sink import LARGE_CACHE_BYTES, materialize

# What a preview says about a task.
SKIP = "skip (unchanged)"
NOT_CACHED = "run (not cached)"
CHANGED = "run (changed)"
NO_STATE = "run (no prior state)"

# Fixed value: the folder name of a NULL partition.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def row_hash(cols: Sequence[str]) -> Column:
    """The MD5 of a row in hex. Each cell has its length before it, NULL has none."""
    texts = [F.col(c).cast("string") for c in cols]
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.md5(F.concat(*cells))


#: A half of a digest, 64 bits with a sign, is added up in three pieces, which cannot overflow below 10^12 rows.
PIECE = 22
SUMS = ["high2", "high1", "high0", "low2", "low1", "low0"]


def digest_sums(df: DataFrame, by: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """Row count and the summed pieces of all 128 bits of the row hashes; sums of parts of a group add up to its own."""
    hashed = df.select(*by, row_hash(cols).alias("h"))
    names = hashed.columns[:-1]
    for half, start in (("high", 1), ("low", 17)):
        hashed = hashed.withColumn(half, F.conv(F.substring("h", start, 16), 16, -10).cast("bigint"))
    mask = F.lit((1 << PIECE) - 1)
    sums = []
    for half in ("high", "low"):
        sums.append(F.sum(F.shiftright(half, 2 * PIECE)).alias(f"{half}2"))
        sums.append(F.sum(F.shiftright(half, PIECE).bitwiseAND(mask)).alias(f"{half}1"))
        sums.append(F.sum(F.col(half).bitwiseAND(mask)).alias(f"{half}0"))
    return hashed.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def print_of_sums() -> Column:
    """The fingerprint that the pieces of ``digest_sums`` stand for: both halves' sums as text."""
    wide = "decimal(38,0)"

    def half(name: str) -> Column:
        top, middle = (F.col(f"{name}{i}").cast("decimal(19,0)") * F.lit(1 << (PIECE * i)).cast("decimal(14,0)") for i in (2, 1))
        return (top + middle + F.col(f"{name}0")).cast(wide).cast("string")

    return F.concat(half("high"), F.lit(":"), half("low"))


def table_fingerprint(df: DataFrame, part: str, cols: Sequence[str]) -> DataFrame:
    """Row count and order-independent content hash of every partition: the sum over the row hashes."""
    sums = digest_sums(df, [part], cols)
    return sums.select(part, "n_rows", print_of_sums().alias("fingerprint"))


# ---- the hash tree of a stored table ----

RANGE = "key_range"


def write_ranges(df: DataFrame, path: str, part: str, key: str, width: int) -> None:
    """Store a table with a folder per partition and range of ``width`` keys; a NULL key has a range of its own."""
    ranged = df.withColumn(RANGE, F.floor(F.col(key) / width))
    ranged.repartition(part, RANGE).write.mode("overwrite").partitionBy(part, RANGE).parquet(path)


def overwrite_ranges(df: DataFrame, path: str, part: str, key: str, width: int) -> None:
    """Replace the ranges that ``df`` has rows of; the files of all others stay as they are."""
    ranged = df.withColumn(RANGE, F.floor(F.col(key) / width)).repartition(part, RANGE)
    ranged.write.mode("overwrite").partitionBy(part, RANGE).option("partitionOverwriteMode", "dynamic").parquet(path)


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """What stands in each folder of the table: names, sizes and times of its files, as one hash. Opens no file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length", "modificationTime")
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder")
    one = F.xxhash64("file", "length", "modificationTime").cast("decimal(38,0)")
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("files"), F.sum(one).alias("stamp"))


def _leaves(rows: DataFrame, part: str, cols: Sequence[str]) -> DataFrame:
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1).alias("folder")
    return digest_sums(rows, [part, folder], cols)


def build_tree(spark: SparkSession, path: str, tree: str, schema: str, part: str, cols: Sequence[str]) -> None:
    """Write the leaves of the hash tree of a table in ranges: one row per partition and range, with its files' stamp."""
    rows = spark.read.schema(schema).parquet(path)
    _leaves(rows, part, cols).join(_listing(spark, path), "folder").write.mode("overwrite").parquet(tree)


def refresh_tree(
    spark: SparkSession, path: str, old_tree: str, tree: str, schema: str, part: str, cols: Sequence[str]
) -> DataFrame:
    """Write the tree of a table that has changed since ``old_tree``, reading the changed ranges only.

    A range whose files are those of its leaf keeps the leaf. The folders of
    the others are the paths that are read. Answers the ranges read or gone:
    folder (as a URI) and state (changed, added, removed).
    """
    old, now = spark.read.parquet(old_tree), _listing(spark, path)
    past = old.select("folder", F.col("files").alias("old_files"), F.col("stamp").alias("old_stamp"))
    state = (
        F.when(F.col("old_stamp").isNull(), "added")
        .when(F.col("stamp").isNull(), "removed")
        .when((F.col("stamp") == F.col("old_stamp")) & (F.col("files") == F.col("old_files")), "same")
        .otherwise("changed")
    )
    seen, _ = materialize(past.join(now, "folder", "full").select("folder", "files", "stamp", state.alias("state")))
    kept = old.join(seen.where("state = 'same'").select("folder"), "folder", "left_semi")
    read = [unquote(r.folder) for r in seen.where("state IN ('added', 'changed')").select("folder").collect()]  # names of what is read anyway
    if read:
        rows = spark.read.schema(schema).option("basePath", path).parquet(*read)
        stamps = seen.where("state IN ('added', 'changed')").select("folder", "files", "stamp")
        kept = kept.unionByName(_leaves(rows, part, cols).join(stamps, "folder").select(*kept.columns))
    kept.write.mode("overwrite").parquet(tree)
    return seen.where("state <> 'same'").select("folder", "state")


def tree_fingerprint(spark: SparkSession, tree: str, part: str) -> DataFrame:
    """The upper level of the tree: equal to ``table_fingerprint`` of the whole table, from the leaves alone."""
    sums = spark.read.parquet(tree).groupBy(part).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(s).alias(s) for s in SUMS])
    return sums.select(part, "n_rows", print_of_sums().alias("fingerprint"))


def definition_fingerprint(defs: DataFrame) -> DataFrame:
    """Hash of source, config and the given ``upstreams`` (an array of ``name=fingerprint``), in the order of the names.

    The name ends at the last ``=``. Whole texts would sort otherwise:
    ``part_10=`` comes before ``part_1=``, while ``part_1`` comes first.
    """
    named = F.transform("upstreams", lambda u: F.struct(F.regexp_replace(u, "=[^=]*$", "").alias("name"), u.alias("text")))
    ups = F.transform(F.sort_array(named), lambda u: F.concat(u["text"], F.lit("\0")))
    head = F.concat(F.col("source"), F.lit("\0"), F.col("config"), F.lit("\0"))
    return defs.withColumn("fingerprint", F.sha2(F.concat(head, F.array_join(ups, "")), 256))


def propagate_fingerprints(defs: DataFrame, edges: DataFrame) -> DataFrame:
    """Fingerprint of every task, where a change upstream changes everything below.

    ``defs`` has task_name, source and config; ``edges`` has task_name and
    upstream_task_name. A hash needs those above it, so tasks are resolved
    level by level. A resolved level hands its fingerprints along its edges to
    folders named after the level that needs them, so every edge is written
    and read once and no resolved level is read again. Tasks on or below a
    cycle have no level and no fingerprint.
    """
    spark = defs.sparkSession
    edges, _ = materialize(edges.distinct())
    depth, _ = materialize(levels(edges, defs.select("task_name")))
    base = new_path(spark, "fingerprints")
    placed = defs.join(shuffled(depth), "task_name")
    placed.write.partitionBy("level").parquet(f"{base}/defs")
    above = depth.select(F.col("task_name").alias("upstream_task_name"), F.col("level").alias("from_level"))
    placed_edges = join_unique(edges, depth, ["task_name"], "inner", WALK_BYTES)
    placed_edges = join_unique(placed_edges, above, ["upstream_task_name"], "inner", WALK_BYTES)
    placed_edges.write.partitionBy("from_level").parquet(f"{base}/edges")
    defs_at = spark.read.schema(placed.schema).parquet(f"{base}/defs")
    edges_at = spark.read.schema("task_name string, upstream_task_name string, level int, from_level int").parquet(f"{base}/edges")

    done = Rounds(spark, f"{base}/resolved", "task_name string, fingerprint string")
    top = depth.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        here = defs_at.filter(F.col("level") == level).drop("level")
        none = F.array().cast("array<string>")
        ready = here.withColumn("upstreams", none)
        if level > 1:
            come = spark.read.schema("task_name string, up string").parquet(f"{base}/handed/level={level}")
            lists = come.groupBy("task_name").agg(F.collect_list("up").alias("upstreams"))
            ready = here.join(shuffled(lists), "task_name", "left").withColumn("upstreams", F.coalesce("upstreams", none))
        done.add(definition_fingerprint(ready).select("task_name", "fingerprint"))
        if level < top:
            known = done.last().select(F.col("task_name").alias("upstream_task_name"), F.col("fingerprint").alias("up_fp"))
            out = edges_at.filter(F.col("from_level") == level)
            named = join_unique(out, known, ["upstream_task_name"], "inner", WALK_BYTES)
            named = named.select("task_name", F.concat("upstream_task_name", F.lit("="), "up_fp").alias("up"), "level")
            named.write.mode("append").partitionBy("level").parquet(f"{base}/handed")
    return done.read().drop("round")


def refresh_preview(defs: DataFrame, stored: DataFrame, cache: DataFrame) -> DataFrame:
    """What the next run would do with every task.

    ``defs`` has task_name, fingerprint and cacheable; ``stored`` the
    fingerprints of the last run (one per task); ``cache`` what is kept.
    """
    state = lookup_state(defs, stored, cache)
    same = F.coalesce(F.col("stored_fingerprint") == F.col("fingerprint"), F.lit(False))
    return state.select(
        "task_name",
        F.when(F.lit(stored.isEmpty()), NO_STATE)
        .when(F.col("cacheable") & same & F.col("is_cached"), SKIP)
        .when(~F.col("cacheable"), NOT_CACHED)
        .otherwise(CHANGED)
        .alias("next_run"),
    )


def changed_partitions(old_fp: DataFrame, new_fp: DataFrame, part: str) -> DataFrame:
    """Each partition as added, changed, removed or same."""
    old = old_fp.select(F.col(part).alias("_old"), F.col("n_rows").alias("old_rows"), F.col("fingerprint").alias("old_fp"))
    new = new_fp.select(F.col(part).alias("_new"), F.col("n_rows").alias("new_rows"), F.col("fingerprint").alias("new_fp"))
    same = (F.col("old_fp") == F.col("new_fp")) & (F.col("old_rows") == F.col("new_rows"))
    return old.join(new, F.col("_old").eqNullSafe(F.col("_new")), "full").select(
        F.coalesce("_old", "_new").alias(part),
        F.when(F.col("old_rows").isNull(), "added")
        .when(F.col("new_rows").isNull(), "removed")
        .when(same, "same")
        .otherwise("changed")
        .alias("state"),
    )


def only(df: DataFrame, changes: DataFrame, part: str, *states: str, max_names: int = 1000) -> DataFrame:
    """Rows of the partitions in one of these states; a NULL partition counts as one.

    Up to ``max_names`` partitions become a literal filter, so that the scan of
    a partitioned table skips the other folders. More are joined.
    """
    wanted = changes.filter(F.col("state").isin(*states)).select(F.col(part).cast("string").alias("_part"))
    names = [row[0] for row in wanted.limit(max_names + 1).collect()]
    if len(names) <= max_names:
        kind = df.schema[part].dataType
        known = F.col(part).isin([F.lit(n).cast(kind) for n in names if n is not None] or [F.lit(None).cast(kind)])
        return df.filter(known | F.col(part).isNull() if None in names else known)
    return df.join(wanted.distinct(), F.col(part).cast("string").eqNullSafe(F.col("_part")), "left_semi")


def refresh(
    target: DataFrame,
    source: DataFrame,
    part: str,
    changes: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    force: bool = False,
) -> DataFrame:
    """The refreshed target: changed partitions recomputed, the rest kept, removed ones gone.

    ``compute`` maps source rows to target rows and keeps ``part``. With
    ``force`` everything is recomputed. Write the answer to a new place.
    """
    if force:
        return compute(source)
    fresh = compute(only(source, changes, part, "added", "changed"))
    return only(target, changes, part, "same").select(*fresh.columns).unionByName(fresh)


def refresh_stored(
    path: str,
    source: DataFrame,
    part: str,
    changes: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
) -> None:
    """Refresh a table stored in one folder per ``part``: the others are not read or written.

    Dynamic overwrite swaps the folders of recomputed partitions. It never
    removes one, so the folders of removed partitions, and of changed ones
    whose new result has no rows, are deleted after it. Spark keeps the empty
    text in the folder of NULL, so an empty partition value is refused.
    """
    spark = source.sparkSession
    touched = changes.filter("state IN ('changed', 'removed')").select(F.col(part).cast("string")).collect()
    if any(r[0] == "" for r in touched) or not changes.filter(F.col(part).cast("string") == "").isEmpty():
        raise ValueError(f"{part} holds an empty text, which has no folder of its own")
    names = {NULL_FOLDER if r[0] is None else r[0] for r in touched}  # partition names, not rows
    folders = [n for n in list_names(spark, path) if n.startswith(f"{part}=") and unquote(n.split("=", 1)[1]) in names]
    before = {n: list_names(spark, f"{path}/{n}") for n in folders}
    fresh = compute(only(source, changes, part, "added", "changed"))
    writer = fresh.hint("rebalance", part).write.mode("overwrite").partitionBy(part)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    for name, files in before.items():
        if list_names(spark, f"{path}/{name}") == files:  # nothing new came
            drop_path(spark, f"{path}/{name}")


def ready_to_run(defs: DataFrame, edges: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether all upstreams of a task are complete at their current fingerprint.

    Answers the number of upstreams in the way and the first of them by name.
    """
    now = defs.select(F.col("task_name").alias("upstream_task_name"), F.col("fingerprint").alias("now_fp"))
    past = stored.select(F.col("task_name").alias("upstream_task_name"), F.col("fingerprint").alias("past_fp"))
    late = (
        now.join(past, "upstream_task_name", "left")
        .filter(~F.coalesce(F.col("now_fp") == F.col("past_fp"), F.lit(False)))
        .select("upstream_task_name")
    )
    held = (
        join_unique(edges.distinct(), late, ["upstream_task_name"], "left_semi")
        .groupBy("task_name")
        .agg(F.count(F.lit(1)).alias("blockers"), F.min("upstream_task_name").alias("first_blocker"))
    )
    return (
        defs.select("task_name")
        .join(held, "task_name", "left")
        .withColumn("blockers", F.coalesce("blockers", F.lit(0)))
        .withColumn("ready", F.col("blockers") == 0)
    )


def cache_report(cache: DataFrame) -> DataFrame:
    """Rows, bytes and a large-result flag per cached result."""
    return cache.groupBy("task_name", "fingerprint").agg(
        F.sum("n_rows").cast("bigint").alias("n_rows"),
        F.sum("size_bytes").cast("bigint").alias("size_bytes"),
        (F.sum("size_bytes") > LARGE_CACHE_BYTES).alias("large"),
    )
