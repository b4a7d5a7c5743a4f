"""Shards that all hold the mixture of sources: proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked there; a row
at rank r of n stands at the fraction (r + phase) / n, with a phase between 0
and 1 from the source's name, so that sources of one size do not come in step.
All rows are sorted by that fraction and the order is cut into shards whose row
counts differ by one at most. A stretch of the order holds of each source its
share, give or take one row, so every shard matches the mixture.

Both sorts deal rows by ranges of the whole sort key, so a source, or a row
repeated many times, is spread over as many tasks as its rows need. A task's
rows are numbered as they are written, and the numbers before each task come
from one count per task. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableflow.llm.common import cut

#: ``monotonically_increasing_id`` holds the task above this bit and the row's place in the task below it.
TASK_BIT = 33


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the bytes a document takes (its UTF-8 text and 8 more; NULL: no text) and the text's checksum."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumns({"size": F.octet_length(body).cast("bigint") + 8, "text_crc32": F.crc32(body)})


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` in written ranges of ``order``, each row with its ``task`` and its ``place`` there.

    Rows equal in ``order`` are parted by their number in the scan, which keeps
    a value with many rows from filling one range.
    """
    keyed = rows.withColumn("drawn", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*order, F.col("drawn")).sortWithinPartitions(*order, "drawn")
    place = F.monotonically_increasing_id()
    out = ranged.drop("drawn").withColumn("at", place)
    task, spot = F.shiftright("at", TASK_BIT), F.col("at").bitwiseAND((1 << TASK_BIT) - 1)
    return cut(out, name).withColumns({"task": task, "place": spot}).drop("at")


def interleave(df: DataFrame, shards: int, key: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (from 0 in each shard, gapless).

    Row counts of shards differ by one at most; with fewer rows than shards the
    rest stay empty. Each source's count in a shard is its share of the shard,
    give or take one row, and with its share of what the other sources lack or
    have too much (some half of the root of their number). Rows without a source
    form a source of their own. The order depends on the seed and on the rows,
    not on how they are stored. Rows with equal keys in a source are ordered by
    all their columns, and only rows equal in every column are interchangeable.
    An empty table gives an empty result. Columns of ``df`` keep their values;
    a column named ``shard`` or ``slot``, in any case, is replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = df.select(
        whole.alias("row"),
        F.col(f"`{source}`").cast("string").alias("stratum"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{key}`").cast("string"))).alias("drawn_at"),
        F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes if c in kept]).alias("content"),
    )
    ranked = _numbered(rows, [F.col("stratum"), F.col("drawn_at"), F.col("content")], "shard-ranks")
    # Rows of one source in one task, and how many of that source stand in earlier tasks; one row for each task and source.
    spans = ranked.groupBy("stratum", "task").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    all_of = Window.partitionBy("stratum")
    earlier = all_of.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("stratum").alias("of"),
        F.col("task").alias("in_task"),
        "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(all_of).alias("of_source"),
    )
    rank = F.col("before") + F.col("place") - F.col("first")
    named = F.md5(F.concat_ws(":", F.lit(str(seed)), "stratum"))
    phase = (F.conv(F.substring(named, 1, 8), 16, 10).cast("bigint") + 0.5) / float(1 << 32)
    fractions = ranked.join(spans, F.col("stratum").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in_task"))).select(
        "row", "stratum", ((rank + phase) / F.col("of_source")).alias("fraction"), "drawn_at", "content"
    )
    order = [F.col("fraction"), F.col("stratum"), F.col("drawn_at"), F.col("content")]
    placed = _numbered(fractions, order, "shard-order").select("row", "task", "place")
    counts = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    # One row for each task: the window over all of them is as long as the list of tasks.
    tasks = counts.select(
        F.col("task").alias("in_task"),
        (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    position = F.col("before") + F.col("place")
    cuts = placed.join(tasks, F.col("task") == F.col("in_task")).select("row", "total", position.alias("position"))
    cuts = cuts.withColumn("shard", F.expr(f"position * {shards}L div total"))
    first = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return cuts.select("row.*", F.col("shard").cast("int").alias("shard"), (F.col("position") - first).alias("slot"))
