"""Exact duplicates by distributed most-significant-digit radix partitioning.

The key of a document is its normalised text in UTF-8, led by its length. All
documents are partitioned by the first digit (the length and the first bytes),
the groups of more than one by the next digit, and so on, until a group has
one member or its text has ended: then its members are equal, byte by byte.
Digits grow from level to level, so that long copies need few levels.

Each level is one aggregation, combined within each task before the shuffle,
so a group of any size sends one row per task; and one join that gives the
members their group. The groups are written first, so that the join reads two
plain tables and Spark can split a hot group over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import gathered, gathered_cut, numbered, scratch
from tableflow.session import write_counted

SPACE = " \t\n\x0b\x0c\r"
FIRST_DIGIT, GROWTH, LARGEST_DIGIT = 32, 16, 1 << 20


def normalised(text: Column) -> Column:
    """``text`` without ASCII white space. By bytes: ``translate`` makes an object of every character, which fills the heap."""
    return reduce(lambda bare, c: F.replace(bare, F.lit(c), F.lit("")), SPACE, F.coalesce(text, F.lit("")))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, row_no, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting all ASCII white space; NULL
    counts as empty, and all empty texts are equal. Of equal texts the row with
    the most code points in the original stays, then the smallest doc_id (NULL
    last), then the first row, so exactly one row of a group is kept even if
    rows repeat. ``row_no`` numbers the rows. An empty table gives no rows;
    further columns play no part.
    """
    return _groups(numbered(docs.select(doc_id, text), "radix-rows"), doc_id, text)


def _groups(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``groups`` of rows that are written with their numbers (``row``, ``row_no``)."""
    bare = normalised(F.col(f"row.`{text}`"))
    state = docs.select(
        F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"),
        "row_no",
        F.char_length(F.coalesce(F.col(f"row.`{text}`"), F.lit(""))).alias("points"),
        F.unhex(F.sha2(bare, 256)).alias("sha"),
        F.octet_length(bare).cast("long").alias("parent"),  # the digit that leads: the length
        bare.cast("binary").alias("rest"),
    )
    done, digit = [], FIRST_DIGIT
    while True:
        keyed = state.withColumn("digit", F.substring("rest", 1, digit))
        best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
        found = keyed.groupBy("parent", "digit").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        several = gathered_cut(found.where("n > 1"), "radix-groups").hint("merge")
        joined = keyed.join(several, ["parent", "digit"], "left")
        ended = F.col("n").isNull() | (F.octet_length("rest") <= digit)
        level = joined.select(
            "doc_id", "row_no", "points", "sha", "n", "best",
            F.when(~ended, F.expr(f"substring(rest, {digit + 1})")).alias("rest"),
        )
        path = scratch(docs.sparkSession, "radix-level")
        alive = write_counted(gathered(level), path, alive=F.col("rest").isNotNull())["alive"]
        stored = docs.sparkSession.read.schema(level.schema).parquet(path)
        done.append(stored.where("rest IS NULL"))
        if not alive:
            break
        state = stored.where("rest IS NOT NULL").select(
            "doc_id", "row_no", "points", "sha", F.col("best.row_no").alias("parent"), "rest"
        )
        digit = min(digit * GROWTH, LARGEST_DIGIT)
    all_rows = done[0]
    for rows in done[1:]:
        all_rows = all_rows.unionByName(rows)
    alone = F.col("n").isNull()
    return all_rows.select(
        "doc_id",
        "row_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.row_no") == F.col("row_no"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = numbered(docs, "radix-rows")
    dropped = _groups(rows, doc_id, text).where("NOT kept").select("row_no")
    return rows.join(dropped, "row_no", "left_anti").select("row.*")
