"""Row windows that hold when one group has a third of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.session import HOT_ROWS
from tableflow.sources.sink import materialize


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` columns per key. A NULL sorts lowest.

    ``row_number() = 1`` lets Spark keep one row per key and task before the
    shuffle, so a hot key costs no more than the others.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def trailing_mean(part: str | Sequence, order: str, value: str, n: int) -> Column:
    keys = [part] if isinstance(part, str) else list(part)
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0))


def rolling_mean(
    df: DataFrame, part: str, order: str, value: str, n: int, name: str, max_group: int | None = HOT_ROWS
) -> DataFrame:
    """Mean of the last ``n`` rows (fewer at the start) within each group.

    ``order`` must be unique in a group, and a number, date or timestamp.
    Groups of more than ``max_group`` rows, of which there are few, are cut
    into ranges of ``order`` so that no task holds a whole one; all others
    take a plain window. ``max_group=None`` skips the count, for groups known
    to be small.
    """
    if max_group is None or n <= 1:
        return df.withColumn(name, trailing_mean(part, order, value, n))
    sizes = df.groupBy(F.col(part).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    hot, seen = materialize(sizes.filter(F.col("_n") > max_group))
    if not seen["rows"]:
        return df.withColumn(name, trailing_mean(part, order, value, n))
    splits = math.ceil(hot.agg(F.sum("_n")).first()[0] / max_group) + 1
    is_hot = F.col(part).eqNullSafe(F.col("_part"))
    small = df.join(F.broadcast(hot), is_hot, "left_anti")
    large = df.join(F.broadcast(hot), is_hot, "left_semi")
    plain = small.withColumn(name, trailing_mean(part, order, value, n))
    return plain.unionByName(_ranged_mean(large, part, order, value, n, name, splits))


def _ranged_mean(
    df: DataFrame, part: str, order: str, value: str, n: int, name: str, splits: int
) -> DataFrame:
    """The same mean with every group cut at quantiles of ``order``.

    The rows just before a range come from the small table of range tails,
    which makes the result equal to one long window.
    """
    shares = [i / splits for i in range(1, splits)]
    # One row with a fixed number of cut points, as text so that any type survives the trip.
    points = F.percentile_approx(order, shares, max(10_000, 10 * splits))
    cuts = df.agg(points.cast("array<string>")).first()[0] or []
    kind = df.schema[order].dataType.simpleString()
    bounds = F.array(*[F.lit(cut) for cut in cuts]).cast(f"array<{kind}>")
    ranged = df.withColumn("_range", F.size(F.filter(bounds, lambda cut: cut < F.col(order))))

    last = Window.partitionBy(part, "_range").orderBy(F.desc(order))
    tails = (
        ranged.select(part, "_range", order, value)
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") < n)
    )
    # Each range's first tail row sees the n-1 tail rows before it: they are the
    # last n-1 rows of the group before the range starts.
    before = Window.partitionBy(part).orderBy(order).rowsBetween(1 - n, -1)
    halo = (
        tails.withColumn("_before", F.collect_list(F.struct(order, value)).over(before))
        .groupBy(part, "_range")
        .agg(F.min_by("_before", order).alias("_before"))
        .select(part, "_range", F.inline("_before"))
        .withColumn("_halo", F.lit(True))
    )
    both = ranged.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    mean = trailing_mean([part, "_range"], order, value, n)
    return both.withColumn(name, mean).filter(~F.col("_halo")).drop("_range", "_halo")
