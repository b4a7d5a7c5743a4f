"""Hard negatives by exact scores of all rows against stated anchors, in the way of the Four Russians.

An anchor's vector is cut into groups of eight dimensions; for each group a
table holds the sums of all 256 subsets of its components. A candidate's
components are written in two's complement and each bit plane of a group is
packed to a byte. The byte looks up the group's subset sum, the lookups of a
plane are added, and the planes are shifted and added up: the full, exact
inner product, with no product ever formed.

Anchors are taken in blocks of bounded size; a block goes to all tasks, each of
which runs it over its candidates and keeps the best few per anchor. Two passes
over the candidates: one for the positives, one for the negatives that their
scores allow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableflow.llm.common import cut, in_arrow
from tableflow.llm.vectors import integers, matrix, usable

GROUP = 8  # dimensions whose subsets share a table
BLOCK = 1 << 15  # anchors that go to the tasks at once, on average: 16 MB at 64 dimensions
TILE = 256  # anchors whose tables a task holds at once
ROWS = 2048  # candidates scored at once
NONE = np.iinfo(np.int64).min  # stands for no score


def tables(anchors: np.ndarray) -> np.ndarray:
    """Subset sums: (groups, 256, anchors), in the narrowest type that holds a sum over all groups."""
    n, width = anchors.shape
    most = int(np.abs(anchors).sum(1).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    out = np.zeros((width // GROUP, 1 << GROUP, n), kind)
    for j in range(GROUP):
        # The upper half of the subsets so far is the lower half with one more component.
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + anchors[:, j::GROUP].T[:, None, :].astype(kind)
    return out


def planes(cells: np.ndarray) -> np.ndarray:
    """Bit planes, the sign's first, packed to bytes: (planes, groups, rows)."""
    top = int(max(cells.max(initial=0), ~cells.min(initial=0))).bit_length()
    shifts = np.arange(top, -1, -1)
    bits = ((cells[None, :, :] >> shifts[:, None, None]) & 1).astype(np.uint8)
    grouped = bits.reshape(len(shifts), len(cells), -1, GROUP)
    return np.packbits(grouped, axis=3, bitorder="little")[..., 0].transpose(0, 2, 1).copy()


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact inner products: (rows, anchors)."""
    groups, _, n = table.shape
    rows = packed.shape[2]
    total = np.zeros((rows, n), np.int64)
    part, found = np.empty((rows, n), table.dtype), np.empty((rows, n), table.dtype)
    for level, plane in enumerate(packed):
        np.take(table[0], plane[0], axis=0, out=part)
        for g in range(1, groups):
            np.take(table[g], plane[g], axis=0, out=found)
            part += found
        total <<= 1
        if level:
            total += part
        else:
            total -= part  # the sign plane weighs negative
    return total


def best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` best scores of each row, best first, ties by smaller id; ``NONE`` ranks last."""
    many = score.shape[1]
    if many > n:
        # The n-th best score is exact; what ties with it is settled by id below.
        least = np.partition(score, many - n, axis=1)[:, many - n]
        open_ = score >= least[:, None]
        widest = int(open_.sum(1).max())
        if widest <= 4 * n:
            picked = np.argsort(~open_, axis=1, kind="stable")[:, :widest]
        else:
            picked = np.broadcast_to(np.arange(many), score.shape)
    else:
        picked = np.broadcast_to(np.arange(many), score.shape)
    some = np.take_along_axis(score, picked, 1)
    order = np.lexsort((ids[picked] if ids.ndim == 1 else np.take_along_axis(ids, picked, 1), ~some), axis=1)[:, :n]
    return np.take_along_axis(picked, order, 1)


class Best:
    """The ``n`` best (score, id) of each of ``rows`` rows, kept over many batches."""

    def __init__(self, rows: int, n: int):
        self.score = np.full((rows, n), NONE)
        self.id = np.zeros((rows, n), np.int64)
        self.n = n

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` (len(at), candidates) of the candidates ``ids`` for the rows ``at``."""
        # Rows that no candidate can enter any more, not even by a tie, are left alone.
        at_least = self.score[at, -1]
        some = np.flatnonzero((score.max(1, initial=NONE) >= at_least) & (score.max(1, initial=NONE) > NONE))
        if not len(some):
            return
        at, score = at[some], score[some]
        new = best(score, ids, self.n)
        all_score = np.concatenate([self.score[at], np.take_along_axis(score, new, 1)], 1)
        all_id = np.concatenate([self.id[at], ids[new]], 1)
        keep = best(all_score, all_id, self.n)
        self.score[at] = np.take_along_axis(all_score, keep, 1)
        self.id[at] = np.take_along_axis(all_id, keep, 1)

    def rows(self, names: list[str], index: list[np.ndarray]) -> pa.RecordBatch:
        """The kept ones: the given arrays at each row, id, score."""
        row, nth = np.nonzero(self.score > NONE)
        columns = [pa.array(x[row]) for x in index] + [pa.array(self.id[row, nth]), pa.array(self.score[row, nth])]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "found_id", "score"])


def _blocks(batch: pa.RecordBatch, width: int):
    """Slices of ``ROWS`` candidates: their numbers, ids, label codes, and packed planes."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        cells = matrix(part.column("cells"), width)
        yield part.column("number").to_numpy(), part.column("id").to_numpy(), part.column("label_hash").to_numpy(), cells


def _positives(block: dict, width: int, n: int):
    """Tasks' best ``n`` candidates of an anchor's own label."""

    def run(batches):
        kept = Best(len(block["number"]), n)
        by_label = {x: np.flatnonzero(block["label"] == x) for x in np.unique(block["label"])}
        for batch in batches:
            for number, ids, label, cells in _blocks(batch, width):
                for x in np.unique(label):
                    own, same = by_label.get(x, ()), np.flatnonzero(label == x)
                    if not len(own):
                        continue
                    packed = planes(cells[same])
                    for first in range(0, len(own), TILE):
                        tile = own[first : first + TILE]
                        found = scores(tables(block["cells"][tile]), packed).T
                        found = np.where(block["number"][tile][:, None] == number[same][None, :], NONE, found)
                        kept.add(tile, found, ids[same])
        yield kept.rows(["anchor"], [block["number"]])

    return run


def _negatives(block: dict, width: int, n: int, floor: tuple[int, int]):
    """Tasks' best ``n`` candidates of other labels within the bounds of each positive."""
    share, whole = floor
    # The least allowed score, in integers of any size: a product of long scores could overflow.
    lowest = np.array([-(-share * score // whole) for score in block["pair_score"].tolist()], np.int64)

    def run(batches):
        of, limit, nth = block["pair_of"], block["pair_score"], block["pair_rank"]
        kept = Best(len(of), n)
        for batch in batches:
            for _, ids, label, cells in _blocks(batch, width):
                packed = planes(cells)
                for first in range(0, len(block["number"]), TILE):
                    tile = slice(first, first + TILE)
                    found = scores(tables(block["cells"][tile]), packed).T
                    found = np.where(block["label"][tile][:, None] == label[None, :], NONE, found)
                    pairs = np.flatnonzero((of >= first) & (of < first + TILE))
                    if not len(pairs):
                        continue
                    mine = found[of[pairs] - first]
                    within = (mine <= limit[pairs][:, None]) & (mine >= lowest[pairs][:, None])
                    kept.add(pairs, np.where(within, mine, NONE), ids)
        yield kept.rows(["anchor", "positive_rank"], [block["number"][of], nth])

    return run


def _first(rows: DataFrame, keys: list[str], n: int, rank: str) -> DataFrame:
    """The ``n`` first rows of each key by score, ties by id, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "found_id")
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def mine(
    df: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    positives: int = 5,
    negatives: int = 5,
    floor: tuple[int, int] = (80, 100),
) -> DataFrame:
    """For the rows that ``anchor`` states, the first positives, and for each of them the first negatives within bounds.

    A positive is another row of the anchor's label; a negative is a row of
    another label whose score is at most the positive's and at least
    ``floor[0] / floor[1]`` of it. Rows are ordered by score, ties by smaller
    key. Columns: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. Pairs without a negative give no row.

    A row with no label, key or vector, or with a component that is NULL, not
    finite, or of 2**19 or more in size, takes no part. Shorter vectors end in
    zeros. Every repeated row is a row of its own: it can be the positive of
    its copy, and each copy that is an anchor gives its own rows. An empty
    table, or one without anchors, gives no rows. Other columns of ``df`` are
    not read, whatever their names.
    """
    spark = df.sparkSession
    own = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = df.where(usable(vector) & own.isNotNull() & F.col(f"`{key}`").isNotNull()).select(
        F.monotonically_increasing_id().alias("number"),
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.xxhash64(own).alias("label_hash"),
        integers(vector).alias("cells"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = cut(rows, "negatives-rows")
    size = rows.agg(F.max(F.size("cells")).alias("width"), F.count_if("is_anchor").alias("anchors")).first()
    width = -(-(size.width or 1) // GROUP) * GROUP
    n_blocks = -(-size.anchors // BLOCK)
    anchors = rows.where("is_anchor").withColumn("block", F.pmod(F.xxhash64("number"), F.lit(max(n_blocks, 1))))
    if n_blocks > 1:
        anchors = cut(anchors.repartition("block"), "negatives-anchors")
    candidates = rows.select("number", "id", "label_hash", "cells")
    found = []
    for b in range(n_blocks):
        held = anchors.where(F.col("block") == b).orderBy("number").toArrow()
        block = {
            "number": held.column("number").to_numpy(),
            "label": held.column("label_hash").to_numpy(),
            "cells": matrix(held.column("cells").combine_chunks(), width),
        }
        near = in_arrow(candidates, _positives(block, width, positives), "anchor bigint, found_id bigint, score bigint")
        pairs = cut(_first(near, ["anchor"], positives, "positive_rank"), "negatives-positives")
        mined = pairs.orderBy("anchor", "positive_rank").toArrow()
        block["pair_of"] = np.searchsorted(block["number"], mined.column("anchor").to_numpy())
        block["pair_score"] = mined.column("score").to_numpy()
        block["pair_rank"] = mined.column("positive_rank").to_numpy().astype(np.int32)
        schema = "anchor bigint, positive_rank int, found_id bigint, score bigint"
        hard = in_arrow(candidates, _negatives(block, width, negatives, floor), schema)
        hard = _first(hard, ["anchor", "positive_rank"], negatives, "rank")
        hard = hard.select("anchor", "positive_rank", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
        names = anchors.where(F.col("block") == b).select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"))
        positive = pairs.select("anchor", "positive_rank", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
        block_rows = hard.join(positive, ["anchor", "positive_rank"]).join(names, "anchor")
        found.append(cut(block_rows, "negatives-block") if n_blocks > 1 else block_rows)
    if not found:
        schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
