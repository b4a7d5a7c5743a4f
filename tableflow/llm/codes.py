"""Vectors compressed to a byte per part, with nearest entries found by LAESA pivots.

A vector is cut into equal parts; each part position has a codebook. A few
entries of a position's first codebook serve as its pivots, and the distance
of every part to its pivots is computed once and kept beside the part. In a
round, |d(part, pivot) - d(pivot, entry)| bounds d(part, entry) from below, so
a part's entries are tried in the order of their bounds until the next bound
is beyond the best exact distance. Distances that decide are integers.

Rows never meet on the driver: a task sums its parts per entry, Spark adds
those sums, and only the codebooks (parts x entries x width integers) go back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import cut, in_arrow
from tableflow.llm.vectors import integers, matrix, usable

#: Bounds and distances of pivots are held in 32-bit floats; a bound is lowered by this share of them.
SLACK = 1e-6


@dataclass
class Codebooks:
    """``entries`` has the shape (parts, entries, width of a part); ``pivots`` (parts, pivots, width)."""

    entries: np.ndarray
    pivots: np.ndarray

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    @property
    def width(self) -> int:
        """Components of a whole vector, padding included."""
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points: the first, then always the one farthest from those taken."""
    taken = [0]
    gap = ((points - points[0]) ** 2).sum(1)
    while len(taken) < min(n, len(points)) and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[taken[-1]]) ** 2).sum(1))
    return points[taken + [0] * (n - len(taken))]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row for each point and a column for each pivot."""
    return np.sqrt(((points[:, None, :] - pivots[None, :, :]) ** 2).sum(2)).astype(np.float32)


def nearest(points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest entry, the lower of equals, and the exact squared distance."""
    between = distances(pivots, entries)
    bounds = np.zeros((len(points), len(entries)), np.float32)
    for p in range(len(pivots)):
        np.maximum(bounds, np.abs(to_pivots[:, p, None] - between[None, p, :]), out=bounds)
    order = np.argsort(bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, 1)
    bounds -= SLACK * (to_pivots.max(1, keepdims=True) + between.max() + 1)
    best = np.full(len(points), np.iinfo(np.int64).max)
    entry = np.zeros(len(points), np.int64)
    going = np.arange(len(points))
    reach = np.full(len(points), np.inf)
    for step in range(len(entries)):
        going = going[bounds[going, step] <= reach[going]]
        if not len(going):
            break
        tried = order[going, step]
        found = ((points[going] - entries[tried]) ** 2).sum(1)
        better = (found < best[going]) | ((found == best[going]) & (tried < entry[going]))
        at = going[better]
        best[at], entry[at] = found[better], tried[better]
        reach[at] = np.sqrt(found[better])
    return entry, best


def _parts(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Parts (rows, parts, width of a part) and their distances to the pivots, as ``prepare`` stored them."""
    n, (parts, pivots, width) = batch.num_rows, books.pivots.shape
    cells = matrix(batch.column("cells"), parts * width).reshape(n, parts, width)
    held = b"".join(batch.column("to_pivots").to_pylist())
    return cells, np.frombuffer(held, np.float32).reshape(n, parts, pivots)


def _sums(books: Codebooks):
    def run(batches):
        parts, entries, width = books.entries.shape
        total, n = np.zeros(books.entries.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            cells, to_pivots = _parts(batch, books)
            for p in range(parts):
                entry, _ = nearest(cells[:, p], to_pivots[:, p], books.entries[p], books.pivots[p])
                n[p] += np.bincount(entry, minlength=entries)
                np.add.at(total[p], entry, cells[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(n[part, entry]),
                pa.array(list(total[part, entry]), pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "total"],
        )

    return run


def _assign(books: Codebooks, schema: T.StructType):
    keep = [f.name for f in schema.fields if f.name not in ("code", "error")]

    def run(batches):
        for batch in batches:
            cells, to_pivots = _parts(batch, books)
            codes = np.zeros(cells.shape[:2], np.uint8)
            error = np.zeros(len(cells), np.int64)
            for p in range(books.parts):
                entry, far = nearest(cells[:, p], to_pivots[:, p], books.entries[p], books.pivots[p])
                codes[:, p] = entry
                error += far
            text = [row.tobytes().hex() for row in codes]
            columns = [batch.column(c) for c in keep] + [pa.array(text, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "code", "error"])

    return run


def prepare(df: DataFrame, key: str, vector: str, parts: int, entries: int, pivots: int) -> tuple[DataFrame, Codebooks]:
    """The usable rows with their integers and distances to the pivots, written once, and the first codebooks."""
    rows = df.where(usable(vector)).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c != vector]).alias("row"),
        F.col(f"`{key}`").alias("key"),
        integers(vector).alias("cells"),
    )
    longest = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = rows.orderBy(F.col("key").asc_nulls_last(), "cells").select("cells").limit(entries).toArrow()
    cells = matrix(first.column("cells").combine_chunks(), parts * width).reshape(-1, parts, width)
    start = np.ascontiguousarray(cells.transpose(1, 0, 2))
    books = Codebooks(start, np.array([far_apart(e, pivots) for e in start]) if len(cells) else start)

    def run(batches):
        for batch in batches:
            held = matrix(batch.column("cells"), parts * width).reshape(-1, parts, width)
            far = np.stack([distances(held[:, p], books.pivots[p]) for p in range(parts)], 1)
            packed = pa.array([x.tobytes() for x in far], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cells"), packed], names=["row", "cells", "to_pivots"])

    schema = T.StructType([rows.schema["row"], rows.schema["cells"], T.StructField("to_pivots", T.BinaryType())])
    return cut(in_arrow(rows.select("row", "cells"), run, schema), "vector-parts"), books


def refine(packed: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the mean of its parts, rounded down; an unused one stays."""
    sums = in_arrow(packed.select("cells", "to_pivots"), _sums(books), "part int, entry int, n bigint, total array<bigint>")
    width = books.entries.shape[2]
    adds = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    moved = books.entries.copy()
    for row in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *adds).collect():
        moved[row.part, row.entry] = [row[f"t{i}"] // row.n for i in range(width)]
    return Codebooks(moved, books.pivots)


def compress(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    pivots: int = 4,
) -> tuple[DataFrame, Codebooks]:
    """The usable rows of ``df`` with ``code`` (two hex digits a part) and ``error``, and the codebooks.

    A row whose vector is NULL, or holds a NULL, a non-finite component or one
    of 2**19 or more in size, is left out. Shorter vectors, and a length that
    ``parts`` does not divide, are filled up with zeros. The first codebooks
    are the parts of the rows with the smallest keys (NULL last, equal keys by
    their components); with fewer rows than entries they are that small.
    Repeated rows count each. An empty table gives an empty result and empty
    codebooks. All columns but the vector are kept; one named ``code`` or
    ``error``, in any case, is replaced.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so a codebook holds 1 to 256 entries")
    packed, books = prepare(df, key, vector, parts, entries, pivots)
    kept = [f for f in packed.schema["row"].dataType.fields if f.name.lower() not in ("code", "error")]
    schema = T.StructType([packed.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books.entries.shape[1] == 0:
        empty = df.sparkSession.createDataFrame([], schema)
        return empty.select(*[F.col(f"row.`{f.name}`") for f in kept], "code", "error"), books
    for _ in range(rounds):
        books = refine(packed, books)
    coded = in_arrow(packed, _assign(books, schema), schema)
    return coded.select(*[F.col(f"row.`{f.name}`") for f in kept], "code", "error"), books


def decompress(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """``codes`` with ``cells``, the integers that the entries of each code stand for; NULL for no code."""
    entries, width = books.entries, books.entries.shape[2]
    tables = [F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in part]) for part in entries]
    byte = [F.conv(F.substring(F.col(f"`{code}`"), 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(entries))]
    cells = F.concat(*[F.element_at(t, b + 1) for t, b in zip(tables, byte, strict=True)]) if width else F.array()
    return codes.withColumn("cells", cells)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with the error summed over the rows of a label; rows without one form a label of their own."""
    rows = cut(coded, "vector-codes")
    sums = rows.groupBy(F.col(f"`{label}`").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return rows.drop("label_error").join(sums, F.col(f"`{label}`").eqNullSafe(F.col("of_label"))).drop("of_label")
