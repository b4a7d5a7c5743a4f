"""Vectors as integers, for the operators that compute on them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256

#: A vector with a component of this size or more takes no part: its sums would not fit a long.
LARGEST = float(1 << 19)


def usable(vector: str) -> Column:
    """A vector that is there and whose components are all there, finite and below ``LARGEST``."""
    whole = F.forall(f"`{vector}`", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    return F.coalesce(whole, F.lit(False))


def integers(vector: str) -> Column:
    """The components scaled and rounded down."""
    return F.transform(f"`{vector}`", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """One row for each list, as 64-bit integers; shorter lists end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
