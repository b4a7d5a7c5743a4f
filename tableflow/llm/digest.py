"""Document fingerprints of improbable features in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy. How rare each entropy is among
all windows of all documents gives its rank. In a document, a window that ranks
first in at least ``POPULAR`` of the runs of ``RUN`` neighbouring windows is a
feature. Features go into Bloom filters of ``BITS`` bits in text order, a new
one after ``FILL`` distinct features. Two fingerprints are alike by the bits
that their filters share beyond what chance would give.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.common import _BYTE, _PLACE, cut, in_arrow, mix, text_slices, utf8

WINDOW, RUN, POPULAR = 64, 64, 16
BITS, HASHES, FILL = 2048, 5, 160
LEVELS = 1024  # entropies are told apart to so many levels
STEP = 1 << 19  # windows worked on at once
SLICE = 1 << 20
NEVER = np.int64(1) << 62

_C = np.arange(WINDOW + 1)
# Fixed-point c * log2(c): the sum over all byte values gives a window's entropy exactly and in any order.
_G = np.rint(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * (1 << 20)).astype(np.int64)
_GAIN = _G[1:] - _G[:-1]


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each byte, for all whole windows of ``data``."""
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the window's other places
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    # Sliding on by one byte takes the first byte's gain away and adds the new byte's gain.
    gain = _GAIN[before]
    first = np.minimum(before[:WINDOW], np.arange(WINDOW))
    sums = np.empty(n - WINDOW + 1, np.int64)
    sums[0] = _GAIN[first].sum()
    sums[1:] = sums[0] + np.cumsum(gain[WINDOW:] - _GAIN[after[: n - WINDOW]])
    return np.clip((_G[WINDOW] - sums) * (LEVELS - 1) // _G[WINDOW], 0, LEVELS - 1)


def _windows(offsets: np.ndarray, start: int, end: int) -> np.ndarray:
    """Which windows that start at ``start`` to ``end`` lie within one text."""
    places = np.arange(start, end)
    return places + WINDOW <= offsets[np.searchsorted(offsets, places, "right")]


def level_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many windows of the texts have each entropy level."""
    counts = np.zeros(LEVELS, np.int64)
    for start in range(0, len(data) - WINDOW + 1, STEP):
        end = min(start + STEP, len(data) - WINDOW + 1)
        counts += np.bincount(entropy_levels(data[start : end + WINDOW - 1])[_windows(offsets, start, end)], minlength=LEVELS)
    return counts


def feature_places(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the features of all texts start. The result for a text does not depend on its neighbours.

    Between the windows of two texts lie ``WINDOW - 1`` places without one, so no run holds windows of both.
    """
    n = len(data) - WINDOW + 1
    found = []
    for start in range(0, n, STEP):
        # Runs that hold a window from start to end begin RUN - 1 places earlier and end as many later.
        end = min(start + STEP, n)
        low, high = max(0, start - RUN + 1), min(n, end + RUN - 1)
        levels = entropy_levels(data[low : high + WINDOW - 1])
        key = np.where(_windows(offsets, low, high), (rank[levels] << 21) + np.arange(high - low), NEVER)
        key = np.concatenate([np.full(RUN - 1, NEVER), key, np.full(RUN - 1, NEVER)])
        width = 1
        while width < RUN:
            key = np.minimum(key[: len(key) - width], key[width:])
            width *= 2
        first = key[key < NEVER] & ((1 << 21) - 1)
        wins = np.bincount(first, minlength=high - low)[start - low : end - low]
        found.append(np.flatnonzero(wins >= POPULAR) + start)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def fingerprints(texts: pa.Array, rank: np.ndarray) -> list[np.ndarray]:
    """The chained filters of each text, as an array of bytes with a row per filter.

    A text shorter than a window has itself as its only feature; an empty one has no filter.
    """
    data, offsets = utf8(texts)
    places = feature_places(data, offsets, rank)
    hashes = np.zeros(len(places), np.uint64)
    for i in range(0, len(places), 1 << 14):
        part = places[i : i + (1 << 14)]
        hashes[i : i + len(part)] = (_BYTE[data[part[:, None] + np.arange(WINDOW)]] * _PLACE[:WINDOW]).sum(axis=1, dtype=np.uint64)
    hashes = mix(hashes)
    ends = np.searchsorted(places, offsets)
    out = []
    for k in range(len(texts)):
        own = hashes[ends[k] : ends[k + 1]]
        size = offsets[k + 1] - offsets[k]
        if not len(own) and size:
            own = np.frombuffer(hashlib.blake2b(data[offsets[k] : offsets[k + 1]].tobytes(), digest_size=8).digest(), np.uint64)
        if len(own) > 1:
            own = own[np.sort(np.unique(own, return_index=True)[1])]
        filters = np.zeros((-(-len(own) // FILL), BITS), np.uint8)
        rows = np.arange(len(own)) // FILL
        for h in range(HASHES):
            filters[rows, (own >> np.uint64(11 * h)) & np.uint64(BITS - 1)] = 1
        out.append(np.packbits(filters, axis=1))
    return out


def as_text(filters: np.ndarray) -> str:
    """``filters:base64``."""
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}"


def from_text(fingerprint: str) -> np.ndarray:
    n, _, held = fingerprint.partition(":")
    return np.frombuffer(base64.b64decode(held), np.uint8).reshape(int(n), BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray, margin: float = 0.1) -> float:
    """From 0 to 1: the mean over the filters of the shorter chain of their best match in the other.

    A match is the share of the smaller filter's bits that both have set,
    beyond what chance gives and ``margin`` of what lies above it. Equal
    fingerprints are 1, and an empty one is like an empty one only.
    """
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):
        a, b = b, a
    set_b, total = np.bitwise_count(b).sum(axis=1, dtype=np.int64), 0.0
    for row in a:
        own = int(np.bitwise_count(row).sum(dtype=np.int64))
        both = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(own, set_b), own * set_b / BITS
        floor = chance + margin * (most - chance)
        total += float(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / len(a)


def ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of every entropy level, the rarest among all windows of all documents first; ties by level."""

    def run(batches):
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch, most=SLICE):
                counts += level_counts(*utf8(texts))
        yield pa.RecordBatch.from_pydict({"level": np.arange(LEVELS), "n": counts})

    counts = in_arrow(docs.select(docs[text].alias("text")), run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    held = np.zeros(LEVELS, np.int64)
    for row in counts.collect():  # LEVELS rows
        held[row.level] = row.n
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), held))] = np.arange(LEVELS)
    return rank


def edited(text: str, other: str) -> str:
    """The last third of ``text`` replaced by as much of the start of ``other``, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(keys: list, texts: list[str], rank: np.ndarray) -> list[tuple]:
    """Result rows for all but the last text, each against the one after it."""
    own = fingerprints(pa.array(texts, pa.large_string()), rank)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    rows = []
    for start, end, part in text_slices(pa.RecordBatch.from_pydict({"text": pa.array(changed, pa.large_string())}), most=SLICE):
        for i, other in enumerate(fingerprints(part, rank), start):
            digest = hashlib.sha256(changed[i].encode()).hexdigest()
            near, after = likeness(own[i], other), likeness(own[i], own[i + 1])
            rows.append((keys[i], len(texts[i]), digest, as_text(own[i]), as_text(other), near, after))
    return rows


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how alike it is to that and to the next document.

    Documents follow each other in descending doc_id (rows without one last,
    rows with the same one by their text); after the last comes the first. The
    edited text has the last third of the code points replaced by as many from
    the start of the next document. NULL counts as empty. A single row is its
    own next one; an empty table gives no rows; further columns play no part.

    Documents are sorted by ranges of the id. Each task compares its own
    neighbours; the first and the last row of each task meet in a second step,
    with one row per task.
    """
    rank = ranks(docs, text)
    names = [x.split()[0] for x in RESULT.split(", ")] + ["part", "edge", "edge_text"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64(), pa.string(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        part, last, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            for start, end, part_texts in text_slices(batch, most=SLICE):
                keys, texts = batch.column("doc_id").slice(start, end - start).to_pylist(), part_texts.to_pylist()
                if first:
                    yield table([(keys[0], *[None] * 6, part, "first", texts[0])])
                    first = False
                if last is not None:
                    keys, texts = [last[0], *keys], [last[1], *texts]
                last = keys[-1], texts[-1]
                yield table([(*row, part, None, None) for row in _compared(keys, texts, rank)])
        if last is not None:
            yield table([(last[0], *[None] * 6, part, "last", last[1])])

    ordered = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    down = [F.desc_nulls_last("doc_id"), F.col("text")]
    ordered = ordered.repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(*down)
    held = cut(in_arrow(ordered, run, f"{RESULT}, part long, edge string, edge_text string"), "digest-rows")

    # One row per task from here.
    firsts = held.where("edge = 'first'").select("part", F.col("edge_text").alias("next_text"))
    around = Window.orderBy("part")
    follows = firsts.select("part", F.lead("part").over(around).alias("following"), F.min("part").over(Window.partitionBy()).alias("head"))
    follows = follows.select("part", F.coalesce("following", "head").alias("following"))
    lasts = held.where("edge = 'last'").select("doc_id", "edge_text", "part").join(follows, "part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "following"), "following").select("doc_id", "edge_text", "next_text")

    def close(batches):
        for batch in batches:
            for key, own, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "edge_text", "next_text"))):
                rows = _compared([key, None], [own, other], rank)
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[:7])

    whole = held.where("edge IS NULL").select(*names[:7])
    return whole.unionByName(in_arrow(pairs, close, RESULT))
