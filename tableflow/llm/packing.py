"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. Each round gives every queue a quantum in
proportion to its weight. The queue sends as many whole packets of ``packet``
tokens as its quanta so far allow; the rest is its deficit and is carried to
the next round. A queue begins with a credit of less than a packet, drawn from
a hash of its source, so that queues of one size do not all send at once. A
round has the tokens of a window, so every window holds the target proportions
to within about a packet per queue, however many windows went before. Windows
follow each other without a gap: only the last one can be short. A queue that
runs dry leaves its share to the others.

The deficits have a closed form: a token's place in its queue gives the round
that sends it, by the totals of its own source and of all tokens alone. No task
needs the state of the one before or anything of the other queues, so the cost
of a document does not depend on how many sources there are. What a round
sends is put in order by the sources, and a running sum over runs of rounds
gives each piece its place. The deficits carry over the borders of windows and
of partitions alike.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.chunks import word_table
from tableflow.llm.common import cut, gathered, gathered_cut, in_arrow, text_slices

SPAN = 1024  # rounds whose pieces one task puts in order: some 8 MB of ids
SLICE_TOKENS = 1 << 22  # that a task deals out at once; a longer document makes a slice of its own
HELD = "block long, source string, doc_id long, local long, n_tokens long, ids binary"
PARTS = "doc_id long, source string, tie long, at long, start long, length long, doc_tokens long, round long, ids binary"


class Rounds:
    """Which round sends a token.

    ``groups``: tokens and weight of each named source, and of all others
    together, which run dry at the same time. ``packet``: tokens of a packet.
    """

    def __init__(self, groups: list[tuple[int, float]], window: int, packet: int):
        self.window, self.packet = window, packet
        self.n = max(1, -(-sum(n for n, _ in groups) // window))
        # Tokens due by a time are linear between the times at which a queue runs dry.
        self.times = np.unique([0.0] + [n / w for n, w in groups])
        self.due_by = np.array([sum(min(float(n), w * t) for n, w in groups) for t in self.times])

    def of(self, ends: np.ndarray, total: np.ndarray, weight: np.ndarray, credit: np.ndarray) -> np.ndarray:
        """The rounds of packets that end at the tokens ``ends`` of queues of ``total`` tokens.

        ``weight``: of the queue. ``credit``: its share of a packet at the beginning.
        """
        time = (ends - credit * np.minimum(total, self.packet)) / weight
        due = np.interp(time, self.times, self.due_by)
        return np.clip(due // self.window, 0, self.n - 1).astype(np.int64)

    def runs(
        self, at: np.ndarray, n: np.ndarray, total: np.ndarray, weight: np.ndarray, tie: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens ``at`` to ``at + n`` of queues, cut where the round changes: row, first token, length, round."""
        credit = (tie & 0xFFFFF) / float(1 << 20)
        first = at // self.packet
        packets = (at + n - 1) // self.packet - first + 1
        row = np.repeat(np.arange(len(at)), packets)
        number = np.arange(len(row)) - np.repeat(np.cumsum(packets) - packets - first, packets)
        round_ = self.of(np.minimum((number + 1) * self.packet, total[row]), total[row], weight[row], credit[row])
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (round_[1:] != round_[:-1])
        row, begin, round_ = row[new], number[new] * self.packet, round_[new]
        begin = np.maximum(begin, at[row])
        last = np.ones(len(row), bool)
        last[:-1] = row[1:] != row[:-1]
        end = np.where(last, (at + n)[row], np.roll(begin, -1))
        return row, begin, end - begin, round_


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every document's ids, stored in the shared folder: block, source, doc_id, local, n_tokens, ids.

    ``block`` is the task that read the document, ``local`` the tokens of the
    same source before it in that block.
    """

    def run(batches):
        block, before = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for start, stop, texts in text_slices(batch):
                ids, ends = word_table(tokenizer)(texts)
                sources = batch.column("source").slice(start, stop - start)
                counts, local, packed = np.diff(ends) + 1, [], []
                for s, n, a, b in zip(sources.to_pylist(), counts.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                    local.append(before[s])
                    before[s] += n
                    packed.append(np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(local), block, np.int64)), sources, batch.column("doc_id").slice(start, len(local)),
                        pa.array(local, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()),
                    ],
                    ["block", "source", "doc_id", "local", "n_tokens", "ids"],
                )

    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), docs[source].cast("string").alias("source"))
    # Half of the bytes of an id are zero: zstandard leaves them out. ``block`` names a task, so none is merged above ``run``.
    return cut(in_arrow(gathered(named), run, HELD, keeps=tokenizer), "packing-ids", compression="zstd")


def _groups(totals: DataFrame, targets: dict[str | None, float] | None) -> tuple[list[tuple[int, float]], float]:
    """Tokens and weight of each named source and of all others together, and the others' weight per token."""
    names = list(targets or {})
    which = F.lit(-1)
    for k, name in enumerate(names):
        which = F.when(F.col("source").eqNullSafe(F.lit(name)), k).otherwise(which)
    # One row for each name the caller gave and one for the rest.
    found = totals.groupBy(which.alias("which")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("n")).collect()
    mean = sum(targets.values()) / len(names) if names else 1.0
    groups, each = [], 1.0
    for r in sorted(found, key=lambda r: r.which):
        if r.which >= 0:
            groups.append((r.n, float(targets[names[r.which]])))
        else:
            groups.append((r.n, mean * r.kinds if names else float(r.n)))
            each = groups[-1][1] / r.n
    return groups, each


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = 2048,
    packet: int = 16,
    targets: dict[str | None, float] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue (the source).

    ``targets``: weight above zero of each source in every window. The sources
    that it does not name have the mean weight on average and share it by
    their tokens. By default the corpus' own proportions.

    Every id lies in exactly one piece. NULL and empty texts have the end id
    only, a NULL source is a queue of its own, repeated rows are packed again,
    an empty table gives no rows, and further columns play no part.
    """
    held = tokenized(docs, tokenizer, end_id, doc_id, text, source)
    own = Window.partitionBy("source")
    before = F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = held.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    # A source has as many rows here as tasks have read it.
    places = sums.select("source", "block", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"))
    places = gathered_cut(places.withColumn("tie", F.xxhash64("source")), "packing-places")
    groups, each = _groups(places.select("source", "total").distinct(), targets)
    weight = F.col("total") * each
    for name, value in (targets or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    places = places.select(F.col("source").alias("of"), F.col("block").alias("in"), "before", "total", "tie", weight.alias("weight"))
    at = held.join(places, held["block"].eqNullSafe(places["in"]) & held["source"].eqNullSafe(places["of"]))
    at = at.withColumn("at", F.col("before") + F.col("local"))
    rounds = Rounds(groups, window, packet)

    def slices(batches):
        for batch in batches:
            tokens = np.cumsum(batch.column("n_tokens").to_numpy())
            start = 0
            while start < len(tokens):
                done = tokens[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(tokens, done + SLICE_TOKENS, "right")))
                part = batch.slice(start, end - start)
                yield part, rounds.runs(*[part.column(c).to_numpy() for c in ("at", "n_tokens", "total", "weight", "tie")])
                start = end

    def count(batches):
        sent = Counter()
        for _, (_, _, length, round_) in slices(batches):
            spans, place = np.unique(round_ // SPAN, return_inverse=True)
            for s, n in zip(spans.tolist(), np.bincount(place, weights=length).tolist()):
                sent[s] += int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(sent), pa.int64()), pa.array(list(sent.values()), pa.int64())], ["span", "n"])

    def deal(batches):
        for part, (row, begin, length, round_) in slices(batches):
            first = part.column("at").to_numpy()[row]
            # The runs follow each other as the ids do, so the bytes stay where they are.
            ids = pa.concat_arrays([part.column("ids").cast(pa.large_binary())])
            offsets = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
            cuts = np.append(offsets[row] + 4 * (begin - first), offsets[len(ids)])
            bytes_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cuts), ids.buffers()[2]])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c).take(take) for c in ("doc_id", "source", "tie")], pa.array(begin), pa.array(begin - first),
                    pa.array(length), part.column("n_tokens").take(take), pa.array(round_), bytes_.cast(pa.binary()),
                ],
                [c.split()[0] for c in PARTS.split(", ")],
            )

    known = ["at", "n_tokens", "total", "weight", "tie"]
    spans = in_arrow(at.select(*known), count, "span long, n long").groupBy("span").agg(F.sum("n").alias("n"))
    spans = _running(gathered_cut(spans, "packing-spans"))
    parts = in_arrow(at.select(*known, "doc_id", "source", "ids"), deal, PARTS).withColumn("span", F.floor(F.col("round") / SPAN))
    order = Window.partitionBy("span").orderBy("round", "tie", "source", "at").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("length").over(order), F.lit(0))
    placed = parts.withColumn("inner", inner).join(spans, "span")
    placed = placed.withColumn("place", F.col("inner") + F.col("sent_before"))
    # A run that passes the end of a sequence is cut there.
    sequences = F.expr(f"explode(sequence(place div {window}, (place + length - 1) div {window}))")
    pieces = placed.select("*", sequences.alias("sequence_id"))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * window)
    length = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * window) - begin
    pieces = pieces.select("*", (begin - F.col("place")).cast("int").alias("skip"), length.cast("int").alias("own"), begin.alias("begin"))
    return pieces.select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("own").cast("long").alias("length"),
        F.crc32(F.substring("ids", F.col("skip") * 4 + 1, F.col("own") * 4)).alias("ids_crc32"), "doc_tokens",
        "sequence_id", (F.col("begin") - F.col("sequence_id") * window).alias("offset"), F.col("source").alias("queue"),
    )


def _running(spans: DataFrame) -> DataFrame:
    """From (span, n) to (span, sent_before): what earlier spans send, by groups of spans and then within each."""
    many = 1 << 12
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    group = F.floor(F.col("span") / many).alias("group")
    groups = spans.groupBy(group).agg(F.sum("n").alias("n"))
    groups = groups.select("group", F.coalesce(F.sum("n").over(before.orderBy("group")), F.lit(0)).alias("earlier"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("group").orderBy("span")), F.lit(0))
    found = spans.select("span", "n", group).select("span", "group", inner.alias("inner")).join(groups, "group")
    return found.select("span", (F.col("earlier") + F.col("inner")).alias("sent_before"))
