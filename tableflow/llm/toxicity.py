"""Toxicity by class-conditional Kneser-Ney models.

Two models, one learned from toxic and one from ordinary documents, of the
words of a text and of its pairs of words in a row. As Kneser-Ney counts kinds
of contexts and not repetitions, an expression counts once for every document
that holds it. Each class takes an absolute discount off its own counts and
gives what that frees to the counts of both classes together:

    p_class(x) = max(c_class(x) - D, 0) / C_class + lambda_class * p_shared(x)

A pair of words that one document alone holds is discounted whole: it tells no
more than its words do. Counts as they come would still let thousands of
expressions that tell nothing outvote the few that do (area under the curve
0.64 to 0.86 on held-out rows). So a class backs off to the shared counts a
second time, expression by expression: with the posterior chance that the
classes do not differ there, given its two counts. The share of expressions
that tell something is fitted to the counts of all of them by maximum
likelihood; such an expression is taken to belong to one class nearly alone
(``SPREAD``). No expression is cut; one too rare to tell the classes apart is
about as likely in both. In a text too, a word counts once per word it follows.

A document's score compares its two log-likelihoods, normalised by its length,
through a logistic curve fitted on labelled rows that the counts leave out.

All counts are gathered and smoothed by Spark over all labelled rows, and all
ratios stay in a written table. Scoring tasks hold the ``HELD`` most frequent
expressions. The others are looked up by a join: a task sends only the
expressions of its texts that a Bloom filter of that table lets through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm.common import fold, gathered_cut, in_arrow, mix, text_slices, word_hashes
from tableflow.operators.joins import key_filter

HELD = 1 << 22  # expressions whose ratios the scoring tasks hold: 64 MB
FILTER_BITS = 1 << 26  # of the filter of all others: 8 MB
CURVE_ROWS = 20_000
SLICE = 1 << 20  # bytes of text that a task works on at once
EXACT = 64  # counts above are put together, within 1/32 of them, where the share of telling expressions is fitted
SPREAD = 1 / 16  # of the class shares of telling expressions: the smaller, the nearer each is to 0 or 1
KINDS = ("word", "pair")


def _once(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys; and for each text's different keys, their place among those and where they first occur."""
    found = pa.array(keys.view(np.int64)).dictionary_encode()
    kinds = found.dictionary.to_numpy()
    both, first = np.unique(own * max(len(kinds), 1) + found.indices.to_numpy(), return_index=True)
    return kinds, both % max(len(kinds), 1), first


def expressions(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words and of the pairs of words in a row of all texts, the text each is in, and the size of each text.

    A word counts once for every different word it follows in a text, and a
    pair once; the size of a text is the number of its words so counted. The
    lowest bit of a key is 0 for a word and 1 for a pair.
    """
    words, ends = word_hashes(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(ends))
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]])[: len(words)]
    starts = ends[:-1][np.diff(ends) > 0]
    before[starts] = 0
    pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + words)
    first = _once(pairs, own)[2]
    inner = first[~np.isin(first, starts)]
    keys = np.concatenate([mix(words[first]) & ~np.uint64(1), pairs[inner] | np.uint64(1)]).view(np.int64)
    return keys, np.concatenate([own[first], own[inner]]), np.bincount(own[first], minlength=len(texts))


def count_expressions(labelled: DataFrame) -> DataFrame:
    """From (text, toxic) to (key, t, o): toxic and ordinary documents that hold it, combined within each task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_slices(batch, most=SLICE):
                toxic = batch.column("toxic").slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, own, _ = expressions(texts)
                kinds, place, first = _once(keys, own)
                own = own[first]
                both = np.bincount(2 * place + toxic[own], minlength=2 * len(kinds)).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(both[:, 1]), pa.array(both[:, 0])], ["key", "t", "o"])

    counted = in_arrow(labelled.select("text", "toxic"), run, "key long, t long, o long")
    return counted.groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0, to some 12 digits: Stirling's series, eight steps up."""
    y = x + 8
    up = F.log(x) + F.log(x + 1) + F.log(x + 2) + F.log(x + 3) + F.log(x + 4) + F.log(x + 5) + F.log(x + 6) + F.log(x + 7)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - up


def _evidence(t, o, q: float, lgamma):
    """Log of how much likelier two counts are if the expression is a telling one than if its toxic share is ``q``.

    A telling expression's toxic share is drawn from a beta distribution of
    mean ``q`` and ``SPREAD``.
    """
    a, b = q * SPREAD, (1 - q) * SPREAD
    whole = math.lgamma(SPREAD) - math.lgamma(a) - math.lgamma(b)
    return lgamma(t + a) + lgamma(o + b) - lgamma(t + o + SPREAD) + whole - t * math.log(q) - o * math.log(1 - q)


def fit_share(t: np.ndarray, o: np.ndarray, n: np.ndarray, q: float) -> float:
    """The share of telling expressions that makes the counts likeliest; ``n`` expressions have the counts ``t`` and ``o``."""
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    ratio = np.exp(np.clip(_evidence(t, o, q, lambda x: lgamma(x.astype(float)).astype(float)), -700, 700))
    share = 0.01
    for _ in range(200):
        chance = share * ratio / (1 - share + share * ratio)
        share, before = float(np.clip((chance * n).sum() / n.sum(), 1e-9, 0.5)), share
        if abs(share - before) < 1e-9:
            break
    return share


def ratios(counts: DataFrame) -> DataFrame | None:
    """From (key, t, o) to (key, n, ratio): documents with the expression, and the log of how much likelier it is in
    toxic texts. None if one of the classes has no document."""
    t, o, n = F.col("t"), F.col("o"), F.col("t") + F.col("o")
    pair = F.col("key").bitwiseAND(F.lit(1)) == 1
    # What the discounts need is summed while the counts are written; pairs of one document go into these sums only.
    watch, measures = Observation(), []
    for kind, own in zip(KINDS, (~pair, pair)):
        for c in "to":
            count = F.when(own, F.col(c)).otherwise(0)
            measures += [F.sum(count).alias(f"{kind}_all_{c}"), F.count_if(count > 0).alias(f"{kind}_kinds_{c}")]
            measures += [F.count_if(count == k).alias(f"{kind}_n{k}_{c}") for k in (1, 2)]
    counts = gathered_cut(counts.observe(watch, *measures).where(~pair | (n > 1)), "kn-counts")
    seen_of = {k: v or 0 for k, v in watch.get.items()}
    parts = []
    for kind, own in zip(KINDS, (~pair, pair)):
        mine, seen = counts.where(own), {k.removeprefix(f"{kind}_"): v for k, v in seen_of.items() if k.startswith(kind)}
        all_n = seen["all_t"] + seen["all_o"]
        if kind == "word" and not (seen["all_t"] and seen["all_o"]):
            return None
        if not (seen["all_t"] and seen["all_o"]):
            continue
        q = seen["all_t"] / all_n

        def put_together(x: Column) -> Column:
            step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(x)) - 5), F.lit(1.0))
            return F.when(x <= EXACT, x).otherwise((F.floor(x / step) * step).cast("bigint"))

        table = mine.groupBy(put_together(t).alias("t"), put_together(o).alias("o")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        if not table.num_rows:
            continue
        share = fit_share(*(table.column(c).to_numpy() for c in ("t", "o", "n")), q)
        chance = 1 / (1 + F.exp(-(_evidence(t, o, q, log_gamma) + math.log(share / (1 - share)))))
        held = {}
        for c in "to":
            once, twice, whole, kinds = (seen[f"{x}_{c}"] for x in ("n1", "n2", "all", "kinds"))
            d = once / (once + 2 * twice) if once else 0.5
            # Of a pair that one document holds nothing is left.
            free = (d * kinds + ((1 - d) * once if kind == "pair" else 0)) / whole
            own_part = F.greatest(F.col(c) - d, F.lit(0.0))
            if kind == "pair":
                own_part = F.when(F.col(c) > 1, own_part).otherwise(0.0)
            held[c] = own_part * all_n / (n * whole) + free
        ratio = F.log((1 - chance + chance * held["t"]) / (1 - chance + chance * held["o"]))
        parts.append(mine.select("key", n.alias("n"), ratio.alias("ratio")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class Held:
    """The most frequent expressions with their ratios, in order of their keys, and a Bloom filter of all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, masks: np.ndarray | None):
        order = np.argsort(keys)
        self.keys, self.values, self.masks = keys[order], values[order], masks

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of the keys held (0 for others), and which of the others may be in the table."""
        value, maybe = np.zeros(len(keys)), np.zeros(len(keys), bool)
        mine = np.zeros(len(keys), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            mine = self.keys[place] == keys
            value[mine] = self.values[place[mine]]
        if self.masks is not None:
            rest = np.flatnonzero(~mine)
            maybe[rest] = True
            for spot in spots(keys[rest]):
                maybe[rest] &= (self.masks[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
        return value, maybe


def spots(keys: np.ndarray) -> list[np.ndarray]:
    """The two bits of a key in the filter: 26 bits each from above the lowest."""
    return [(keys >> 1) & (FILTER_BITS - 1), (keys >> 32) & (FILTER_BITS - 1)]


def _hold(table: DataFrame) -> tuple[Held, DataFrame | None]:
    """What scoring tasks hold of the written table, and the rest of it."""
    n = table.count()
    if n <= HELD:
        held, rest = table, None
    else:
        bar = table.agg(F.percentile_approx("n", 1 - HELD / n, 100_000).alias("bar")).first().bar
        if table.where(F.col("n") > bar).count() > HELD:  # the quantile is a near one
            bar *= 2
        held, rest = table.where(F.col("n") > bar), table.where(F.col("n") <= bar)
    rows = held.select("key", "ratio").toArrow()
    masks = None
    if rest is not None:
        spot = F.explode(F.array(*[F.shiftright("key", s).bitwiseAND(F.lit(FILTER_BITS - 1)) for s in (1, 32)]))
        set_ = rest.select(spot.alias("spot"))
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("spot").bitwiseAND(F.lit(63)).cast("int"))
        words = set_.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
        masks = np.zeros(FILTER_BITS // 64, np.uint64)
        masks[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    keys, values = (rows.column(c).to_numpy() for c in ("key", "ratio"))
    del rows  # the arrays are copies
    pa.default_memory_pool().release_unused()
    return Held(keys, values, masks), rest


def sums(rows: DataFrame, table: DataFrame | None, keep: list[str]) -> DataFrame:
    """Per row of ``rows`` (row_no, text and more): the columns ``keep``, the ratios of its words and of its pairs added
    up, and its size. The numbers are those of this one scan, and they are written with the sums."""
    found_fields = T.StructType.fromDDL("word double, pair double, size long, rest array<long>, times array<int>").fields
    schema = T.StructType([rows.schema[c] for c in keep] + found_fields)
    held, rest = (Held(np.zeros(0, np.int64), np.zeros(0), None), None) if table is None else _hold(table)
    handed = rows.sparkSession.sparkContext.broadcast(held)
    del held  # the driver has written it to a file

    def run(batches):
        for batch in batches:
            for start, end, texts in text_slices(batch, most=SLICE):
                keys, own, size = expressions(texts)
                found = pa.array(keys).dictionary_encode()
                kinds, place = found.dictionary.to_numpy(), found.indices.to_numpy()
                value, maybe = handed.value.look_up(kinds)
                pair = (kinds & 1)[place] == 1
                both = [np.bincount(own[m], weights=value[place[m]], minlength=len(texts)).astype(float) for m in (~pair, pair)]  # whole numbers, if no text has any
                open_ = np.flatnonzero(maybe[place])
                once, times = np.unique(own[open_] * max(len(kinds), 1) + place[open_], return_counts=True)
                ends = pa.array(np.searchsorted(once, np.arange(len(texts) + 1) * max(len(kinds), 1)), pa.int32())
                lists = [pa.array(kinds[once % max(len(kinds), 1)]), pa.array(times, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(start, end - start) for c in keep],
                        *map(pa.array, both), pa.array(size, pa.int64()), *[pa.ListArray.from_arrays(ends, x) for x in lists],
                    ],
                    [*keep, "word", "pair", "size", "rest", "times"],
                )

    part = in_arrow(rows, run, schema)
    part = gathered_cut(part.drop("rest", "times"), "toxic-sums") if rest is None else gathered_cut(part, "toxic-parts")
    handed.destroy()  # the sums are written: no executor needs it any more
    if rest is None:
        return part
    asked = part.select("row_no", F.inline(F.arrays_zip("rest", "times"))).withColumnRenamed("rest", "key")
    # An expression may stand in very many texts, but then it is held; what is joined is rare.
    found = asked.join(rest.select("key", "ratio").hint("merge"), "key").withColumn("value", F.col("ratio") * F.col("times"))
    is_pair = F.col("key").bitwiseAND(F.lit(1)) == 1
    more = found.groupBy("row_no").agg(*[F.sum(F.when(c, F.col("value"))).alias(f"more_{k}") for k, c in zip(KINDS, (~is_pair, is_pair))])
    whole = part.drop("rest", "times").join(more.hint("merge"), "row_no", "left")
    added = {k: F.col(k) + F.coalesce(f"more_{k}", F.lit(0.0)) for k in KINDS}
    return gathered_cut(whole.withColumns(added).select(*keep, *KINDS, "size"), "toxic-sums")


def _fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty * np.eye(len(w)) * len(x), x.T @ (p - y) + penalty * len(x) * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features(kind: str) -> list[Column]:
    """The difference of log-likelihoods per word, and per root of the number of words."""
    size = F.greatest(F.col("size").cast("double"), F.lit(1.0))
    clip = lambda c, most: F.greatest(F.least(c, F.lit(most)), F.lit(-most))
    return [clip(F.col(kind) * 100 / size, 20.0), clip(F.col(kind) / F.sqrt(size), 10.0)]


def _scored(named: DataFrame, labels: DataFrame, trains: Column, calibrates: Column, more: list[str]) -> DataFrame:
    """The columns doc_id, score and ``more`` of rows (row_no, doc_id, text and more)."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).cast("long").alias("toxic"))
    learn = known.where(trains & ~calibrates)
    # Only texts that may have a label are moved to it.
    labelled = named.select("doc_id", "text").where(trains & ~calibrates).where(key_filter(learn, ["doc_id"])).join(learn.hint("merge"), "doc_id")
    table = ratios(count_expressions(labelled))
    if table is not None:
        table = gathered_cut(table, "kn-ratios")
    found = sums(named, table, ["row_no", "doc_id", *more])
    curve_ids = known.where(calibrates)
    n = curve_ids.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < -(-(CURVE_ROWS << 20) // max(n, 1))
    lines = [c for kind in KINDS for c in _features(kind)]
    seen = found.where(calibrates).join(curve_ids.where(part), "doc_id")
    seen = sorted(map(tuple, seen.select("toxic", *[c.alias(f"x{i}") for i, c in enumerate(lines)]).collect()))
    y = np.array([r[0] for r in seen], float)
    if table is None or len(set(y)) < 2:
        share = known.where(trains | calibrates).agg(F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("p")).first().p
        return found.select("doc_id", *more, F.lit(float(share)).alias("score"))
    w = _fit_curve(np.array([r[1:] for r in seen], float), y)
    line = F.lit(float(w[-1]))
    for c, x in zip(lines, w):
        line = line + c * float(x)
    return found.select("doc_id", *more, (1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def score(
    docs: DataFrame,
    labels: DataFrame,
    trains: Column,
    calibrates: Column,
    limit: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher: toxic is likelier), predicted (score at least ``limit``).

    ``labels``: doc_id and toxic (0 or 1; NULL is no label; of several labels
    of a document the highest counts). ``trains`` and ``calibrates`` say by the
    id which labelled rows give counts and which the curve; no other label is
    read. The curve uses a sample of about ``CURVE_ROWS`` rows. NULL and empty
    texts are scored as texts without a letter. With labels of one class only,
    every score is the share of toxic labels. Repeated rows give repeated rows;
    further columns play no part.
    """
    named = docs.select(F.monotonically_increasing_id().alias("row_no"), docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    scored = _scored(named, labels, trains, calibrates, [])
    return scored.select("doc_id", "score").withColumn("predicted", (F.col("score") >= limit).cast("int"))


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    trains: Column,
    calibrates: Column,
    limit: float = 0.7,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns: each row by itself, whatever its id."""
    others = [c for c in docs.columns if c != text]
    named = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"),
    )
    scored = _scored(named, labels, trains, calibrates, ["text", "others"]).where(F.col("score") < limit)
    return scored.select(*[F.col("text").alias(text) if c == text else F.col(f"others.`{c}`") for c in docs.columns])


def default_folds() -> tuple[Column, Column]:
    """Rows to learn from (``crc32`` of the id modulo 3 is not 1), and the fifth of them that fits the curve."""
    return ~fold("doc_id", 3).isin(1, -1), fold("doc_id", 15).isin(3, 8)
