"""Near duplicates by Order MinHash and banded alignment.

Texts are sequences of words; ``K`` words in a row, numbered by how often they
occurred before, are an occurrence-labelled k-mer. A sketch samples the
``TUPLE`` smallest k-mers under a hash and keeps them in text order, so two
texts share a sketch if they share these k-mers in the same order. Texts that
share one of ``SKETCHES`` sketches are candidates. A banded alignment of their
words verifies them: the similarity is the share of k-mers that both texts have
in one alignment, ``matched / (a + b - matched)``, as in the Jaccard measure.

Texts with equal words are one class from the start, and one of them stands for
all. Texts with the same sketch form a bucket. Its members are aligned with a
pivot from the middle of the group, those not similar to it with the next two
pivots. So a bucket of n similar texts costs about n alignments. Every bucket
that is then still in several connected parts is settled exactly: texts can be
similar only if they share one of their rarest k-mers, about a fifth of each
text's. All such pairs of texts in different parts are aligned.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tableflow.llm.common import NO_MARKER, gathered, in_arrow, mix, numbered, scratch, text_slices, word_hashes
from tableflow.llm.common import gathered_cut as cut

K, TUPLE, SKETCHES = 5, 3, 16
PIVOTS = 3
SIMILARITY = 0.8
SLICE = 1 << 20  # bytes of text hashed at once: the arrays of its letters take many times that
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))


def _kmers(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of all texts in order, and the number of k-mers before each text.

    A text of fewer than ``K`` words has all of them as its only k-mer.
    """
    n = np.diff(ends)
    counts = np.where(n > 0, np.maximum(n - K + 1, 1), 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(before[-1]) + np.repeat(ends[:-1] - before[:-1], counts)
    lengths = np.repeat(np.minimum(n, K), counts)
    value = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([words, np.zeros(K, np.uint64)])
    for i in range(K):
        value = mix(value + np.where(i < lengths, padded[starts + i], np.uint64(0)) + np.uint64(i + 1))
    # Label: how many equal k-mers of the same text come before.
    own = np.repeat(np.arange(len(n), dtype=np.uint64), counts)
    order = np.lexsort((np.arange(len(value)), value, own))
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[order][1:] != value[order][:-1]) | (own[order][1:] != own[order][:-1])
    lead = np.flatnonzero(fresh)
    label = np.empty(len(value), np.uint64)
    label[order] = np.arange(len(value)) - np.repeat(lead, np.diff(np.append(lead, len(value))))
    return mix(value ^ (label * np.uint64(0x9E3779B97F4A7C15))), before


def sketches(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of ``SKETCHES`` hashes per text, all of whose texts have words."""
    kmers, before = _kmers(words, ends)
    out = np.zeros((len(ends) - 1, SKETCHES), np.uint64)
    counts, starts = np.diff(before), before[:-1]
    for s in range(SKETCHES):
        key = mix(kmers + SEEDS[s])
        picked, taken = [], key.copy()
        for _ in range(TUPLE):
            least = np.minimum.reduceat(taken, starts)
            place = np.flatnonzero(taken == np.repeat(least, counts))
            # One place per text: the first, if the hash of two k-mers should be the same.
            own = np.searchsorted(before, place, "right") - 1
            place = place[np.unique(own, return_index=True)[1]]
            picked.append(place)
            taken[place] = np.uint64(0xFFFFFFFFFFFFFFFF)
        inner = np.sort(np.stack(picked), axis=0)
        for row in inner:
            out[:, s] = mix(out[:, s] * np.uint64(3) + kmers[row])
    return out


def _in_a_row(words: np.ndarray) -> np.ndarray:
    """A hash of every ``K`` words in a row."""
    n = len(words) - K + 1
    value = np.zeros(n, np.uint64)
    for i in range(K):
        value = mix(value + words[i : i + n])
    return value


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Share of k-mers that two word sequences have in one banded alignment; 0 where it is below ``least``.

    The alignment follows a diagonal as far as the k-mers agree, and then goes
    on at the nearest place where they agree again. What it may skip, and with
    it how far it may leave the diagonal, is bounded by the similarity that is
    still possible.
    """
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if min(len(a), len(b)) < K:
        return 0.0
    a, b = _in_a_row(a.astype(np.uint64)), _in_a_row(b.astype(np.uint64))
    needed = int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    band = len(a) + len(b) - 2 * needed  # k-mers that may be skipped in both together
    if min(len(a), len(b)) < needed:
        return 0.0
    matched, i, j, skipped = 0, 0, 0, 0
    while i < len(a) and j < len(b):
        size, run, step = min(len(a) - i, len(b) - j), 0, 64
        while run < size:
            part = min(step, size - run)
            differ = np.flatnonzero(a[i + run : i + run + part] != b[j + run : j + run + part])
            if len(differ):
                run += int(differ[0])
                break
            run, step = run + part, step * 4
        matched, i, j = matched + run, i + run, j + run
        if i >= len(a) or j >= len(b):
            break
        x, y = _rejoin(a[i : i + band + 1], b[j : j + band + 1])
        i, j, skipped = i + x, j + y, skipped + x + y
        if skipped > band:
            return 0.0
    similarity = matched / (len(a) + len(b) - matched)
    return similarity if similarity >= least - 1e-12 else 0.0


def _rejoin(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The first places of an equal value with the least sum; the ends if there is none."""
    reach = 4 * K
    while True:
        left, first = np.unique(a[:reach], return_index=True)
        right, second = np.unique(b[:reach], return_index=True)
        place = np.minimum(np.searchsorted(right, left), len(right) - 1)
        both = right[place] == left
        if both.any():
            x, y = first[both], second[place[both]]
            # A nearer pair may lie beyond ``reach`` in one of the two only if this one is further than that.
            best = np.lexsort((x, x + y))[0]
            if x[best] + y[best] < reach or reach >= max(len(a), len(b)):
                return int(x[best]), int(y[best])
        if reach >= max(len(a), len(b)):
            return len(a), len(b)
        reach *= 8


def _named(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row_no, doc_id and text of rows that are written with their numbers."""
    return rows.select("row_no", F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"), F.col(f"row.`{text}`").alias("text"))


def _sketched(named: DataFrame) -> DataFrame:
    """Per row: row_no, doc_id, a digest of its words (without any, of the text), and its sketches (none without words)."""

    def digests(held: bytes, ends: np.ndarray, texts: pa.Array) -> list[bytes]:
        out = [hashlib.sha256(held[8 * a : 8 * b]).digest() for a, b in zip(ends[:-1], ends[1:])]
        for i in np.flatnonzero(np.diff(ends) == 0):
            out[i] = hashlib.sha256(b"text:" + "".join(texts[int(i)].as_py().split()).encode()).digest()
        return out

    def run(batches):
        for batch in batches:
            for start, end, texts in text_slices(batch, most=SLICE):
                words, ends = word_hashes(texts)
                some = np.flatnonzero(np.diff(ends))
                found = sketches(words, np.append(ends[some], ends[-1])) + SEEDS if len(some) else np.zeros((0, SKETCHES), np.uint64)
                held = words.astype("<u8").tobytes()
                places = np.searchsorted(some, np.arange(len(ends))) * SKETCHES
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_no").slice(start, end - start),
                        batch.column("doc_id").slice(start, end - start),
                        pa.array(digests(held, ends, texts), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(mix(found).ravel().view(np.int64))),
                    ],
                    ["row_no", "doc_id", "digest", "sketches"],
                )

    return in_arrow(named, run, "row_no long, doc_id long, digest binary, sketches array<long>")


def _words_table(named: DataFrame, reps: DataFrame) -> str:
    """Store the words of the given rows (rep) as 32-bit hashes, bucketed by rep so that later joins move pairs only."""
    spark = named.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            for start, end, texts in text_slices(batch, most=SLICE):
                words, ends = word_hashes(texts)
                held = (words >> np.uint64(32)).astype("<u4").tobytes()
                packed = pa.array([held[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(start, end - start), packed], ["rep", "words"])

    wanted = named.select(F.col("row_no").alias("rep"), "text").join(reps.hint("merge"), "rep", "left_semi")
    name = f"omh_words_{uuid.uuid4().hex}"
    # The merge join has dealt the rows by rep already, so a task holds whole buckets.
    in_arrow(wanted, run, "rep long, words binary").write.bucketBy(n, "rep").sortBy("rep").saveAsTable(name)
    return name


def _aligned(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Pairs (rep, pivot) with ``similar``: whether their alignment reaches the similarity."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("left"), batch.column("right"))
            similar = [
                aligned_similarity(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), similarity) > 0 for x, y in rows
            ]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("pivot"), pa.array(similar, pa.bool_())], ["rep", "pivot", "similar"])

    # A pivot may stand in very many pairs: its words are stored first, so that the join can split such a key.
    pivots = pairs.select(F.col("pivot").alias("rep")).distinct().join(words, "rep")
    pivots = cut(pivots.select(F.col("rep").alias("pivot"), F.col("words").alias("right")), "omh-pivot-words")
    own = pairs.hint("merge").join(words.withColumnRenamed("words", "left"), "rep")
    joined = own.join(pivots.hint("merge"), "pivot").select("rep", "pivot", "left", "right")
    return in_arrow(joined, run, "rep long, pivot long, similar boolean")


def links(texts: DataFrame, named: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b), a above b, between rows that share a sketch; and their components (node, root).

    ``texts``: rep and sketches of the rows to link; ``named``: row_no and
    text of all rows.
    """
    spark = texts.sparkSession
    sketched = cut(texts.select("rep", F.explode("sketches").alias("bucket")), "omh-sketches")
    sizes = cut(sketched.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "omh-sizes")
    shared = cut(sketched.join(sizes.hint("merge"), "bucket"), "omh-shared")
    # A text that shares sketches with many others lies in the middle of its group and is a good pivot.
    middle = cut(shared.groupBy("rep").agg(F.sum("n").alias("c")), "omh-middle")
    members = cut(shared.join(middle.hint("merge"), "rep").select("bucket", "rep", "c", "n"), "omh-members")
    name = _words_table(named, middle.select("rep"))
    try:
        words = spark.table(name)
        found = _pivot_links(members, words, similarity)
        parts = components(found)
        more = _links_between(members, parts, words, similarity)
        edges = parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        return found.unionByName(more), components(edges)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _pivot_links(members: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links of the members of each bucket to a first pivot, and of those without one to the next pivots."""
    order = Window.partitionBy("bucket").orderBy(F.desc("c"), F.xxhash64("rep"), "rep")
    pivots = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS)
    pivots = cut(pivots.select("bucket", F.col("rep").alias("pivot"), "place"), "omh-pivots")
    found, left = [], members.select("bucket", "rep")
    for some in (pivots.where("place = 1"), pivots.where("place > 1")):
        joined = left.join(some.select("bucket", "pivot").hint("merge"), "bucket").where("rep <> pivot")
        joined = cut(joined.select("bucket", "rep", "pivot"), "omh-joined")
        pairs = cut(joined.select("rep", "pivot").distinct(), "omh-pairs")
        good = cut(_aligned(pairs, words, similarity).where("similar").select("rep", "pivot"), "omh-similar")
        found.append(good.select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")))
        # A member met one pivot, the first; that pivot itself goes on with those that are not similar to it.
        apart = joined.join(good.hint("merge"), ["rep", "pivot"], "left_anti").select("bucket", "rep")
        left = apart.unionByName(some.select("bucket", F.col("pivot").alias("rep")))
    return cut(found[0].unionByName(found[1]).distinct(), "omh-links")


def _text_kmers(words: DataFrame) -> DataFrame:
    """One row per occurrence-labelled k-mer of texts of ``K`` words or more: rep, kmer, and n, how many the text has."""

    def run(batches):
        for batch in batches:
            for rep, held in zip(batch.column("rep").to_pylist(), batch.column("words")):
                own = np.frombuffer(held.as_buffer(), "<u4").astype(np.uint64)
                if len(own) >= K:
                    kmers = _kmers(own, np.array([0, len(own)]))[0].view(np.int64)
                    n = len(kmers)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, rep, np.int64)), pa.array(kmers), pa.array(np.full(n, n, np.int64))], ["rep", "kmer", "n"]
                    )

    return in_arrow(words, run, "rep long, kmer long, n long")


def _links_between(members: DataFrame, parts: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """All links between texts in different parts whose buckets are not yet within one part.

    With the k-mers in one order, rare ones first, two texts whose similarity
    is reached share a k-mer of their first ``n - ceil(similarity * n) + 1``.
    """
    # In a bucket of up to PIVOTS members all pairs between parts are tried by now.
    named = members.where(F.col("n") > PIVOTS).join(parts.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    named = cut(named.select("bucket", "rep", F.coalesce("root", "rep").alias("part")), "omh-named-members")
    several = named.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    several = cut(several.where("low < high").select("bucket"), "omh-unsettled")
    texts = cut(named.join(several.hint("merge"), "bucket").select("rep", "part").distinct(), "omh-unsettled-texts")
    kmers = cut(_text_kmers(texts.select("rep").hint("merge").join(words, "rep")), "omh-kmers")
    common = cut(kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "omh-common-kmers")
    # K-mers of one text only come first and need no rows; ``place`` counts them.
    own = Window.partitionBy("rep")
    rare = kmers.join(common.hint("merge"), "kmer").withColumn("place", F.row_number().over(own.orderBy("holders", "kmer")) - 1)
    rare = rare.withColumn("place", F.col("place") + F.col("n") - F.count(F.lit(1)).over(own))
    rare = rare.where(F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9)).select("rep", "kmer", "n", "place")
    rare = cut(rare.join(texts.hint("merge"), "rep"), "omh-rare")
    # Members of the part that most holders of a k-mer are in meet the others only.
    most = rare.groupBy("kmer", "part").agg(F.count(F.lit(1)).alias("held")).groupBy("kmer")
    most = most.agg(F.max_by("part", F.struct("held", "part")).alias("most"), F.count(F.lit(1)).alias("parts"))
    rare = cut(rare.join(most.where("parts > 1").drop("parts").hint("merge"), "kmer"), "omh-rare-between")
    x, y = rare.where("part <> most").alias("x"), rare.alias("y")
    needed = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-9
    fits = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= needed
    once = (F.col("y.part") == F.col("y.most")) | (F.col("x.rep") > F.col("y.rep"))
    met = x.join(y.hint("merge"), (F.col("x.kmer") == F.col("y.kmer")) & (F.col("x.part") != F.col("y.part")) & once & fits)
    pairs = met.select(F.greatest("x.rep", "y.rep").alias("rep"), F.least("x.rep", "y.rep").alias("pivot"))
    good = _aligned(cut(pairs.distinct(), "omh-between"), words, similarity).where("similar")
    return cut(good.select(F.col("rep").alias("a"), F.col("pivot").alias("b")), "omh-links-between")


def _neighbours(state: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Edges (a, b) in both directions; per node its least neighbour ``m``, written; and how many nodes are not yet in a star.

    In a star the centre has neighbours above it only, and every other node has the centre alone.
    """
    both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
    below = F.max(F.when(F.col("b") < F.col("a"), F.col("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), below.alias("below"), F.max("b").alias("most"))
    watch, path = Observation(), scratch(state.sparkSession, "star-least")
    several = (F.col("below") != F.col("m")) | (F.col("most") > F.col("a"))
    stray = F.count_if(F.col("below").isNotNull() & several).alias("stray")
    gathered(least.observe(watch, stray)).write.options(**NO_MARKER).parquet(path)
    return both, state.sparkSession.read.schema(least.schema).parquet(path), watch.get["stray"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): node, least node of its component. Alternating star contraction, in written rounds.

    The aggregate that a round begins with also tells whether only stars are left, so no round is spent on finding no change.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = cut(state, "star")
    while True:
        both, least, stray = _neighbours(state)
        if not stray:
            return least.where("m < a").select(F.col("a").alias("node"), F.col("m").alias("root"))
        # Large star: every neighbour above a node is linked to the least one around it.
        large = both.join(least.select("a", F.least("a", "m").alias("m")).hint("merge"), "a").where("b > a")
        large = cut(large.select(F.col("b").alias("a"), F.col("m").alias("b")), "star-large")
        # Small star: a node and its lower neighbours are linked to the least of them. An edge makes one edge in each
        # step, so there are never more than at the start, repeated ones included.
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "star-low")
        small = large.join(low.hint("merge"), "a")
        state = cut(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")), "star")


def classes(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: row_no, doc_id, class_id, class_size, n_links, kept.

    A class is a connected set of near duplicates; ``class_id`` is its smallest
    doc_id, whose first row is the one kept. ``n_links``: verified links
    between the text of the row and other texts. Texts with the same words
    (runs of letters and digits, without regard to case; single letters in
    scripts without blanks) are near duplicates. Texts without a word are when
    they are equal but for white space; NULL counts as empty. Texts of fewer than ``K`` words
    are similar to texts with the same words only. A row without an id counts
    as one with the smallest possible id. An empty table gives no rows; further
    columns play no part.
    """
    return _classes(numbered(docs.select(doc_id, text), "omh-numbered"), similarity, doc_id, text)


def _classes(written: DataFrame, similarity: float, doc_id: str, text: str) -> DataFrame:
    """``classes`` of rows that are written with their numbers (``row``, ``row_no``)."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    named = _named(written, doc_id, text)
    rows = cut(_sketched(named), "omh-rows")
    first = F.min(F.struct(key.alias("key"), "row_no")).alias("first")
    equal = cut(rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")), "omh-equal")
    equal = equal.select("digest", "n", F.col("first.key").alias("key"), F.col("first.row_no").alias("rep"))
    texts = rows.select(F.col("row_no").alias("rep"), "sketches").join(equal.select("rep").hint("merge"), "rep", "left_semi")
    found, roots = links(texts, named, similarity)
    degree = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    members = equal.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    members = cut(members.withColumn("root", F.coalesce("root", "rep")).withColumn("n_links", F.coalesce("n_links", F.lit(0))), "omh-roots")
    whole = members.groupBy("root").agg(F.min(F.struct("key", "rep")).alias("best"), F.sum("n").alias("class_size"))
    of = members.join(cut(whole, "omh-classes").hint("merge"), "root")
    of = of.select("digest", "n_links", "class_size", F.col("best.key").alias("class_id"), F.col("best.rep").alias("keep"))
    out = rows.select("row_no", "doc_id", "digest").join(of.hint("merge"), "digest")
    return out.select("row_no", "doc_id", "class_id", "class_size", "n_links", (F.col("row_no") == F.col("keep")).alias("kept"))


def distinct(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    rows = numbered(docs, "omh-numbered")
    dropped = _classes(rows, similarity, doc_id, text).where("NOT kept").select("row_no")
    return rows.join(dropped.hint("merge"), "row_no", "left_anti").select("row.*")
