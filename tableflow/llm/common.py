"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableflow.operators.joins import read_bytes
from tableflow.session import drop_path, new_path

HASH_BYTES = 1 << 18  # of text whose words are hashed at once: some 70 bytes of numbers for each of them
SLICE_BYTES = 4 << 20  # text that a task works on at once; a longer document makes a slice of its own
TASK_BYTES = 4 << 20  # of the files read that a task of ``gathered`` takes
MOST_TASKS = 1 << 20  # where Catalyst does not know the size of a table


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
_LEFT: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, noted for the stage that is running, if one is."""
    path = new_path(spark, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def frees_scratch(stage: Callable) -> Callable:
    """A stage (spark, docs, sf_dir) that first deletes the scratch tables of the stages before it in this session.

    Their results are written by then, so nothing reads those tables any more;
    one that ``docs`` itself still reads stays. Whoever wants a stage's result
    after another stage has begun has to write it first, as the pipeline does.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        read = {part for file in docs.inputFiles() for part in file.split("/")}
        left, made = _LEFT.pop(app, []), []
        for path in left:
            if path.rsplit("/", 1)[1] in read:
                made.append(path)
            else:
                drop_path(spark, path)
        token = _MADE.set(made)
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _MADE.reset(token)
            _LEFT[app] = made

    return run


#: Nobody but the query that wrote a scratch table reads it, and only once it is whole: it needs no marker file.
NO_MARKER = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.options(**NO_MARKER, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in no more tasks than the files it reads are worth, and at least one per core.

    Many shuffle partitions would else make a file each of every small table
    that a job of many steps writes. All rows stay.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(min(max(cores, -(-read_bytes(df) // TASK_BYTES)), MOST_TASKS))


def gathered_cut(df: DataFrame, name: str) -> DataFrame:
    """``cut`` in few files. Not for a function that tells its tasks apart: a task may take several of them."""
    return cut(gathered(df), name)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as ``row`` (all columns) and ``row_no``, a number for each row.

    The numbers are part of the written table, so every later scan finds a row
    under the same one, however many tasks read it. No column of the caller
    can clash with ``row_no``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return gathered_cut(df.select(whole.alias("row"), F.monotonically_increasing_id().alias("row_no")), name)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application; Spark hands the archive out."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


#: What this Python worker keeps from task to task, by name.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable) -> object:
    """This worker's ``make()``, the same for all its tasks that keep ``name`` (see ``in_arrow``)."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def keep_only(name: str | None) -> None:
    """Let go of all that this worker keeps under other names."""
    for other in [k for k in _KEPT if k != name]:
        del _KEPT[other]


def in_arrow(df: DataFrame, run: Callable, schema: str | StructType, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` whose function may use this package.

    A worker lives on from job to job. It begins a task without what it kept
    for others than ``keeps``, and ends one by giving back unused memory.
    """
    ship(df.sparkSession)

    def task(batches):
        keep_only(keeps)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def fold(doc_id: str, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; -1 for no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(-1))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """``slices`` of the texts of a batch. NULL texts come out empty."""
    yield from slices(batch.column(column).cast(pa.large_string()).fill_null(""), most)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int, pa.Array]]:
    """Cut texts into runs of rows with at most ``most`` bytes of text, or one row: first row, end row, the texts."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8))
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > most:
            yield start, row, texts.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if len(sizes) > start:
        yield start, len(sizes), texts.slice(start)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text begins and the last one ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


# Hash parameters: one random odd factor per place in a word, one random value per byte.
_RNG = np.random.default_rng(20240229)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)

#: Letters and digits by byte; every byte of a character outside ASCII counts as one.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Scripts that are written without blanks: each of their letters and marks is a word of its own.
UNSPACED = ("Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Yi")
BORDER, LETTER, ALONE = 0, 1, 2


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """For every code point whether it is a border, a letter (or digit or mark), or a letter that stands alone."""
    place = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])
    every = place.astype("<u4").tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    scripts = "".join(rf"\p{{Script={name}}}" for name in UNSPACED)
    for value, pattern in ((LETTER, r"[\p{L}\p{N}\p{M}]+"), (ALONE, rf"[[{scripts}]&&[\p{{L}}\p{{N}}\p{{M}}]]+")):
        for run in regex.finditer(pattern, every, regex.V1):
            out[place[run.start() : run.end()]] = value
    return out


@lru_cache(1)
def _point_hashes() -> np.ndarray:
    return mix(np.arange(1, 0x3001, dtype=np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words before each text.

    Words are runs of letters, digits and marks of the lower-cased text, in
    any script; in scripts without blanks every letter is a word.
    """
    found, ends = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, part in slices(texts, HASH_BYTES):
        words, own = _word_hashes(part)
        found.append(words)
        ends.append(ends[-1][-1] + own[1:])
    return np.concatenate(found), np.concatenate(ends)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    low = pa.compute.utf8_lower(texts)
    data, offsets = utf8(low)
    if len(data) and data.max() > 127:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(pa.compute.utf8_length(low).to_numpy(zero_copy_only=False))])
    else:
        points = data.astype(np.uint32)
    kind = letter_classes()[points]
    inside = np.zeros(len(points) + 1, bool)
    inside[:-1] = kind != BORDER
    fresh = np.ones(len(points) + 1, bool)
    fresh[1:] = ~inside[:-1]
    fresh[:-1] |= kind == ALONE
    fresh[1:] |= kind == ALONE
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.flatnonzero(inside)
    lead = np.searchsorted(place, starts)
    nth = np.arange(len(place)) - np.repeat(lead, np.diff(np.append(lead, len(place))))
    found, table = points[place], _point_hashes()
    value = table[np.minimum(found, len(table) - 1)]
    far = np.flatnonzero(found >= len(table))
    value[far] = mix(found[far].astype(np.uint64) + np.uint64(1))
    mixed = value * (_PLACE[nth & 63] + (nth >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16))
    return np.add.reduceat(mixed, lead), np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: equal inputs stay equal, near ones come apart."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[starts[i] : starts[i] + lengths[i]]``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]
