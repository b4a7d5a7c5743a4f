"""Token ids in binary files of independent zstandard frames with a trailing seek table.

File layout, all numbers little-endian:

* one zstandard frame per document, holding its ids as unsigned 32-bit numbers
  (a document beyond ``FRAME_IDS`` ids takes several frames, each on its own);
  every frame has zstandard's own content checksum
* a skippable frame with the document id of every frame (signed 64-bit)
* the seek table of the seekable zstandard format, again a skippable frame:
  compressed size, decompressed size and checksum of every frame, and a footer

Any zstandard tool can unpack such a file. A reader takes the footer, the seek
table and the document ids from the end of the file, and then reads and
decompresses only the frames it wants, checking each one.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.chunks import word_table
from tableflow.llm.common import in_arrow, text_slices

FRAME_IDS = 1 << 20
# Fixed values of the seekable zstandard format.
SEEK_MAGIC, SEEK_FOOTER, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("check", "<u4")])
FOOTER = struct.Struct("<IBI")
HEAD = struct.Struct("<II")


def _check(raw) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Write documents to a binary stream, in the order of the calls."""

    def __init__(self, out, level: int = 1):
        self.out, self.entries, self.doc_ids = out, [], []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        for start in range(0, max(len(ids), 1), FRAME_IDS):
            raw = ids[start : start + FRAME_IDS].astype("<u4").tobytes()
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.entries.append((len(packed), len(raw), _check(raw)))
            self.doc_ids.append(doc_id)

    def close(self) -> None:
        index = np.asarray(self.doc_ids, "<i8").tobytes()
        self.out.write(HEAD.pack(INDEX_MAGIC, len(index)) + index)
        table = np.array(self.entries, ENTRY).tobytes()
        self.out.write(HEAD.pack(SEEK_MAGIC, len(table) + FOOTER.size) + table)
        self.out.write(FOOTER.pack(len(self.entries), 0x80, SEEK_FOOTER))


class FrameReader:
    """Read documents from a random-access file; only the frames asked for are read."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_FOOTER or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - FOOTER.size - n * ENTRY.itemsize
        self.entries = np.frombuffer(self._at(table, n * ENTRY.itemsize), ENTRY)
        self.doc_ids = np.frombuffer(self._at(table - HEAD.size - 8 * n, 8 * n), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def frame(self, k: int) -> np.ndarray:
        raw = self.unpack.decompress(self._at(int(self.starts[k]), int(self.entries["packed"][k])), max_output_size=max(1, int(self.entries["raw"][k])))
        if len(raw) != self.entries["raw"][k] or _check(raw) != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        """Each document's id and its frames, in file order; all documents, or those with the given ids."""
        wanted = None if doc_ids is None else np.isin(self.doc_ids, np.fromiter(doc_ids, np.int64))
        # A document starts where the id changes or the frame before it was not a full one.
        full = self.entries["raw"] == 4 * FRAME_IDS
        first = np.ones(len(self.doc_ids), bool)
        first[1:] = (self.doc_ids[1:] != self.doc_ids[:-1]) | ~full[:-1]
        lead = np.flatnonzero(first)
        for a, b in zip(lead, np.append(lead[1:], len(first))):
            if wanted is None or wanted[a]:
                yield int(self.doc_ids[a]), (self.frame(k) for k in range(a, b))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write files in ascending document order below ``path``.

    ``path`` must be on storage that all executors reach, given as a URI or an
    absolute path. Documents are dealt out by ranges of their id and each task
    writes one file, under another name until it is whole, so that a repeated
    task leaves the same file. Returns the manifest, itself stored below
    ``path``: part, file, n_docs, n_tokens.

    NULL texts count as empty and get the end id only; repeated rows are
    written again; rows without an id come first, under the smallest id.
    """
    spark = docs.sparkSession
    files = path if "://" in path else f"file://{path}"

    def run(batches):
        store, root = pafs.FileSystem.from_uri(files)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = f"part-{part:06d}.ids.zst"
        done, draft = posixpath.join(root, name), posixpath.join(root, f".draft-{attempt}-{name}")
        writer, n_docs, n_tokens = None, 0, 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for start, stop, texts in text_slices(batch):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                    writer = FrameWriter(out)
                ids, ends = word_table(tokenizer)(texts)
                keys = batch.column("doc_id").slice(start, stop - start).to_numpy(zero_copy_only=False)
                for key, a, b in zip(keys.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                    writer.add(key, np.concatenate([ids[a:b], end]))
                n_docs, n_tokens = n_docs + len(keys), n_tokens + len(ids) + len(keys)
        if writer is not None:
            writer.close()
            out.close()
            store.move(draft, done)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{files}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    key = F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63)))
    ordered = docs.select(key.alias("doc_id"), docs[text].alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    schema = "part long, file string, n_docs long, n_tokens long"
    in_arrow(ordered, run, schema, keeps=tokenizer).write.parquet(f"{path}/manifest")
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def read_files(manifest: DataFrame, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, in all files. With
    ``doc_ids``, only the frames of those documents are decompressed.
    """
    wanted = None if doc_ids is None else list(doc_ids)

    def run(batches):
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                store, name = pafs.FileSystem.from_uri(file)
                with store.open_input_file(name) as opened:
                    reader = FrameReader(opened)
                    # The sizes of all frames are in the seek table: no skipped frame needs reading.
                    starts = np.concatenate([[0], np.cumsum(reader.entries["raw"] // 4, dtype=np.int64)])
                    spare = dict(zip(reader.doc_ids.tolist()[::-1], starts[:-1].tolist()[::-1])) if wanted is not None else None
                    rows, place = [], 0
                    for key, frames in reader.documents(wanted):
                        n = crc = 0
                        for ids in frames:
                            n, crc = n + len(ids), zlib.crc32(ids.tobytes(), crc)
                        rows.append((key, before + (place if spare is None else spare[key]), n, crc))
                        place += n
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    # One row per file here, so a single task may add them up.
    total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(total), F.lit(0)))
    # A number of partitions of one's own keeps Spark from putting the few rows together into one task.
    width = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = files.select("file", "before").repartition(width, "file")
    return in_arrow(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))
