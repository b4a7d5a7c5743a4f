"""SentencePiece encoding and decoding by a table of distinct chunks.

Pieces cannot cross the white-space marker other than at its front, and none
holds a line break. So a text is cut before each run of blanks and around each
line break; each distinct chunk is segmented once, and ids are joined back by
position (``chunks.ChunkTable``). The library's own ``decode`` turns the ids
back into text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tableflow.llm.chunks import ChunkTable, cuts_at_markers, flat_ids
from tableflow.llm.common import in_arrow, kept, text_slices

class PieceCodec:
    """Exact ids of a SentencePiece BPE model, and the way back."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("this model has pieces across white space: chunks would change its ids")
        # A chunk follows a line break, so that the marker which the library puts first is not its own.
        lead = len(self.model.encode("\n"))
        self.table = ChunkTable(
            cuts_at_markers,
            lambda chunks: flat_ids([ids[lead:] for ids in self.model.encode(["\n" + c for c in chunks], num_threads=1)]),
            lambda texts: self.model.encode([t[1:] for t in texts], num_threads=1),
            re.compile("[▁\x00]"),
        )
        decimals = [f"{i}," for i in range(self.model.vocab_size())]
        self.decimals = pa.array(decimals, pa.large_binary())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids before each text."""
        marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        return self.table(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, marked))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        return [self.model.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(ends[:-1], ends[1:])]

    def decimal_bytes(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
        """The ids of each text in decimal, joined by commas."""
        joined = self.decimals.take(pa.array(ids))
        places = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[ends] if len(joined) else np.zeros(len(ends), int)
        held = memoryview(joined.buffers()[2]) if len(joined) else memoryview(b"")
        for a, b in zip(places[:-1], places[1:]):
            yield bytes(held[a : max(a, b - 1)])


def codec(path: str) -> PieceCodec:
    """This worker's codec for a model file; its tasks keep ``path``."""
    return kept(path, partial(PieceCodec, path))


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ``ids`` (array of ints) without begin or end ids.

    NULL and empty texts have no ids. Repeated rows give repeated rows. Other
    columns of ``docs`` play no part.
    """

    def run(batches):
        for batch in batches:
            for start, end, texts in text_slices(batch):
                ids, ends = codec(model).encode(texts)
                held = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), held.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])

    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return in_arrow(named, run, "doc_id long, ids array<int>", keeps=model)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The way back: doc_id, ``text``."""

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = [codec(model).model.decode(x) if x else "" for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string", keeps=model)


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Round trip of every document as digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One pass without a shuffle; the ids never leave the task. NULL counts as
    the empty text, which has no ids.
    """

    def run(batches):
        for batch in batches:
            for start, end, texts in text_slices(batch):
                own = codec(model)
                ids, ends = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in own.decimal_bytes(ids, ends)]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own.decode(ids, ends)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return in_arrow(named, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=model)
