"""A table of distinct chunks: each distinct chunk of text is encoded once, ids are joined back by position.

A chunk is a stretch between two places that no token of the tokenizer can
span, so the ids of a text are the ids of its chunks in a row. Every slice of
text is cut at such places with array operations; its distinct chunks are
looked up in the table, the new ones go through the tokenizer's own library,
and an index array puts the ids back in order. The table is kept from task to
task of a Python worker, until one comes that does not use it, and begins anew
beyond ``TABLE_CHUNKS``, so it is bounded and no result depends on it.

Texts for which the cutting rule is not proven (see ``odd``) go through the
library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from tableflow.llm.common import kept, ragged, utf8

TABLE_CHUNKS = 800_000

#: White space beyond the six ASCII characters that the cutting rules know.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")


class ChunkTable:
    """Encode many texts by their distinct chunks.

    ``cuts``: bytes, and a mask of those with a next one in their text, to a mask
    of the bytes before which a chunk ends.
    ``encode``: chunks to all their ids in a row and the number of ids of each,
    by the library. ``whole``: texts to lists of ids, by the library. ``odd``:
    texts to encode whole. ``fold``: whether the library lower-cases, so that
    chunks may be told apart without regard to ASCII case.
    """

    def __init__(
        self,
        cuts: Callable[[np.ndarray, np.ndarray], np.ndarray],
        encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        whole: Callable[[list[str]], list[list[int]]],
        odd: re.Pattern,
        fold: bool = False,
        table_chunks: int = TABLE_CHUNKS,
    ):
        self.cuts, self.encode, self.whole, self.odd, self.fold, self.limit = cuts, encode, whole, odd, fold, table_chunks
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _rows(self, chunks: list[bytes]) -> np.ndarray:
        """Rows of the table for distinct chunks; new ones are encoded."""
        if len(self.place) + len(chunks) > self.limit:
            self.clear()
        rows = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            new = [chunks[k] for k in fresh.tolist()]
            flat, lengths = self.encode([c.decode("utf-8") for c in new])
            rows[fresh] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, rows[fresh].tolist()))
            self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        return rows

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids before each text (and after the last)."""
        data, offsets = utf8(texts)
        apart = [i for i, x in enumerate(texts.to_pylist()) if self.odd.search(x)] if self._suspect(data) else []
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if len(data):
            edge[:-1] |= self.cuts(data, ~edge[1:])
        places = np.flatnonzero(edge)
        if self.fold:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        if len(places) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        chunks = pa.Array.from_buffers(
            pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        rows = self._rows(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())[chunks.indices.to_numpy()]
        lengths = (self.start[1:] - self.start[:-1])[rows]
        ids = ragged(self.ids, self.start[rows], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(places, offsets)]
        return self._with_whole(texts, apart, ids, ends) if apart else (ids, ends)

    def _suspect(self, data: np.ndarray) -> bool:
        """Whether some text may hold a character of ``odd``: its bytes hold 0, 0x1c-0x1f or a byte from 0xc2, 0xe1-0xe3, 0xef."""
        return bool((data == 0).any() or ((data >= 0x1C) & (data <= 0x1F)).any() or np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3, 0xEF)).any())

    def _with_whole(self, texts: pa.Array, apart: list[int], ids: np.ndarray, ends: np.ndarray):
        whole = dict(zip(apart, self.whole([texts[i].as_py() for i in apart])))
        parts = [np.asarray(whole[i], np.uint32) if i in whole else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _letter(data: np.ndarray) -> np.ndarray:
    return ((data | 32) >= 97) & ((data | 32) <= 122)


def cuts_at_words(data: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Cuts for tokenizers that first split a text by the usual expression for words.

    A cut stands before the first of several white-space characters, before and
    after the last of them if a word follows and it is no blank (then it neither
    joins the others nor the word), and between an ASCII letter and a comma or
    full stop. ``inner``: bytes that have a next one in their text.
    """
    space = _space(data)
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    alone = np.zeros(len(data), bool)
    alone[:-1] = space[:-1] & (data[:-1] != 32) & ~space[1:]
    alone &= inner
    cut |= alone
    cut[1:] |= alone[:-1]
    cut[1:] |= ((data[1:] == 44) | (data[1:] == 46)) & _letter(data[:-1])
    return cut


def cuts_at_markers(data: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Cuts before each run of blanks (the white-space marker), and around each line break."""
    cut = np.zeros(len(data), bool)
    blank, line = data == 32, data == 10
    cut[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    return cut


def flat_ids(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and the number of ids of each."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


class WordEncoder:
    """Ids of chunks from a file of the tokenizers library whose words are split before they are merged.

    Most chunks are one plain word. The library takes many of them in one call,
    and the ids of each are told apart by the ids that begin a word (a blank
    comes first) or end one (the vocabulary marks it), one per plain word. All
    other chunks, and any call whose marks do not add up, are told apart by the
    library's word numbers, which take it twice as long.

    Where words are split by bytes, a blank and letters of ASCII or Latin-1 are
    one word, and the ASCII signs after them another. Such chunks go to the
    library's model at once, in the characters that stand for their bytes, and
    are neither split nor rewritten again.
    """

    SIMPLE = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+([!-/:-@\[-`{-~]+)?")
    SIGNS = re.compile(r"(?<![!-/:-@\[-`{-~\n])(?=[!-/:-@\[-`{-~])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fold = self.library.normalizer is not None and self.library.normalizer.normalize_str("A") == "a"
        self.suffix = self.library.model.end_of_word_suffix
        pieces = sorted(self.library.get_vocab().items(), key=lambda x: x[1])
        self.marks = np.zeros(pieces[-1][1] + 1, bool)
        for piece, i in pieces:
            self.marks[i] = piece.endswith(self.suffix) if self.suffix else piece.startswith("Ġ")
        self.bare = None
        if self.library.normalizer is None and not self.suffix and isinstance(self.library.pre_tokenizer, ByteLevel):
            self.bare = Tokenizer(self.library.model)
            # Every byte that such a chunk may hold, and the character the library takes for it.
            stands = {x: chr(x) for x in range(256)}
            for letters in (" A", *map(chr, range(0xC0, 0x100))):
                stands.update(zip(letters.encode(), self.library.pre_tokenizer.pre_tokenize_str(letters)[0][0]))
            self.stands = "".join(stands[x] for x in range(256))

    def _kind(self, chunk: str) -> int:
        simple = self.SIMPLE.fullmatch(chunk) if self.bare else None
        return int(self._plain(chunk)) if simple is None else 2 if simple.lastindex is None else 3

    def _plain(self, chunk: str) -> bool:
        if self.suffix:
            return chunk.strip(" ").lower().isalpha()
        return chunk[0] == " " and chunk[1:].isalpha()

    def _signed(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._simple(chunks, self.SIGNS.sub("\n", "\n".join(chunks)))

    def _simple(self, chunks: list[str], lines: str = "") -> tuple[np.ndarray, np.ndarray]:
        words = (lines or "\n".join(chunks)).encode().decode("latin-1").translate(self.stands).split("\n")
        return self._told_apart(self.bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0], chunks)

    def _words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._told_apart(self.library.encode_batch_fast([chunks], is_pretokenized=True, add_special_tokens=False)[0], chunks)

    def _told_apart(self, got, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(got.ids, np.uint32)
        places = np.flatnonzero(self.marks[ids])
        if len(places) != len(chunks) or not len(ids) or places[0 if not self.suffix else -1] != (len(ids) - 1 if self.suffix else 0):
            return self._any(chunks)
        lengths = np.diff(places, prepend=-1) if self.suffix else np.diff(places, append=len(ids))
        return ids, lengths

    def _any(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.library.encode_batch([chunks], is_pretokenized=True, add_special_tokens=False)[0]
        return np.asarray(got.ids, np.uint32), np.bincount(np.asarray(got.word_ids, np.int64), minlength=len(chunks))

    def __call__(self, chunks: list[str], step: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        kinds = np.fromiter(map(self._kind, chunks), np.int8, len(chunks))
        lengths, parts, order = np.zeros(len(chunks), np.int64), [], []
        for kind, encode in enumerate((self._any, self._words, self._simple, self._signed)):
            rows = np.flatnonzero(kinds == kind)
            order.append(rows)
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                ids, lengths[own] = encode([chunks[k] for k in own.tolist()])
                parts.append(ids)
        order = np.concatenate(order)
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return ragged(np.concatenate(parts), starts, lengths), lengths

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def _word_table(path: str) -> ChunkTable:
    encoder = WordEncoder(path)
    return ChunkTable(cuts_at_words, encoder, encoder.whole, ODD_SPACE, encoder.fold)


def word_table(path: str) -> ChunkTable:
    """This worker's table for a tokenizer file; its tasks keep ``path``."""
    return kept(path, partial(_word_table, path))
