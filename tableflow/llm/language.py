"""Language identification in two steps: the family first, then the language within it.

Texts are described by hashed n-grams of the bytes of their lower-cased
letters. A linear support vector machine per family picks the family; within a
family of several languages, one machine for each pair of them votes. All
machines are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.common import _LETTER, in_arrow, text_slices, utf8

DIMENSIONS, GRAMS = 4096, (1, 2, 3)
UNKNOWN = "und"

# Language families of common codes. A code not named here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY.get(code, code)


def describe(texts: pa.Array) -> np.ndarray:
    """A row of unit length per text: square roots of the counts of hashed n-grams of the whole text."""
    data, offsets = utf8(pc.utf8_lower(texts))
    data = np.where(_LETTER[data], data, 32).astype(np.uint64)
    data[(data >= 48) & (data <= 57)] = 32
    counts = np.zeros((len(texts), DIMENSIONS), np.float32)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        for start in range(a, b, 1 << 20):  # long texts in parts that overlap by an n-gram
            own = data[start : min(b, start + (1 << 20) + GRAMS[-1] - 1)]
            key = np.zeros(len(own), np.uint64)
            for n in range(1, GRAMS[-1] + 1):
                size = min(len(own) - n + 1, 1 << 20)
                if size <= 0:
                    break
                key = key[:size] * np.uint64(257) + own[n - 1 : n - 1 + size]
                if n in GRAMS:
                    hashed = (key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(52)
                    counts[k] += np.bincount(hashed.astype(np.int64), minlength=DIMENSIONS)
    rows = np.sqrt(counts)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def fit_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge, classes weighed alike); ``y`` is 1 or -1.

    Accelerated gradient descent from zero, so the result is the same every time.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = np.zeros(x.shape[1])
    ahead, pace, rate = w.copy(), 1.0, 1 / (4.0 + penalty)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (penalty * ahead - 2 * (x.T @ (share * y * slack)))
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = step + (pace - 1) / following * (step - w)
        w, pace = step, following
    return w


class LanguageModel:
    """Families, their machines, and the machines for pairs of languages."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        families = np.array([family_of(v) for v in langs.tolist()], dtype=object)
        self.families = sorted(set(families.tolist()))
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.family_w = np.array([fit_machine(x, np.where(families == f, 1, -1)) for f in self.families]) if len(self.families) > 1 else None
        self.pair_w = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                rows = (langs == a) | (langs == b)
                self.pair_w[a, b] = fit_machine(x[rows], np.where(langs[rows] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each row, and how sure that is, from 0 to 1."""
        pred, score = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x))
        if not self.langs:
            return pred, score
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        if self.family_w is None:
            family, sure = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = x @ self.family_w.T
            family = margins.argmax(axis=1)
            odds = np.exp(3 * (margins - margins.max(axis=1, keepdims=True)))
            sure = odds.max(axis=1) / odds.sum(axis=1)
        for k, name in enumerate(self.families):
            rows, members = np.flatnonzero(family == k), self.members[name]
            votes = np.zeros((len(rows), len(members)))
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                p = 1 / (1 + np.exp(-3 * (x[rows] @ self.pair_w[a, b])))
                votes[:, i] += p
                votes[:, j] += 1 - p
            best = votes.argmax(axis=1) if len(members) > 1 else np.zeros(len(rows), int)
            pred[rows] = np.array(members, dtype=object)[best]
            score[rows] = sure[rows] * (votes.max(axis=1) / (len(members) - 1) if len(members) > 1 else 1.0)
        return pred, np.clip(score, 0, 1)


def fit(docs: DataFrame, sample_rows: int = 3000, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on at most ``sample_rows`` distinct labelled texts (or one per language), as many of each language as possible.

    Taken are the texts of each language whose hashes are lowest, so a text
    that many rows share counts once and every language with a text has one.
    Rows without a language or a text are left out. The sample is the only
    part of the corpus that reaches the driver, as vectors of a fixed length.
    """
    labelled = docs.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"), F.xxhash64(docs[text]).alias("h"))
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    distinct = labelled.select("lang", "h").distinct()  # combined within each task, so a hot text costs no more
    lowest = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nth") <= sample_rows)
    found = lowest.groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("hashes")).collect()
    each = max(1, sample_rows // max(1, len(found)))
    keys = [(row.lang, h) for row in found for h in row.hashes[:each]]
    if not keys:
        return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), np.array([], dtype=object))
    chosen = docs.sparkSession.createDataFrame(keys, "lang string, h long")
    taken = labelled.join(F.broadcast(chosen), ["lang", "h"])

    def run(batches):
        seen = set()  # a task describes each of the chosen texts once
        for batch in batches:
            fresh = []
            for key in zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist()):
                fresh.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for start, end, texts in text_slices(batch):
                found = [batch.column(c).slice(start, end - start) for c in ("lang", "h")]
                yield pa.RecordBatch.from_arrays([*found, pa.array([r.tobytes() for r in describe(texts)], pa.binary())], ["lang", "h", "x"])

    held = in_arrow(taken, run, "lang string, h long, x binary").groupBy("lang", "h").agg(F.min("x").alias("x")).collect()
    held.sort(key=lambda r: (r.lang, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in held]).reshape(-1, DIMENSIONS)
    return LanguageModel(x, np.array([r.lang for r in held], dtype=object))


def identify(docs: DataFrame, model: LanguageModel, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 if the text is NULL, has no letter, or the model has
    no language. Only the text is used. Repeated rows give repeated rows.
    """
    handed = docs.sparkSession.sparkContext.broadcast(model)  # machines: languages times a fixed length

    def run(batches):
        for batch in batches:
            for start, end, texts in text_slices(batch):
                pred, score = handed.value.predict(describe(texts))
                for i, value in enumerate(texts.to_pylist()):
                    if not any(map(str.isalpha, value)):
                        pred[i], score[i] = UNKNOWN, 0.0
                rows = [batch.column(c).slice(start, end - start) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    named = docs.select(docs[doc_id].cast("long").alias("doc_id"), held_out.alias("held_out"), docs[text].alias("text"))
    return in_arrow(named, run, "doc_id long, held_out boolean, lang_pred string, score double")
