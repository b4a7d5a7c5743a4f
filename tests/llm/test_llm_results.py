"""The queries of the language-model operators against plain Python and the libraries themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from oracle import both, connect
from tokenizers import Tokenizer

from tableflow.llm.oracles import ORACLES
from tableflow.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    (ours_cols, ours), (sql_cols, theirs) = both(spark, connect(small), QUERIES[name], ORACLES[name], small)
    assert ours_cols == sql_cols
    assert ours == theirs


def test_language_sample_is_bounded_and_holds_every_language(spark, monkeypatch):
    """Copies count once, a language with one much repeated text is learned, and the bound is kept."""
    from tableflow.llm import language

    held = []

    class Seen(language.LanguageModel):
        def __init__(self, x, langs):
            held.append((len(x), sorted(langs.tolist())))
            super().__init__(x, langs)

    monkeypatch.setattr(language, "LanguageModel", Seen)
    rows = [("en", f"some words of number {i} and more") for i in range(300)]
    rows += [("xx", "zo qua vel mip tor")] * 200 + [("en", "the hot text that many rows share")] * 400 + [("fr", f"des mots {i}") for i in range(5)]
    rows += [(None, "no language"), ("yy", None)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    first = language.fit(docs, sample_rows=30)
    assert first.langs == ["en", "fr", "xx"]
    language.fit(docs.repartition(5), sample_rows=30)
    language.fit(docs, sample_rows=1)
    assert held == [(16, ["en"] * 10 + ["fr"] * 5 + ["xx"])] * 2 + [(3, ["en", "fr", "xx"])]


def test_language_is_right_on_held_out_rows(spark, small, docs):
    rows = QUERIES["op1_language"](spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        other = [sum(divmod(2 * int(x), 10)) for x in digits[-2::-2]]
        return 16 <= len(digits) <= 19 and (sum(map(int, digits[::-2])) + sum(other)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]


def test_base_spans_are_those_of_the_patterns(spark, small, docs):
    for r in QUERIES["op2_personal_data"](spark, small).collect():
        spans = plain_spans(docs[r.doc_id].text or "")
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == sha(",".join(joined))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PATTERNS]
        assert set(joined) <= set(r.spans.split(","))


def test_base_spans_of_awkward_texts():
    from tableflow.llm.pii import base_spans

    for text in (
        "a@b a@b.c+x@d.e @ x@y.z. a@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "+1 (017) 555-7713+44 20 7946 0958", "é x.y+z@m-1.de é",
        "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111", "+1+12345678+ 9", "a" * 5000, "1" * 5000, "." * 300 + "@" * 300, "",
    ):
        assert base_spans(text) == plain_spans(text)


def test_token_files_hold_the_ids_of_the_library(spark, small, docs):
    tokenizer, place = library("word_bpe_49k.json"), 0
    rows = {r.doc_id: r for r in QUERIES["op4_token_files"](spark, small).collect()}
    for key in sorted(docs):
        ids = np.array(tokenizer.encode(docs[key].text or "", add_special_tokens=False).ids + [2], "<u4")
        r = rows[key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (place, len(ids), zlib.crc32(ids.tobytes()))
        place += len(ids)


def test_readers_unpack_only_the_documents_asked_for(spark, small, tmp_path):
    from tableflow.llm import binary

    path = f"{tmp_path}/files"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    manifest = binary.write_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    whole = {r.doc_id: r for r in binary.read_files(manifest).collect()}
    some = binary.read_files(manifest, [3, 77, 199, 10**9]).collect()
    assert {r.doc_id: r for r in some} == {k: whole[k] for k in (3, 77, 199)}


def test_a_damaged_frame_is_found(tmp_path):
    import pyarrow.fs as pafs

    from tableflow.llm.binary import FRAME_IDS, FrameReader, FrameWriter

    path = f"{tmp_path}/x.zst"
    with open(path, "wb") as out:
        writer = FrameWriter(out)
        writer.add(7, np.arange(FRAME_IDS + 5, dtype=np.uint32))
        writer.add(7, np.arange(3, dtype=np.uint32))
        writer.close()
    held = [(k, sum(map(len, frames))) for k, frames in FrameReader(pafs.LocalFileSystem().open_input_file(path)).documents()]
    assert held == [(7, FRAME_IDS + 5), (7, 3)]
    raw = bytearray(open(path, "rb").read())
    raw[100] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        [list(f) for _, f in FrameReader(pafs.LocalFileSystem().open_input_file(path)).documents()]


TOXIC_ROWS = [
    ("you bad bad dog", 1), ("bad dog you", 1), ("bad cat runs", 1), ("bad", 1), ("a good dog runs", 0), ("good cat", 0), ("the cat runs", 0),
    ("the dog", 0), ("a cat", 0), ("good good good", 0), ("runs the cat", 0), ("bad luck", 0), ("bad dog now", 1), ("the dog runs", 0),
]


def plain_ratios(rows):
    """(n, ratio) of words and pairs by the formulas of the module, in plain Python."""
    import math

    from tableflow.llm import toxicity

    found = {}
    for text, toxic in rows:
        words = text.split()
        for x in {*words, *zip(words, words[1:])}:
            t, o = found.get(x, (0, 0))
            found[x] = (t + toxic, o + 1 - toxic)
    out = {}
    for pair in (False, True):
        mine = {x: c for x, c in found.items() if isinstance(x, tuple) == pair}
        whole = [sum(c[i] for c in mine.values()) for i in (0, 1)]
        q = whole[0] / sum(whole)
        d, free = [], []
        for i in (0, 1):
            one, two = (sum(c[i] == k for c in mine.values()) for k in (1, 2))
            d.append(one / (one + 2 * two) if one else 0.5)
            freed = sum(min(c[i], 1.0 if pair and c[i] == 1 else d[i]) for c in mine.values())
            free.append(freed / whole[i])
        several = {x: c for x, c in mine.items() if not pair or sum(c) > 1}
        s = toxicity.SPREAD

        def evidence(t, o):
            whole_ = math.lgamma(s) - math.lgamma(q * s) - math.lgamma((1 - q) * s)
            return math.lgamma(t + q * s) + math.lgamma(o + (1 - q) * s) - math.lgamma(t + o + s) + whole_ - t * math.log(q) - o * math.log(1 - q)

        share = 0.01
        for _ in range(200):
            chances = [1 / (1 + (1 - share) / share * math.exp(-evidence(*c))) for c in several.values()]
            share = min(max(sum(chances) / len(chances), 1e-9), 0.5)
        for x, c in several.items():
            chance = 1 / (1 + (1 - share) / share * math.exp(-evidence(*c)))
            p = []
            for i in (0, 1):
                own = 0 if pair and c[i] == 1 else max(c[i] - d[i], 0)
                p.append(own / whole[i] / (sum(c) / sum(whole)) + free[i])
            out[x] = (sum(c), math.log((1 - chance + chance * p[0]) / (1 - chance + chance * p[1])))
    return out


def test_toxicity_probabilities_equal_brute_force(spark):
    from tableflow.llm import toxicity
    from tableflow.llm.common import mix, word_hashes

    df = spark.createDataFrame(TOXIC_ROWS, "text string, toxic long").repartition(3)
    got = {r.key: (r.n, r.ratio) for r in toxicity.ratios(toxicity.count_expressions(df)).collect()}
    expected = plain_ratios(TOXIC_ROWS)

    def key(x):
        words = word_hashes(pa.array([" ".join(x) if isinstance(x, tuple) else x], pa.large_string()))[0]
        if len(words) == 1:
            return (mix(words) & ~np.uint64(1)).view(np.int64)[0].item()
        return (mix(words[:1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) | np.uint64(1)).view(np.int64)[0].item()

    assert len(got) == len(expected)
    for x, (n, ratio) in expected.items():
        assert got[key(x)][0] == n and got[key(x)][1] == pytest.approx(ratio, abs=1e-7), x


def two_word_docs(n=1500):
    """Ordinary words in all texts; ``red stone`` in a row only in toxic ones, both words apart in all."""
    import random

    draw = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [f"w{draw.randrange(300)}" for _ in range(40)]
        words[3], words[17], words[30] = "red", "stone", "stone" if draw.random() < 0.5 else "red"
        if toxic:
            words[22:24] = ["red", "stone"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_an_expression_of_ordinary_words_is_told_apart(spark, monkeypatch, held):
    from tableflow.llm import toxicity

    monkeypatch.setattr(toxicity, "HELD", held)
    rows, labels = two_word_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scored = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), *toxicity.default_folds())
    got = {r.doc_id: r for r in scored.collect()}
    held_out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i].predicted == dict(labels)[i] for i in held_out)
    assert right > 0.97 * len(held_out)


def test_what_is_held_and_what_is_joined_add_up_alike(spark, monkeypatch, small):
    from tableflow.llm import toxicity

    whole = {r.doc_id: r.score for r in QUERIES["op6_toxicity"](spark, small).collect()}
    monkeypatch.setattr(toxicity, "HELD", 100)
    parts = {r.doc_id: r.score for r in QUERIES["op6_toxicity"](spark, small).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-9 for k in whole)


def test_toxic_words_are_learned(spark, medium):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, medium).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    bad = [r.score for r in rows if labels.get(r.doc_id) == 1 and r.held_out]
    good = [r.score for r in rows if labels.get(r.doc_id) == 0 and r.held_out]
    assert np.mean([a > b for a in bad for b in good]) + 0.5 * np.mean([a == b for a in bad for b in good]) > 0.8


def test_pieces_are_those_of_the_library(spark, small, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in QUERIES["op7_pieces"](spark, small).collect():
        ids = model.encode(docs[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


AWKWARD = [
    "", " ", "\n", "a", "  a  b \n\nc\t d ", "foo.\nBar, x.y", "it's I'll don'ts", "x\u00a0 y\u2003 z", "\u3000 a", "éé é. é,é", " \n a\n", "a  \n  b",
    "1,000.5 3.x", "\x1c a", "ΑΣ ΑΣΣ.", "e\u0301 \u0301x", "a <|endoftext|> b", "İstanbul \u212a.", "a\r\nb\x0bc", "x.'s 'S", "▁ a▁ ▁", "a\x00b", "日本 語。",
    "\ufeffx \ufeff", "a" * 3000, " " * 50 + "x", "<s> <unk> <0x0A>",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    from tableflow.llm.chunks import word_table

    ids, ends = word_table(public_tokenizers.path(name))(pa.array(AWKWARD, pa.large_string()))
    expected = [x.ids for x in library(name).encode_batch(AWKWARD, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == expected


def test_simple_words_go_to_the_model_at_once_with_the_ids_of_whole_texts():
    from tableflow.llm.chunks import ChunkTable, ODD_SPACE, WordEncoder, cuts_at_words

    rng = random.Random(5)
    kinds = ["abcXYZ", "äßÀÖØöøÿéĀπ", "!/:@[`{~'$%&#*\\^_|", "×÷½²ªº", " \n\t", "019"]
    texts = ["".join(rng.choice(rng.choice(kinds[: rng.randint(1, 6)])) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" Straße%%%", " don't", " it''s", " über|<|endoftext|>", " a'", " a's", "ab"]
    encoder = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, ends = ChunkTable(cuts_at_words, encoder, encoder.whole, ODD_SPACE)(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    expected = [x.ids for x in encoder.library.encode_batch([" Straße%%%", " a", " Ton!?"], add_special_tokens=False)]
    encoder.library = None  # neither splits nor rewrites these
    ids, lengths = encoder([" Straße%%%", " a", " Ton!?"])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == expected


def test_chunks_give_the_pieces_of_whole_texts():
    from tableflow.llm.pieces import codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, ends = codec(path).encode(pa.array(AWKWARD, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [model.encode(t) for t in AWKWARD]
    assert codec(path).decode(ids, ends) == [model.decode(model.encode(t)) for t in AWKWARD]


def test_packing_places_every_id_once_and_keeps_the_mixture(spark, small, docs):
    tokenizer, by_doc, by_sequence = library("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in QUERIES["op8_packing"](spark, small).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for key, doc in docs.items():
        ids, place = np.array(tokenizer.encode(doc.text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert r.start == place and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[place : place + r.length].tobytes())
            place += r.length
        assert place == len(ids)
    shares, total = Counter(), 0
    for rows in by_sequence.values():
        for r in rows:
            shares[r.queue] += r.length
            total += r.length
    for key, rows in by_sequence.items():
        place = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        last = key == max(by_sequence)
        assert place == (2048 if not last else (total - 1) % 2048 + 1)
        own = Counter()
        for r in rows:
            own[r.queue] += r.length
        if not last:
            assert all(abs(own[q] - 2048 * n / total) <= 200 for q, n in shares.items())
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_fingerprints_follow_their_texts(spark, small, docs):
    from tableflow.llm import digest

    rows = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, small).collect()}
    order = sorted(docs, reverse=True)
    for key, other in zip(order, order[1:] + order[:1]):
        text, r = docs[key].text or "", rows[key]
        third = len(text) // 3
        edited = text[: len(text) - third] + (docs[other].text or "")[:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        own, after = digest.from_text(r.fingerprint), digest.from_text(rows[other].fingerprint)
        assert r.near_next == pytest.approx(digest.likeness(own, after))
        assert r.near_edited == pytest.approx(digest.likeness(own, digest.from_text(r.edited_fingerprint)))
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.9 * len(rows)


def test_entropy_levels_and_features_by_brute_force():
    from tableflow.llm import digest

    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 103, n, dtype=np.uint8)) for n in (0, 10, 63, 64, 65, 200, 900)]
    texts.append(texts[-1])
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        if len(data) >= digest.WINDOW:
            for i, level in enumerate(digest.entropy_levels(data)):
                counts = np.array(list(Counter(text[i : i + 64]).values()))
                entropy = 6 - (counts * np.log2(counts)).sum() / 64
                assert abs(level - entropy / 6 * (digest.LEVELS - 1)) <= 1.01
    rank = np.arange(digest.LEVELS)[::-1].copy()
    array = pa.array([t.decode() for t in texts], pa.large_string())
    whole = digest.fingerprints(array, rank)
    alone = [digest.fingerprints(array.slice(i, 1), rank)[0] for i in range(len(texts))]
    assert all(np.array_equal(a, b) for a, b in zip(whole, alone))
    assert np.array_equal(whole[-1], whole[-2]) and digest.likeness(whole[-1], whole[-2]) == 1.0
    assert digest.likeness(whole[0], whole[0]) == 1.0 and digest.likeness(whole[0], whole[1]) == 0.0


def labelled_kmers(text, k=5):
    words, seen, out = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()), Counter(), set()
    for i in range(max(1, len(words) - k + 1)):
        own = tuple(words[i : i + k])
        out.add((own, seen[own]))
        seen[own] += 1
    return out if words else set()


def test_near_duplicates_are_the_components_of_all_similar_pairs(spark, medium):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    kmers = {d: labelled_kmers(t or "") for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, common = defaultdict(list), Counter()
    for d, own in kmers.items():
        for k in own:
            holders[k].append(d)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[min(a, b), max(a, b)] += 1
    for (a, b), n in common.items():
        if n / (len(kmers[a]) + len(kmers[b]) - n) >= 0.8:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    rows = QUERIES["op10_order_minhash"](spark, medium).collect()
    assert {r.doc_id: r.class_id for r in rows} == {d: top(d) for d in texts}
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_pipeline_stages_against_plain_python(spark, small, docs):
    import corpus_pipeline as pipeline
    from tableflow.llm.common import cut

    before = {k: r.text for k, r in docs.items()}
    kept = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in pipeline.STAGES:
        kept = cut(stage(spark, kept, small), "stage")
        if name == "packing":
            break
        assert kept.columns == pipeline.COLUMNS
        after = {r.doc_id: r.text for r in kept.collect()}
        bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        if name == "exact dedup":
            best = {}
            for k, t in before.items():
                best[bare(t)] = min(best.get(bare(t), (1, 0)), (-len(t or ""), k))
            assert set(after) == {k for _, k in best.values()}
        elif name == "near dedup":
            left = list(after)
            same = [labelled_kmers(after[k] or "") for k in left]
            assert not any(
                len(a & b) / max(len(a | b), 1) >= 0.8 for i, a in enumerate(same) for b in same[:i] if a and b
            )
        elif name == "personal data":
            assert set(after) == set(before)
            assert not any(plain_spans(t or "") for t in after.values())
            assert all(after[k] == t for k, t in before.items() if not re.search(r"[0-9@]", t or ""))
        else:
            assert set(after) <= set(before) and len(after) > 0.8 * len(before)
        before = after
    tokens = sum(r.length for r in kept.collect())
    tokenizer = library("byte_bpe_50k.json")
    assert tokens == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in before.values())
