"""Toxicity, language, packing, BPE and word pieces: edge cases, and brute-force versions."""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, models

from ledgerweave.llm import bpe, langid, packing, toxicity, wordpiece
from ledgerweave.workspace import Workspace

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def corpus(spark, n=400):
    """Every fourth text holds a foul word; words are drawn at random."""
    rng = np.random.default_rng(5)
    pool = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    rows = []
    for i in range(n):
        words = list(rng.choice(pool, 20)) + (["wretched"] if i % 4 == 0 else [])
        rows.append((i, " ".join(rng.permutation(words)), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_finds_held_out_texts(spark):
    texts = corpus(spark)
    labels = texts.where("doc_id < 300").select("doc_id", "toxic")
    training = toxicity.sample(texts.where("doc_id < 300").select("doc_id", "text"), labels)
    model = toxicity.fit(Workspace(spark, "t"), training, toxicity.prior_of(labels))
    scored = toxicity.score(texts, model).where("doc_id >= 300")
    assert scored.where("toxic <> predicted").count() == 0
    assert scored.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(Workspace(spark, "t"), toxicity.sample(docs, labels), toxicity.prior_of(labels))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score and rows[4].score == rows[5].score
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(Workspace(spark, "t"), toxicity.sample(none, labels.where("false")), 0.1)
    assert toxicity.score(docs, empty).where("predicted <> 0").count() == 0


def test_risk_turns_back_where_it_is_negative():
    x = np.ones((4, 1), np.float32)
    forward = toxicity.non_negative_step(np.array([0.5]), 0.0, x, x, 0.1)
    back = toxicity.non_negative_step(np.array([0.5]), 0.0, x, x, 2.0)
    assert forward[3] >= 0 > back[3]
    s = 1 / (1 + np.exp(-0.5))
    assert np.isclose(forward[0][0], s * (1 - s) * (1 - 2 * 0.1)) and np.isclose(back[0][0], s * (1 - s))


def test_language_equals_plain_bundling(spark, docs, none):
    texts = docs.selectExpr("text", "if(doc_id = 6, 'de', 'en') as lang")
    profiles = langid.fit(Workspace(spark, "l"), texts)
    rows = {r.doc_id: r for r in langid.predict(docs, profiles).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0
    assert rows[6].lang_pred == "de" and rows[4].lang_pred == "en" and rows[4].score == rows[5].score
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.predict(none, profiles).count() == 0
    nothing = langid.fit(Workspace(spark, "l"), langid.sample(none))
    assert langid.predict(docs, nothing).where("lang_pred <> 'und'").count() == 0
    encoder, letters = langid.Encoder(), langid.Encoder().letters
    text = " so la "
    plain = sum(
        np.roll(letters[ord(a)], 2).astype(float) * np.roll(letters[ord(b)], 1) * letters[ord(c)]
        for a, b, c in zip(text, text[1:], text[2:])
    )
    assert np.allclose(encoder.encode(["So 1 la!"])[0], plain / np.linalg.norm(plain), atol=1e-6)


def test_packing_keeps_every_piece_under_every_capacity(spark, docs, none):
    packed = packing.pack(Workspace(spark, "p"), docs, BYTES, tokens=64, documents=3, attention=3_000.0).toPandas()
    by = packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by["length"].sum() <= 64).all() and (by.size() <= 3).all()
    costs = by["length"].apply(lambda n: (n**2).sum())
    assert ((costs <= 3_000) | (by.size() == 1)).all()
    for _, rows in by:
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum()[:-1]]
    tokenizer = Tokenizer.from_file(BYTES)
    for row in docs.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [0]
        own = packed[packed.doc_id == row.doc_id].sort_values("piece")
        assert own["length"].sum() == len(ids) and (own["length"][1:] == 64).all()
        for _, piece in own.iterrows():
            part = np.array(ids[piece.start : piece.start + piece.length], "<u4").tobytes()
            assert zlib.crc32(part) == piece.ids_crc32
    assert packing.pack(Workspace(spark, "p"), none, BYTES).count() == 0


def test_words_are_encoded_many_at_a_time_as_the_library_does():
    """Each word once, and many as one text; the ids are those of the whole texts."""
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abeéñßstrln"), rng.integers(1, 9))) for _ in range(600)]
    joints = [" ", "\n", "  ", " \n", "\n\n ", "'s ", "'' ", ", ", " 12 ", "_", "\t ", "’ ", " \u4f60\u597d ", " $3.50% "]
    texts = ["", " ", "\n", " \n \n", "a ", "<|endoftext|> a", "x <|endoftext|>"]
    texts += ["".join(rng.choice(pool) + (" " if rng.random() < 0.8 else rng.choice(joints)) for _ in range(40)) for _ in range(300)]
    encoder = packing.ByteBpe(BYTES)
    whole, given = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, rows, **options):
            given.extend(rows)
            return whole.encode_batch_fast(rows, **options)

    encoder.tokenizer = Counting()
    expected = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(encoder.encode(texts)) == expected
    simple = [" ".join(rng.permutation(pool)) for _ in range(50)]
    again = packing.ByteBpe(BYTES)
    again.tokenizer = Counting()
    given.clear()
    assert list(again.encode(simple)) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in simple]
    assert len(given) < len(set(pool)) / 10


def test_best_fit_by_hand_and_against_the_bound():
    sequence, offset = packing.best_fit(np.array([60, 40, 50, 50]), tokens=100)
    assert sorted(zip(sequence.tolist(), offset.tolist())) == [(0, 0), (0, 60), (1, 0), (1, 50)]
    lengths = np.random.default_rng(1).integers(1, 2_048, 3_000)
    for rule in ("norm", "dot"):
        sequence, _ = packing.best_fit(lengths, rule=rule)
        assert np.bincount(sequence, lengths).max() <= 2_048
        assert sequence.max() + 1 <= 1.02 * lengths.sum() / 2_048 + 1


def test_bpe_equals_the_library(spark, docs, none):
    rng = np.random.default_rng(3)
    more = ["".join(rng.choice(list("aehnit 'sé1!"), 80)) for _ in range(200)]
    frame = docs.select("doc_id", "text", "score").union(
        spark.createDataFrame([(100 + i, t, 0.0) for i, t in enumerate(more)], "doc_id long, text string, score double")
    )
    tokenizer = Tokenizer.from_file(WORDS)
    for row in bpe.digests(frame, WORDS).collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.digests(none, WORDS).count() == 0
    coded = frame.select("text", bpe.encode_udf(WORDS)("text").alias("ids"))
    for row in coded.withColumn("back", bpe.decode_udf(WORDS)("ids")).collect():
        assert row.ids == tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert row.back == tokenizer.decode(row.ids, skip_special_tokens=False)


def test_word_pieces_equal_greedy_longest_match(spark, docs, none):
    vocabulary = ["a", "abcd", "ab", "##b", "##bc", "##z", "##", "#", "x", "##cd", "##d", "##c"]
    automaton = wordpiece.marked(vocabulary)
    model = models.WordPiece({t: i for i, t in enumerate([*vocabulary, "[UNK]"])}, unk_token="[UNK]")
    rng = np.random.default_rng(2)
    for _ in range(2_000):
        word = "".join(rng.choice(list("abcdxz"), rng.integers(1, 9)))
        found = [t.value for t in model.tokenize(word)]
        assert automaton.count(word.encode()) == (None if found == ["[UNK]"] else len(found)), word
    symbols = wordpiece.byte_symbols()
    pieces = [bytes(symbols[c] for c in t) for t in json.load(open(BYTES))["model"]["vocab"]]
    first, later = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}

    def greedy(word: bytes) -> int:
        n, at, known = 0, 0, first
        while at < len(word):
            end = next(e for e in range(len(word), at, -1) if word[at:e] in known)
            n, at, known = n + 1, end, later
        return n

    for row in wordpiece.count_pieces(docs, BYTES).collect():
        words = (row.text or "").encode().split()
        each = {w: greedy(b" " + w) for w in set(words)}
        assert (row.n_words, row.n_pieces, row.n_unknown) == (len(words), sum(each[w] for w in words), 0)
    assert wordpiece.count_pieces(none, BYTES).count() == 0
