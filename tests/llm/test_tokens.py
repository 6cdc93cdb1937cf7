"""Token counts, piece codec and language ID against the libraries and plain versions."""

import itertools
import math
import os
import random
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskline.llm import langid, sentencepiece, token_counts
from riskline.llm.pieces import MARK, Lattice, Vocabulary, vocabulary

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", " a  b\n\n c\t ", "it's  what'll\u00a0x \u3000y", "x<|endoftext|>y <|endoftext|> z", "é" * 50, "日本語。テキスト、です" * 40,
       "a" * 5000, "word," * 3000, "\x1c a\x1d\x1e. b\x1f", "😀 👩‍👩‍👧 ok", "tab\tand\r\nline ", "▁ own ▁▁ marks", "1,234.5 6½ ²", "don't 's 'S", "\x00\x01 z",
       "end  ", "\u2028 x\u2029\u0085y", "ß" + " " * 40 + "Q"]


def test_counts_equal_library(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(BPE)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("ab 's.,\n\t\u00a0é1<|>\x1c", k=rng.randrange(200))) for _ in range(300)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n_tokens="x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(docs, BPE, limit=100).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100), t[:80]


def test_counts_with_other_tokenizer():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = token_counts.Counter(path).count(ODD)
    assert got.tolist() == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in ODD]


def test_pieces_add_up():
    c = token_counts.Counter(BPE)
    assert all("".join(c.pieces(t)) == t for t in ODD if t)
    assert max(map(len, c.pieces("word," * 3000))) < 100
    assert c.count([]).tolist() == []


def test_round_trip(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, piece_ids="x") for i, t in enumerate(ODD)], "doc_id long, text string, piece_ids string")
    out = sentencepiece.decode_documents(sentencepiece.encode_documents(docs, MODEL), MODEL).collect()
    assert [r.decoded for r in sorted(out, key=lambda r: r.doc_id)] == ODD
    assert out[0].piece_ids is None and sorted(out, key=lambda r: r.doc_id)[1].piece_ids == []
    assert sentencepiece.encode_documents(docs.limit(0), MODEL).count() == 0


def _plain_viterbi(v: Vocabulary, word: str):
    pieces = {v.texts[i]: s for i, s in zip(v.ids, v.scores)}
    best = [(0.0, [])] + [None] * len(word)
    low = min(v.scores) - sentencepiece.UNKNOWN_PENALTY
    for e in range(1, len(word) + 1):
        ways = [(best[b][0] + pieces[word[b:e]], best[b][1] + [word[b:e]]) for b in range(max(0, e - v.longest), e) if word[b:e] in pieces]
        if word[e - 1] not in pieces:
            ways.append((best[e - 1][0] + low, best[e - 1][1] + [word[e - 1]]))
        best[e] = max(ways, key=lambda w: w[0])
    return best[-1]


def test_viterbi_equals_plain():
    v = vocabulary(MODEL)
    rng = random.Random(3)
    words = [MARK + "".join(rng.choices("etaoinsh.é☃", k=rng.randrange(1, 20))) for _ in range(200)]
    score = dict(zip([v.texts[i] for i in v.ids], v.scores))
    low = min(v.scores) - sentencepiece.UNKNOWN_PENALTY
    for word in words:
        for exact in (False, True):
            begin, row = sentencepiece.viterbi(v, [word], exact)
            ends = np.flatnonzero(begin[0] >= 0)
            way = [word[begin[0, e]:e + 1] for e in ends]
            assert "".join(way) == word
            assert math.isclose(sum(score.get(p, low) for p in way), _plain_viterbi(v, word)[0])


def _model_file(path, pieces):
    """A unigram model in SentencePiece's format: unknown, the given pieces, bytes."""
    def field(n, kind, payload):
        head = bytes([n << 3 | kind])
        return head + (bytes(_varint(len(payload))) + payload if kind == 2 else payload)

    def _varint(x):
        out = []
        while True:
            out.append(x & 127 | (128 if x > 127 else 0))
            x >>= 7
            if not x:
                return out

    def piece(text, score, kind):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    body = piece("<unk>", 0, 2) + b"".join(piece(t, s, 1) for t, s in pieces)
    body += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    body += field(2, 2, field(3, 0, bytes([1])) + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7, 1]))  # unigram, byte fallback
    body += field(3, 2, field(1, 2, b"identity") + field(3, 0, bytes([1])) + field(4, 0, bytes([0])) + field(5, 0, bytes([1])))
    path.write_bytes(body)


def test_encoding_equals_library_for_a_unigram_model(tmp_path):
    import sentencepiece as library
    rng = random.Random(1)
    texts = {MARK, *"abcd"} | {"".join(rng.choices(MARK + "abcd", k=1)) + "".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(60)}
    _model_file(tmp_path / "u.model", [(t, -rng.uniform(1, 9)) for t in sorted(texts)])
    model = library.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    cases = ["".join(rng.choices("abcd  e\n", k=rng.randrange(60))) for _ in range(300)]
    codec = sentencepiece.Codec(str(tmp_path / "u.model"))
    got = codec.encode_array(pa.array(cases)).to_pylist()
    for text, ids in zip(cases, got):
        assert ids == (model.encode(text) if text else []), text
    assert codec.decode_array(pa.array(got, pa.list_(pa.int32()))).to_pylist() == cases


def test_decoding_odd_ids():
    c = sentencepiece.codec(MODEL)
    rows = pa.array([None, [], [10**6, -1, 0, 1], [3 + 0xFF]], pa.list_(pa.int32()))
    assert c.decode_array(rows).to_pylist() == [None, "", "", "\ufffd"]


def test_forward_sums_all_segmentations():
    v = vocabulary(MODEL)
    p = np.vstack([langid.prior(v)[:, None], np.zeros((1, 1))])
    score = dict(zip([v.texts[i] for i in v.ids], langid.prior(v)))
    for word in (MARK + "the", MARK + "straße", MARK + "☃ab"):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, begin = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[begin:k])
                    begin = k
            parts.append(word[begin:])
            total += math.prod(score.get(x, langid.UNKNOWN if len(x) == 1 else 0.0) for x in parts)
        assert math.isclose(langid.forward(Lattice(v, [word]), p)[-1, 0, 0], total, rel_tol=1e-9)


def test_expected_uses_add_up():
    v = vocabulary(MODEL)
    p = np.vstack([langid.prior(v)[:, None], np.zeros((1, 1))])
    uses = np.zeros((1, len(v.ids)))
    langid.expected_uses(Lattice(v, [MARK + "word", MARK + "term"]), p, np.array([[2.0], [1.0]]), uses)
    assert math.isclose((uses[0] * v.lengths).sum(), 15.0)  # every letter and mark is covered once


def test_letters_are_those_of_unicode():
    import regex
    plane = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x11000)]))
    letters = {c for w in langid.words_of(plane) for c in w if c != MARK}
    assert letters == set(regex.sub(r"\P{L}", "", "".join(c for c in plane.lower() if c.isalpha())))
    assert langid.words_of("² ½ Ⅷ 12 _ x²y") == [MARK + "x", MARK + "y"] and langid.words_of("½Ⅷ") == []


def test_language_id(spark):
    rows = [Row(doc_id=i, text=t, lang=g, lang_pred="mine", score="x") for i, (t, g) in enumerate(
        [("the house and the garden of that street", "en"), ("das haus und der garten in der straße", "de")] * 20
        + [(None, "en"), ("", None), ("12 34 !!", None), ("the garden and the house", None), ("der garten und das haus", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string")
    got = langid.predict(docs, langid.fit(docs, MODEL)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "de"] * 20 + ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got) and got[40].score == 0
    assert got[0].lang == "en"
    none = langid.fit(docs.where("lang is null"), MODEL)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0


def test_long_words_stay_finite():
    v = vocabulary(MODEL)
    model = langid.LanguageModel(MODEL, ["a", "b"], np.repeat(langid.prior(v)[:, None], 2, axis=1))
    names, scores = model.scorer().predict(["x" * 100_000, "ж" * 5000])
    assert names == ["a", "a"] and np.allclose(scores, 0.5)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test data")
def test_held_out_accuracy(spark):
    from riskline.llm.queries import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND lang is not null")
    good, total = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert good / total > 0.98
