"""BPE, fill-in-the-middle and spelling variants against the library and plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from riskline.llm import bpe, piece_table, spelling

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "a", " a  b\n\n c\t ", "it's  what'll x 　y", "x<|endoftext|>y <|endoftext|> z<|startoftext|>",
       "日本語。テキスト、です" * 40, "a" * 5000, "word," * 3000, "\x1c a\x1d\x1e. b\x1f", "😀 👩‍👩‍👧 ok", "ΑΣ ΣΑΣ İß ǅ K Å ﬁ é",
       "1,234.5 6½ ² Ⅷ ١٢", "\ufa6c a\ufacf", "\x00\x01 z", "͸ \U0001e6c0x", "<P>x", "a <S> b", "q<M>", "<<P", "tail  ", "=-" * 700, "Straßenbahn straßenbahm"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORD_BPE)


def odd_docs(spark, *extra):
    return spark.createDataFrame([Row(doc_id=i, text=t, **dict.fromkeys(extra, "x")) for i, t in enumerate(ODD)] + [
        Row(doc_id=4, text="a", **dict.fromkeys(extra, "x"))], "doc_id long, text string" + "".join(f", {c} string" for c in extra))


def test_bpe_equals_library(spark, library):
    docs = odd_docs(spark, "token_ids", "decoded", "n")
    out = bpe.decode_documents(bpe.encode_documents(docs, WORD_BPE), WORD_BPE).withColumn("sha", bpe.ids_sha256(F.col("token_ids")))
    rows = out.collect()
    assert len(rows) == len(ODD) + 1 and set(out.columns) == {"doc_id", "text", "token_ids", "decoded", "n", "sha"}
    for r in rows:
        if r.text is None:
            assert r.token_ids is None and r.decoded is None and r.sha == hashlib.sha256(b"").hexdigest()
            continue
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.token_ids == ids, r.text[:40]
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.sha == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), WORD_BPE).count() == 0


def test_bpe_random_texts(library):
    rng = random.Random(3)
    kinds = [(32, 127), (97, 123), (160, 0x250), (0x370, 0x530), (0x5d0, 0x700), (0x3040, 0x3100), (0x4e00, 0x4e80), (0x1f600, 0x1f640)]
    texts = ["".join(chr(rng.randrange(*rng.choice(kinds[:rng.randrange(1, 9)]))) for _ in range(rng.randrange(300))) for _ in range(400)]
    codec = bpe.Codec(WORD_BPE)
    got = [np.frombuffer(r, np.int32).tolist() for r in codec.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < codec.merged < len(codec.known)  # both ways are taken
    assert codec.decode([5, None, -1, 10**7]) == codec.decode([5])


def test_compatible_pairs_are_what_merging_keeps():
    model = bpe.Model(WORD_BPE)
    rng = np.random.default_rng(5)
    inner = np.array([i for i, k in zip(model.key_ids, model.key_chars) if 256 not in k])
    final = np.array([i for i, k in zip(model.key_ids, model.key_chars) if 256 in k])
    a, b = rng.choice(inner, 4000), rng.choice(final, 4000)
    spelled = {int(i): bytes(int(c) for c in row[:n] if c < 256) for i, row, n in zip(model.key_ids, model.key_chars, model.key_lengths)}
    whole = [model.merge(spelled[int(x)] + spelled[int(y)]) == [x, y] for x, y in zip(a, b)]
    assert model.compatible(a, b).tolist() == whole and 100 < sum(whole) < 3990


def test_bpe_merging_together_and_alone():
    model = bpe.Model(WORD_BPE)
    rng = random.Random(8)
    for n in (1, 2, 3, 9, 65, 300):
        words = [bytes(rng.choices(b"aabcdefghinorstu\xc3\xa9", k=n)) for _ in range(50)]
        ids, count = model.merge_all(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [model.merge(w) for w in words]
    long = bytes(rng.choices(b"abcdefghinorstu", k=100_000))
    assert sum(len(model.texts[i].replace(b"</w>", b"")) for i in model.merge(long)) == len(long)


def test_bpe_words_of_the_basic_plane():
    model = bpe.Model(WORD_BPE)
    assert model.plane_words is not model.words
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    assert model.plane_words.findall(plane) == model.words.findall(plane)
    assert bpe.plain_plane(r"\p{L}+|\s") is None and bpe.plain_plane(r"[\p{Lu}]+") is None


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        bpe.Model(public_tokenizers.path("byte_bpe_50k.json"))


def plain_fim(id_, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("ab é\n\t<>PSM日\x0b ", k=rng.randrange(60))) for _ in range(400)]
    rows = [(None if i % 50 == 49 else i, t, "x", "y", "z") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, _fim string, other string")
    out = piece_table.restore(piece_table.fill_in_middle(docs)).collect()
    assert len(out) == len(rows) and {"_fim", "other"} <= set(out[0].asDict())
    digests = {(r.doc_id, r.text): r for r in piece_table.fill_in_middle(docs, digests=True).collect()}
    forms = Counter()
    for r in out:
        want = plain_fim(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.restored == (r.text or "")
        d = digests[r.doc_id, r.text]
        assert d.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert d.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        forms[r.form] += 1
    assert min(forms[f] for f in ("plain", "spm", "psm")) > 10
    assert piece_table.fill_in_middle(docs.limit(0)).count() == 0


def test_piece_table_operations():
    table = piece_table.PieceTable.of(memoryview(b"abcdef"), b"")
    cut = table.cut(0, 2, 2, 6)
    assert [bytes(v) for v in cut] == [b"", b"ab", b"", b"cdef", b""] and cut.text() == b"abcdef"
    assert cut.permute((3, 1)).text() == b"cdefab" and cut.sha256() == hashlib.sha256(b"abcdef").hexdigest()
    with pytest.raises(ValueError):
        piece_table.Arranger(sentinels=("<P>", "<P>x", "<M>"))


def plain_words(docs):
    counts = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    form, n_near = {}, {}
    for w, n in counts.items():
        mine = [v for v in counts if v != w and near(v, w)]
        n_near[w] = len(mine)
        best = min(mine, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, n_near[w], counts[form[w]] if form[w] else None)
    return out


def collected(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_words_and_variants(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abéÿ×", k=rng.randrange(6, 9))) for _ in range(300)]
    docs = [(None if i == 7 else i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(vocabulary, range(1, 301), k=150)))
            for i in range(200)] + [(500, None), (501, ""), (502, "x" * 70000 + " " + "x" * 70000)] * 6 + [(503 + i, "x" * 69999 + "y") for i in range(5)]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in docs], "doc_id long, text string, n int, word string")
    want = plain_words(docs)
    counts = spelling.count_words(df)
    assert {r.word: r.n for r in counts.collect()} == want
    got, full = collected(spelling.group_variants(counts)), plain_variants(want)
    assert got == full
    assert any(v[0] for v in full.values())
    assert spelling.group_variants(spelling.count_words(df.limit(0))).count() == 0


def test_variants_of_large_lists(spark, monkeypatch):
    """Lists far beyond the leaf are listed again; words that share all but an end, and short rests."""
    monkeypatch.setattr(spelling, "LEAF", 4)
    monkeypatch.setattr(spelling, "TOGETHER", 50)
    rng = random.Random(6)
    words = {"aaaaaa" + "".join(rng.choices("abc", k=rng.randrange(7))) for _ in range(150)}
    words |= {"".join(rng.choices("abc", k=rng.randrange(7))) + "bcbcbc" for _ in range(150)} | {"abcabc" + c for c in "abcdefghijklmnopqrstuvwxyz"}
    words |= {"".join(rng.choices("ab", k=6)) for _ in range(40)} | {"", "a", "b", "ab"}
    counts = {w: rng.choice((5, 6, 30, 30, 200, 5000)) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain_variants(counts)
    assert collected(spelling.group_variants(df)) == want
    assert any(v[0] and v[1] != v[0] for v in want.values())  # forms of forms
