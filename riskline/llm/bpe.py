"""Byte-level BPE with word ends, by speculating and verifying.

A text is normalised and cut into words as the tokenizer file says. The distinct words of a batch are encoded
together: greedy longest match proposes tokens for all words of a length at once, and every adjacent pair of
proposed tokens is checked. A proposal whose pairs are all compatible is what merging gives, since merges meet
across a boundary only between the right edge of what stands before it and the left edge of what stands behind;
only words with an incompatible pair are merged exactly.

Whether a pair is compatible follows from undoing its merges, the latest first: down the right edge of the left
token and the left edge of the right one, the two parts that face each other at a time must not be a merge of a
lower rank than the next merge that takes one of them away.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from riskline.llm.common import prepare
from riskline.llm.pieces import by_length, prefix_sums, substring_keys

#: Words a worker remembers; emptied when full (it changes speed, not results).
REMEMBERED = 600_000
#: Longer words (in bytes) are proposed for one by one.
LONG_WORD = 200
#: The rank of what is never merged.
NEVER = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def unassigned() -> re.Pattern:
    """The code points that Python's Unicode tables leave unassigned: other tables may give them a class."""
    free = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cn"]
    edges = np.flatnonzero(np.diff(free) > 1)
    begins, ends = [free[0], *(free[k + 1] for k in edges)], [*(free[k] for k in edges), free[-1]]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins, ends)) + "]")


def plain_plane(pattern: str) -> re.Pattern | None:
    """The pattern over explicit classes of the basic plane, which ``re`` looks up in a bitmap; for texts without
    other characters. None if the pattern uses classes otherwise than within brackets, or other ones."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    outside = regex.sub(r"\[(?:[^\]\\]|\\.)*\]", "", pattern)
    if "\\" in outside or not set(regex.findall(r"\\(p\{\w+\}|.)", pattern)) <= {"p{L}", "p{N}", "s"}:
        return None
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = [(m[0][0], m[0][-1]) for m in regex.finditer(f"[{name}]+", plane)]
        pattern = pattern.replace(name, "".join(f"\\u{ord(a):04x}-\\u{ord(b):04x}" for a, b in runs))
    return re.compile(pattern)


def _single_tuples(merges: list) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]


class Model:
    """A tokenizer file's vocabulary, merges and rules. Refuses files it cannot follow exactly."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self._refuse(spec, model)
        vocab: dict[str, int] = model["vocab"]
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        self.special = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        steps = self._steps(spec["normalizer"], "normalizers")
        self.forms = [n["type"] for n in steps if n["type"] != "Replace"]
        split = self._steps(spec["pre_tokenizer"], "pretokenizers")[0]
        self.words = regex.compile(split["pattern"]["Regex"])
        self.plane_words = plain_plane(split["pattern"]["Regex"]) or self.words
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.texts = [b""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.texts[i] = token.encode("utf-8")
        self.size = size
        self.exists = np.zeros(size, bool)
        self.exists[[*vocab.values(), *self.added.values()]] = True
        self._symbols(vocab)
        self._merges(vocab, _single_tuples(model["merges"]))
        self._index(vocab)

    @staticmethod
    def _steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    def _refuse(self, spec: dict, model: dict) -> None:
        """Only what this module reproduces: NFC and lower case, white space dropped by a split that keeps its
        matches, bytes, a word end suffix, no decoder."""
        normalizers = self._steps(spec.get("normalizer"), "normalizers")
        spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}  # the split drops white space anyway
        good = all(n["type"] in ("NFC", "Lowercase") or n == spaces for n in normalizers)
        split = self._steps(spec.get("pre_tokenizer"), "pretokenizers")
        good = good and [s["type"] for s in split] == ["Split", "ByteLevel"]
        good = good and split[0].get("behavior") == "Removed" and split[0].get("invert") and not (
            split[1].get("add_prefix_space") or split[1].get("use_regex"))
        good = good and model["type"] == "BPE" and bool(self.suffix) and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        good = good and not spec.get("decoder") and all(
            not any(a.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) for a in spec.get("added_tokens") or [])
        if not good:
            raise ValueError("this tokenizer file asks for steps that are not reproduced here")

    def _symbols(self, vocab: dict[str, int]) -> None:
        """Ids of single bytes inside and at the end of a word."""
        self.inner = np.array([vocab[c] for c in byte_characters()], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in byte_characters()], np.int64)

    def _merges(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        if len(np.unique(made)) < len(made):
            raise ValueError("a token that two merges make")
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.made_at = np.full(self.size, -1, np.int64)  # -1: a single byte
        self.left[made], self.right[made], self.made_at[made] = left, right, np.arange(len(made))
        keys = left * self.size + right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.made, self.made_by = made.tolist(), made
        self.rank = dict(zip(zip(left.tolist(), right.tolist()), range(len(made))))

    def _index(self, vocab: dict[str, int]) -> None:
        """Keys of all tokens as bytes, a word's end counting as one more character."""
        of_char = {c: b for b, c in enumerate(byte_characters())}
        rows, ids = [], []
        for token, i in vocab.items():
            ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = token[:len(token) - len(self.suffix)] if ends else token
            if all(c in of_char for c in body):
                rows.append([of_char[c] for c in body] + ([256] if ends else []))
                ids.append(i)
        self.longest = max(map(len, rows))
        chars = np.full((len(rows), self.longest), 300, np.uint32)
        for k, row in enumerate(rows):
            chars[k, :len(row)] = row
        lengths = np.array([len(r) for r in rows], np.int64)
        keys = substring_keys(prefix_sums(chars), np.zeros(len(rows), np.int64), lengths, np.arange(len(rows)))
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens with one key")
        self.keys, self.key_ids, self.key_chars, self.key_lengths = keys[order], np.array(ids)[order], chars[order], lengths[order]
        self.by_bytes = {bytes(r) if r[-1] < 256 else (bytes(r[:-1]), True): i for r, i in zip(rows, ids)}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, ``NEVER`` if there is none."""
        keys = a * self.size + b
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens gives that pair."""
        good = np.ones(len(a), bool)
        at, left, right = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), NEVER, np.int64)  # a merge across of a lower rank comes first
        while len(at):
            bad = self.pair_rank(left, right) < limit
            good[at[bad]] = False
            one, two = self.made_at[left], self.made_at[right]
            go = ~bad & ((one >= 0) | (two >= 0))
            at, left, right, one, two = at[go], left[go], right[go], one[go], two[go]
            # of equal ranks the left one is merged first, so the right one is undone first, and a merge
            # across it of the same rank, further left than it, would have come first
            undo_left = one > two
            limit = np.where(undo_left, one, two + 1)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
        return good

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest tokens of words of one length: a matrix of ids by the byte they begin at, -1 elsewhere."""
        n, length = len(words), len(words[0])
        chars = np.full((n, length + 1), 256, np.uint32)
        chars[:, :length] = np.frombuffer(b"".join(words), np.uint8).reshape(n, length)
        sums = prefix_sums(chars)
        out, rows = np.full((n, length + 1), -1, np.int64), np.full((n, length + 1), -1, np.int64)
        at, live = np.zeros(n, np.int64), np.arange(n)
        while len(live):
            wanted = live
            for size in range(min(self.longest, length + 1 - int(at[live].min())), 0, -1):
                fits = at[wanted] + size
                # a token that takes the last byte takes the word's end as well
                mine = wanted[(fits <= length + 1) & (fits != length)]
                if not len(mine):
                    continue
                begin = at[mine]
                keys = substring_keys(sums, begin, begin + size, mine)
                place = np.searchsorted(self.keys, keys)
                place[place == len(self.keys)] = 0
                hit = self.keys[place] == keys
                if hit.any():
                    mine, place, begin = mine[hit], place[hit], begin[hit]
                    out[mine, begin], rows[mine, begin] = self.key_ids[place], place
                    at[mine] = begin + size
                    still = np.ones(n, bool)
                    still[mine] = False
                    wanted = wanted[still[wanted]]
                    if not len(wanted):
                        break
            if len(wanted):
                raise ValueError("a byte without a token")
            live = live[at[live] <= length]
        return out, self._spelled(rows, chars)

    def _spelled(self, rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Whether the tokens of each word, found by hashes, spell it."""
        word, begin = np.nonzero(rows >= 0)
        row = rows[word, begin]
        same = np.ones(len(word), bool)
        for k in range(self.longest):
            live = np.flatnonzero(same & (self.key_lengths[row] > k))
            if not len(live):
                break
            same[live] = chars[word[live], begin[live] + k] == self.key_chars[row[live], k]
        good = np.ones(len(rows), bool)
        good[word[~same]] = False
        return good

    def propose_long(self, word: bytes) -> np.ndarray:
        """:meth:`propose` for one word, whatever its length."""
        ids, at, n = [], 0, len(word)
        while at < n:
            for size in range(min(self.longest, n - at), 0, -1):
                key = word[at:at + size] if at + size < n else (word[at:], True)
                found = self.by_bytes.get(key)
                if found is not None:
                    ids.append(found)
                    at += size
                    break
            else:
                raise ValueError("a byte without a token")
        return np.array(ids, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, the lowest rank first and of equal ones the leftmost; n log n in the word's length."""
        data = np.frombuffer(word, np.uint8)
        ids = self.inner[data].tolist()
        ids[-1] = int(self.final[data[-1]])
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # taken by another merge
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (r := self.rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`merge` for words of one length together: the ids of all in a row, and how many each has."""
        n, length = len(words), len(words[0])
        data = np.frombuffer(b"".join(words), np.uint8).reshape(n, length)
        ids = self.inner[data]
        ids[:, -1] = self.final[data[:, -1]]
        ranks = np.full((n, length), NEVER)  # of the pair that begins at each token
        ranks[:, :-1] = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, length - 1)
        size, rows = np.full(n, length), np.arange(n)
        columns = np.arange(length)
        while len(rows):
            at = ranks[rows].argmin(axis=1)  # the first of equal ones: the leftmost
            rank = ranks[rows, at]
            go = rank < NEVER
            rows, at, rank = rows[go], at[go], rank[go]
            if not len(rows):
                break
            take = np.minimum(columns + (columns > at[:, None]), length - 1)  # what stands behind moves up
            tokens, mine = np.take_along_axis(ids[rows], take, 1), np.take_along_axis(ranks[rows], take, 1)
            size[rows] -= 1
            some, last = np.arange(len(rows)), size[rows] - 1
            tokens[some, at] = self.made_by[rank]
            mine[some, last] = NEVER
            mine[:, -1] = NEVER
            for place in (at - 1, at):
                k = np.flatnonzero((place >= 0) & (place < last))
                mine[k, place[k]] = self.pair_rank(tokens[k, place[k]], tokens[k, place[k] + 1])
            ids[rows], ranks[rows] = tokens, mine
        return ids[columns < size[:, None]], size


class Codec:
    """Encodes and decodes with one file; lives as long as the Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.library = Model(path), Tokenizer.from_file(path)
        self.unassigned = unassigned()
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.known: dict[str, bytes] = {}
        self.merged = 0  # words that were merged exactly, for tests and reports

    def normalise(self, text: str) -> str:
        for form in self.model.forms:
            if form == "NFC" and not text.isascii():
                text = unicodedata.normalize("NFC", text)
            elif form == "Lowercase":
                text = text.replace("Σ", "σ").lower()  # character by character: no final sigma
        return text

    def plain_words(self, text: str) -> list[str]:
        """The words of a text without special tokens. Where classes of characters may differ with the version of
        Unicode, the library's own rules cut it."""
        if text.isascii():
            return self.model.plane_words.findall(self.normalise(text))
        normal = self.normalise(text)
        chars = "".join({*normal, *text})
        if not self.unassigned.search(chars):
            return (self.model.plane_words if max(chars) < "\U00010000" else self.model.words).findall(normal)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        cut = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8") for w, _ in cut]

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token's string stands for itself."""
        if self.model.special is None or not self.model.special.search(text):
            return self.plain_words(text)
        out: list[str] = []
        for k, part in enumerate(self.model.special.split(text)):
            out += [part] if k % 2 else self.plain_words(part)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words and remember them."""
        raw = [w.encode("utf-8") for w in words]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG_WORD]
        groups = []  # (word indices, ids flat, words' first places and good ones)
        lengths = [raw[i] for i in short]
        for run in by_length(lengths):
            group = [lengths[k] for k in run]
            ids, spelled = self.model.propose(group)
            used = ids >= 0
            groups.append(([short[k] for k in run], ids[used], used.sum(axis=1), spelled))
        for i in range(len(raw)):
            if len(raw[i]) > LONG_WORD:
                ids = self.model.propose_long(raw[i])
                groups.append(([i], ids, np.array([len(ids)]), np.ones(1, bool)))
        if not groups:
            return
        flat, count = np.concatenate([g[1] for g in groups]), np.concatenate([g[2] for g in groups])
        good, which = np.concatenate([g[3] for g in groups]), [i for g in groups for i in g[0]]
        owner = np.repeat(np.arange(len(count)), count)
        inside = np.flatnonzero(owner[1:] == owner[:-1])  # pairs within a word
        pairs, back = np.unique(flat[inside] * self.model.size + flat[inside + 1], return_inverse=True)
        fits = self.model.compatible(pairs // self.model.size, pairs % self.model.size)[back]
        good[owner[inside[~fits]]] = False
        self._remember([words[i] for i in which], flat, count)
        wrong = [which[k] for k in np.flatnonzero(~good)]
        self.merged += len(wrong)
        short = [i for i in wrong if len(raw[i]) <= LONG_WORD]
        for run in by_length([raw[i] for i in short]):
            group = [short[k] for k in run]
            self._remember([words[i] for i in group], *self.model.merge_all([raw[i] for i in group]))
        for i in wrong:
            if len(raw[i]) > LONG_WORD:
                self.known[words[i]] = np.array(self.model.merge(raw[i]), np.int32).tobytes()

    def _remember(self, words: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        data, ends = flat.astype(np.int32).tobytes(), (4 * np.cumsum(count)).tolist()
        self.known.update(zip(words, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def encode(self, texts: list[str | None], most: int = 1 << 20):
        """The ids of each text as int32 bytes (little-endian), None for None; about ``most`` characters at once."""
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (end == begin or held < most):
                held += len(texts[end] or "")
                end += 1
            cut = [self.words(t) if t else [] for t in texts[begin:end]]
            if len(self.known) > REMEMBERED:
                self.known = {}
            if not self.known:
                self.known.update({t: np.array([i], np.int32).tobytes() for t, i in self.model.added.items()})
            known = self.known
            self.learn(list(filterfalse(known.__contains__, set().union(*cut))))
            for t, words in zip(texts[begin:end], cut):
                yield None if t is None else b"".join(map(known.__getitem__, words))
            begin = end

    def encode_array(self, texts: pa.Array) -> pa.Array:
        rows = list(self.encode(texts.to_pylist()))
        at = np.cumsum([0] + [len(r or b"") // 4 for r in rows])
        values = pa.array(np.frombuffer(b"".join(r or b"" for r in rows), np.int32), pa.int32())
        missing = pa.array([r is None for r in rows], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=missing) if rows else pa.array([], pa.list_(pa.int32()))

    def decode(self, ids: list[int | None]) -> str:
        """The tokens of ids, a space between them, as the library gives them without a decoder; no token for an id
        that is null or out of range."""
        table, size = self.model.texts, self.model.size
        try:
            parts = list(map(table.__getitem__, ids))
        except (IndexError, TypeError):
            parts = None
        if parts is None or b"" in parts or min(ids, default=0) < 0:
            parts = [table[i] for i in ids if i is not None and 0 <= i < size and self.model.exists[i]]
        return b" ".join(parts).decode("utf-8")


    def decode_array(self, rows: pa.Array) -> pa.Array:
        ids = rows.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.cumsum([0] + [n or 0 for n in pa.compute.list_value_length(rows).to_pylist()]).tolist()
        texts = [self.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
        return pa.array([t if ok else None for t, ok in zip(texts, rows.is_valid().to_pylist())], pa.string())


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(text: Column, path: str) -> Column:
    """Token ids of a text column; null stays null, empty gives no ids."""
    @arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return codec(path).encode_array(texts)

    # so called, Spark does not repeat it inside every function of the ids
    return run.asNondeterministic()(text)


def decode(ids: Column, path: str) -> Column:
    """Texts of a column of ids; null stays null."""
    @arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return codec(path).decode_array(rows)

    return run(ids)


def ids_sha256(ids: Column) -> Column:
    """The hex sha256 of ids as little-endian unsigned 32-bit integers; null counts as no ids."""
    @arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        import hashlib

        flat = rows.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(np.array([0] + [n or 0 for n in pa.compute.list_value_length(rows).to_pylist()]))
        return pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())

    return run(ids)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of its whole texts in ``ids_col``, as the tokenizers library gives them for the
    file at ``path`` without added special tokens; special strings inside a text are special tokens.

    One scan, no shuffle; every row and column stays, a column already called ``ids_col`` is replaced. A null
    text has null ids, an empty one none; repeated rows get the same ids; an empty table stays empty. A task
    holds one text, a bounded number of words and one Arrow batch. The file must be at its path on every
    executor."""
    prepare(docs.sparkSession)
    return docs.withColumn(ids_col, encode(F.col(f"`{text_col}`"), path))


def decode_documents(docs: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the decoded texts of ``ids_col`` in ``text_col`` (replaced if it exists); special tokens are kept.

    Null ids give null, no ids an empty text; ids without a token give nothing; rows stay as they are, repeated
    ones included."""
    prepare(docs.sparkSession)
    return docs.withColumn(text_col, decode(F.col(f"`{ids_col}`"), path))
