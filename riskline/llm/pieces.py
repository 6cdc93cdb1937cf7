"""A fixed public piece vocabulary, and the lattice of pieces over batches of equal-length words.

Words are rows of a character matrix; the hash of every substring follows from prefix sums and probes the
sorted hashes of all pieces, found by their leading bits. Hashes have 64 bits; ``Lattice(..., exact=True)``
also compares the characters of every hit.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import sentencepiece

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
MARK = "▁"

#: Words of one length that a lattice holds at once, times that length.
LATTICE_CELLS = 100_000
#: Leading bits by which a key is found among the sorted ones.
LEADING_BITS = 18


def _fields(data: bytes):
    """(number, value) of every field of a serialised protocol buffer: numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        size = number() if size is None else size
        yield key >> 3, data[at:at + size]
        at += size


def require_identity(path: str) -> None:
    """Raise if the model file's normaliser changes characters or white space beyond the mark in front and for spaces,
    which is all that texts get here."""
    with open(path, "rb") as f:
        spec = dict(_fields(next((v for k, v in _fields(f.read()) if k == 3), b"")))
    # fields: 2 table of characters, 3 mark in front, 4 extra white space goes, 5 spaces become marks; 3 to 5 are on by default
    if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
        raise ValueError("the model file's normaliser changes texts, which is not reproduced here")


class Vocabulary:
    """The pieces of a SentencePiece model file: text, id, log-probability; and its byte pieces.

    A unigram model's scores are used as they are. A BPE model's scores are merge ranks, not
    log-probabilities: pieces then get those of Zipf's law by rank, log(1 / (rank + 1)), normalised."""

    def __init__(self, path: str):
        require_identity(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        raw = np.array([model.get_score(i) for i in range(n)])
        plain = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
                          for i in range(n)])
        self.size, self.unknown_id = n, model.unk_id()
        self.byte_ids = np.full(256, -1, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.texts[i][1:-1], 16)] = i
        self.has_bytes = bool((self.byte_ids >= 0).all())
        ids = np.flatnonzero(plain)
        scores = raw[ids]
        if len(ids) and (scores <= 0).all() and (scores == np.round(scores)).all():  # merge ranks
            scores = -np.log1p(np.arange(len(ids), dtype=float))
            scores -= np.log(np.exp(scores).sum())
        self._index(ids, scores)

    def _index(self, ids: np.ndarray, scores: np.ndarray) -> None:
        self.longest = max((len(self.texts[i]) for i in ids), default=1)
        self.chars = np.zeros((len(ids), self.longest), np.uint32)
        for row, i in enumerate(ids):
            self.chars[row, :len(self.texts[i])] = [ord(c) for c in self.texts[i]]
        lengths = np.array([len(self.texts[i]) for i in ids], np.int64)
        sums = prefix_sums(self.chars)
        keys = substring_keys(sums, np.zeros(len(ids), np.int64), lengths, np.arange(len(ids)))
        order = np.argsort(keys, kind="stable")
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces with one key")
        self.keys, self.ids, self.scores = keys[order], ids[order], scores[order]
        self.lengths, self.chars = lengths[order], self.chars[order]
        top = self.keys >> _U(64 - LEADING_BITS)
        self.place = np.searchsorted(top, np.arange((1 << LEADING_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.single = {int(c): k for k, (c, m) in enumerate(zip(self.chars[:, 0], self.lengths)) if m == 1}
        known = np.unique(self.chars)
        # no piece holds the mark behind another character: a text may be cut before every mark
        inner = any(MARK in self.texts[i].lstrip(MARK) for i in ids)
        self.cut_at_marks = not inner
        self.cut_chars = "" if any(c in known for c in (10, 9, 13)) else "\n\t\r"

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key in ``keys``' order, or -1."""
        bucket = (keys >> _U(64 - LEADING_BITS)).astype(np.int64)
        at, end = self.place[bucket], self.place[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        live = np.flatnonzero(at < end)
        at, end, keys = at[live], end[live], keys[live]
        while len(live):
            hit = self.keys[at] == keys
            out[live[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            live, at, end, keys = live[more], at[more], end[more], keys[more]
        return out


def prefix_sums(chars: np.ndarray) -> np.ndarray:
    """Sums of char * base**column along each row, modulo 2**64, with a zero in front."""
    powers = np.cumprod(np.r_[_U(1), np.full(chars.shape[1], _BASE, np.uint64)], dtype=np.uint64)[:chars.shape[1]]
    values = (chars.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)
    values = (values ^ (values >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
    np.cumsum(values * powers, axis=1, out=out[:, 1:])
    return out


@lru_cache(maxsize=4)
def _inverse_powers(n: int) -> np.ndarray:
    inverse = pow(int(_BASE), -1, 2**64)
    return np.cumprod(np.r_[_U(1), np.full(n, inverse, np.uint64)], dtype=np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> _U(31))) * _U(0x94D049BB133111EB)


def substring_keys(sums: np.ndarray, begin, end, rows=slice(None)) -> np.ndarray:
    """Keys of the substrings [begin, end) of rows; begin and end are numbers or one value a row."""
    inverse = _inverse_powers(1 << max(6, int(sums.shape[1]).bit_length()))
    return _finish((sums[rows, end] - sums[rows, begin]) * inverse[begin])


class Lattice:
    """For words of one length: which piece, if any, spans each (begin, end)."""

    def __init__(self, vocabulary: Vocabulary, words: list[str], exact: bool = False):
        self.exact = exact
        self.vocabulary, self.n, self.length = vocabulary, len(words), len(words[0])
        joined = "".join(words).encode("utf-32-le", "surrogatepass")
        self.chars = np.frombuffer(joined, np.uint32).reshape(self.n, self.length)
        self.sums = prefix_sums(self.chars)

    def spans(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins that may lead to ``end`` (longest piece first) and the piece row of each, -1 for none: (begins, n)."""
        v = self.vocabulary
        begins = np.arange(max(0, end - v.longest), end)
        keys = np.concatenate([substring_keys(self.sums, int(b), end) for b in begins])
        rows = v.lookup(keys)
        hit = np.flatnonzero(rows >= 0) if self.exact else ()
        if len(hit):
            which, begin = hit % self.n, begins[hit // self.n]
            same = v.lengths[rows[hit]] == end - begin
            for k in range(min(v.longest, end)):
                live = same & (begin + k < end)
                if not live.any():
                    break
                same[live] = self.chars[which[live], begin[live] + k] == v.chars[rows[hit][live], k]
            rows[hit[~same]] = -1
        return begins, rows.reshape(len(begins), self.n)


def by_length(words: list[str]):
    """Indices of words of equal length, in runs of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        step = max(1, LATTICE_CELLS // max(1, int(lengths[run[0]])))
        for k in range(0, len(run), step):
            yield run[k:k + step]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's copy of a model file's vocabulary."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def word_pattern(v: Vocabulary) -> re.Pattern:
    """Cuts marked text into words that pieces never cross; the whole text is one word if there are none."""
    if not v.cut_at_marks:
        return re.compile(r"(?s).+")
    inner = re.escape(MARK + v.cut_chars)
    alone = f"|[{re.escape(v.cut_chars)}]" if v.cut_chars else ""
    return re.compile(f"{MARK}*[^{inner}]+|{MARK}+{alone}")
