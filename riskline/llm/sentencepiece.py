"""SentencePiece encoding and decoding with a batched NumPy Viterbi.

A text is marked as SentencePiece does (a mark in front, a mark for every space) and cut into words that
no piece crosses. The distinct words of a batch advance together by length: at each end all substrings
probe the sorted piece keys, vectorised maxima take the best way there (of equal ways the longest last
piece) and store back pointers. A character without a piece counts as the library's unknown one (the
lowest score less 10) and is written as its bytes; so is a mark that the text itself holds, which makes
decoding exact. Long words advance in bounded batches like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from riskline.llm.common import prepare
from riskline.llm.pieces import MARK, Lattice, Vocabulary, by_length, vocabulary, word_pattern

#: Words a worker remembers; emptied when full (it changes speed, not results).
REMEMBERED = 600_000
UNKNOWN_PENALTY = 10.0
#: Stands for a mark in the text itself; a lone surrogate, so not a character of any text.
_OWN_MARK = "\udc81"


def viterbi(v: Vocabulary, words: list[str], exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The best way through words of one length, as two matrices (word, end of a piece): its begin, or -1
    where no piece of the way ends, and its row in the vocabulary, -1 for an unknown character."""
    lattice = Lattice(v, words, exact)
    n, length = lattice.n, lattice.length
    unknown = float(v.scores.min(initial=0.0)) - UNKNOWN_PENALTY
    scores = np.append(v.scores, -np.inf)  # row -1
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0.0
    from_, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
    every = np.arange(n)
    for end in range(1, length + 1):
        begins, rows = lattice.spans(end)
        ways = best[begins] + scores[rows]
        ways[-1] = np.where(rows[-1] >= 0, ways[-1], best[end - 1] + unknown)
        pick = ways.argmax(axis=0)  # the first of equal ones: the longest piece
        best[end], from_[end], piece[end] = ways[pick, every], begins[pick], rows[pick, every]
    begin_at, row_at = np.full((n, length), -1, np.int32), np.full((n, length), -1, np.int32)
    at, live = np.full(n, length), every
    while len(live):
        end = at[live]
        begin = from_[end, live]
        begin_at[live, end - 1], row_at[live, end - 1] = begin, piece[end, live]
        at[live] = begin
        live = live[begin > 0]
    if not exact:  # hashes found the pieces; their characters must agree
        word, last = np.nonzero(row_at >= 0)
        row, begin = row_at[word, last], begin_at[word, last]
        same = v.lengths[row] == last + 1 - begin
        for k in range(min(v.longest, length)):
            live = np.flatnonzero(same & (begin + k <= last))
            same[live] = lattice.chars[word[live], begin[live] + k] == v.chars[row[live], k]
        if not same.all():
            return viterbi(v, words, exact=True)
    return begin_at, row_at


class Codec:
    """Encodes and decodes with one model file; lives as long as the Python worker."""

    def __init__(self, path: str):
        v = self.v = vocabulary(path)
        self.pattern = word_pattern(v)
        self.known: dict[str, bytes] = {}
        text = [t.replace(MARK, " ").encode("utf-8") for t in v.texts]
        control = np.ones(v.size, bool)
        control[v.ids] = False
        for i in np.flatnonzero(control):
            text[i] = b""
        for b, i in enumerate(v.byte_ids):
            if i >= 0:
                text[i] = bytes([b])
        self.piece_length = np.array([len(t) for t in text] + [0], np.int64)  # the last: ids out of range
        self.piece_begin = np.concatenate([[0], np.cumsum(self.piece_length)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)

    def marked(self, text: str) -> str:
        return MARK + text.replace(MARK, _OWN_MARK).replace(" ", MARK)

    def _spell(self, chars: str) -> list[int]:
        if not self.v.has_bytes:
            return [self.v.unknown_id]
        return [int(self.v.byte_ids[b]) for b in chars.replace(_OWN_MARK, MARK).encode("utf-8")]

    def learn(self, words: list[str]) -> None:
        for run in by_length(words):
            group = [words[i] for i in run]
            begin, row = viterbi(self.v, group)
            used = begin >= 0
            flat = self.v.ids[row[used]].astype(np.int32)
            ends = np.cumsum(used.sum(axis=1)) * 4
            raw = flat.tobytes()
            odd = (used & (row < 0)).any(axis=1)
            at = 0
            for k, (word, end) in enumerate(zip(group, ends.tolist())):
                self.known[word] = raw[at:end] if not odd[k] else self._with_unknown(word, begin[k], row[k])
                at = end

    def _with_unknown(self, word: str, begin: np.ndarray, row: np.ndarray) -> bytes:
        ids: list[int] = []
        for last in np.flatnonzero(begin >= 0):
            ids += [int(self.v.ids[row[last]])] if row[last] >= 0 else self._spell(word[begin[last]:last + 1])
        return np.array(ids, np.int32).tobytes()

    def encode(self, texts: list[str | None], most: int = 1 << 20):
        """The ids of each text as int32 bytes, None for None; ``most`` characters are looked at together."""
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (end == begin or held < most):
                held += len(texts[end] or "")
                end += 1
            cut = [self.pattern.findall(self.marked(t)) if t else [] for t in texts[begin:end]]
            if len(self.known) > REMEMBERED:
                self.known = {}
            known = self.known
            self.learn(list({w for words in cut for w in words if w not in known}))
            for t, words in zip(texts[begin:end], cut):
                yield None if t is None else b"".join(map(known.__getitem__, words))
            begin = end

    def encode_array(self, texts: pa.Array) -> pa.Array:
        rows = list(self.encode(texts.to_pylist()))
        at = np.cumsum([0] + [len(r or b"") // 4 for r in rows])
        values = pa.array(np.frombuffer(b"".join(r or b"" for r in rows), np.int32), pa.int32())
        missing = pa.array([r is None for r in rows], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=missing) if rows else pa.array(
            [], pa.list_(pa.int32()))

    def decode_array(self, rows: pa.Array) -> pa.Array:
        """Texts of lists of ids: pieces joined, marks as spaces, the one in front gone; bytes that are no
        UTF-8 become U+FFFD, ids that are none nothing."""
        out: list[pa.Array] = []
        for begin in range(0, len(rows), 200):
            out.append(self._decode(rows.slice(begin, 200)))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def _decode(self, rows: pa.Array) -> pa.Array:
        counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(rows).to_pylist()], np.int64)
        ids = rows.flatten().fill_null(self.v.size).to_numpy(zero_copy_only=False).astype(np.int64)
        ids[(ids < 0) | (ids >= self.v.size)] = self.v.size
        length = self.piece_length[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(self.piece_begin[ids] - total[:-1], length) + np.arange(total[-1])
        data = self.piece_bytes[source]
        at = total[np.concatenate([[0], np.cumsum(counts)])]
        front = at[:-1][at[:-1] < at[1:]]
        front = front[data[front] == 32]
        keep = np.ones(len(data), bool)
        keep[front] = False
        at = at - np.searchsorted(front, at)
        data = data[keep].tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.array([t if ok else None for t, ok in zip(texts, rows.is_valid().to_pylist())], pa.string())


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(text: Column, model: str) -> Column:
    """Piece ids of a text column; null stays null, empty gives no ids."""
    @arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return codec(model).encode_array(texts)

    # so called, Spark does not repeat it inside every function of the ids
    return run.asNondeterministic()(text)


def decode(ids: Column, model: str) -> Column:
    """Texts of a column of piece ids; null stays null. Undoes :func:`encode` exactly."""
    @arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return codec(model).decode_array(rows)

    return run(ids)


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of its texts in ``ids_col``; one scan, no shuffle, every row and column kept.

    A null text has null ids, an empty one none; a column already called ``ids_col`` is replaced. The
    model file must be at its path on every executor."""
    prepare(docs.sparkSession)
    return docs.withColumn(ids_col, encode(F.col(f"`{text_col}`"), model))


def decode_documents(docs: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the texts of ``ids_col`` in ``text_col`` (replaced if it exists)."""
    prepare(docs.sparkSession)
    return docs.withColumn(text_col, decode(F.col(f"`{ids_col}`"), model))
