"""Token counts of whole texts: Arrow functions that return lengths only.

A text is cut where no token can span the cut, equal pieces are encoded once, and the pieces are handed
to the tokenizer in batches of about equal bytes. Only counts go back to Spark.

Where a cut is safe, for a byte-level BPE whose pre-tokenizer is the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

(no alternative holds white space after another character, and none looks behind): before white space
that follows a character other than white space. A piece without white space that is still very long is
cut between a letter and a following ``, . ; : ! ?``. For any other tokenizer texts stay whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from riskline.llm.common import prepare

#: White_Space of Unicode, which \s means in the tokenizer's pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_LETTER_STOP = re.compile(r"(?<=[^\W\d_])(?=[,.;:!?])")

#: Pieces above this many characters are cut at punctuation too.
LONG_PIECE = 4096
#: UTF-8 bytes handed to the tokenizer at once, about.
BATCH_BYTES = 1 << 18
#: Piece counts a worker remembers; the memory is emptied when full (it changes speed, not results).
REMEMBERED = 1_000_000


class Counter:
    """Counts tokens with one tokenizer file; lives as long as the Python worker."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space", True) and spec.get("normalizer") is None)
        added = spec.get("added_tokens") or []
        # strings whose match could reach over a cut: a text that holds one stays whole
        self.whole = [a["content"] for a in added if a.get("lstrip") or a.get("rstrip") or a.get("single_word")
                      or a.get("normalized") or re.search(f"[{SPACE},.;:!?]", a["content"])]
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """``text`` in pieces whose token counts add up to its own."""
        if not self.cuts or any(w in text for w in self.whole):
            return [text] if text else []
        out = _PIECES.findall(text)
        if len(text) > LONG_PIECE and any(len(p) > LONG_PIECE for p in out):
            out = [q for p in out for q in (_LETTER_STOP.split(p) if len(p) > LONG_PIECE else (p,))]
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces in batches of about equal bytes, the longest first so that none stands alone late."""
        batch, held = [], 0
        for p in sorted(pieces, key=len, reverse=True):
            batch.append(p)
            held += len(p) * 2
            if held >= BATCH_BYTES:
                self._encode(batch)
                batch, held = [], 0
        self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        if batch:
            for p, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                self.known[p] = len(e)

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        begin = 0
        while begin < len(texts):  # a run of texts of bounded size: its distinct pieces are held at once
            end, held = begin, 0
            while end < len(texts) and (end == begin or held < 4 * BATCH_BYTES):
                held += len(texts[end] or "")
                end += 1
            parts = [self.pieces(t) if t else [] for t in texts[begin:end]]
            if len(self.known) > REMEMBERED:
                self.known = {}
            known = self.known
            self.learn({p for part in parts for p in part if p not in known})
            for i, part in enumerate(parts):
                out[begin + i] = sum(map(known.__getitem__, part))
            begin = end
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_count(text: str | Column, path: str) -> Column:
    """Tokens of a text column as a long, without added special tokens; null and empty have none.

    ``path`` is a ``tokenizers`` JSON file that every executor can read at that place. Special strings
    inside a text are handled as the library does by default."""

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(texts.to_pylist()))

    return count(F.col(text) if isinstance(text, str) else text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row.

    One scan of two columns, no shuffle. Null and empty texts have 0 bytes and 0 tokens; repeated rows
    each give a row; other columns of ``docs`` are not read, whatever their names. Very long texts are
    encoded piece by piece, so a task holds one text and a bounded batch."""
    prepare(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    out = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                      token_count(text, path).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
