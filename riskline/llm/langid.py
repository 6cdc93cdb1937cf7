"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability in a
language is the sum over all its segmentations into pieces, which a forward algorithm adds up; a text's
score is the product over its words. Words are runs of letters, lower-cased, with the vocabulary's word
mark in front; runs of more than ``PART`` letters are scored in parts of that size.

The probabilities are fitted by expectation maximisation on labelled texts: forward and backward sums
give each piece's expected uses, first under the vocabulary's own scores and then under the language's
probabilities of the round before. A task adds up the expected uses of all its rows, so what leaves it
is one row per language and piece.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import prepare
from riskline.llm.pieces import MARK, Lattice, Vocabulary, by_length, vocabulary

UNDETERMINED = "und"
#: Letters scored together (sums stay far from the smallest double).
PART = 24
#: Expected labelled texts of a language that a model is fitted on; of more, a hash of the row chooses.
FIT_TEXTS = 4000
ROUNDS = 2
#: Added to each piece's expected uses.
SMOOTHING = 0.05
#: Probability of a letter that is no piece.
UNKNOWN = 1e-9
#: The model is one vector per language: a bound on what is sent to the executors.
MAX_LANGUAGES = 256
#: Words whose scores a worker remembers; emptied when full (it changes speed, not results).
REMEMBERED = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")
#: Numbers that are no digits (as ½ or Ⅷ), which ``re`` counts among the word characters; no letters of \\p{L}.
_NUMBERS = {i: " " for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("No", "Nl")}
_NUMBER_CHARS = frozenset(map(chr, _NUMBERS))


def words_of(text: str | None) -> list[str]:
    """Marked, lower-cased runs of letters, in parts of at most ``PART`` letters."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii() and not _NUMBER_CHARS.isdisjoint(set(text)):
        text = text.translate(_NUMBERS)
    out = []
    for w in _LETTERS.findall(text):
        if len(w) <= PART:
            out.append(MARK + w)
        else:
            out += [(MARK if k == 0 else "") + w[k:k + PART] for k in range(0, len(w), PART)]
    return out


def forward(lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Sums over segmentations of every prefix: (length + 1, word, language). ``p``: piece row by language, and a
    last row of zeros that row -1 meets."""
    alpha = np.zeros((lattice.length + 1, lattice.n, p.shape[1]))
    alpha[0] = 1.0
    for end in range(1, lattice.length + 1):
        begins, rows = lattice.spans(end)
        alone = rows[-1] < 0
        alpha[end] = np.einsum("bnl,bnl->nl", alpha[begins], p[rows])
        alpha[end][alone] += alpha[end - 1][alone] * UNKNOWN
    return alpha


def expected_uses(lattice: Lattice, p: np.ndarray, weight: np.ndarray, uses: np.ndarray) -> None:
    """Add each piece's expected uses in the words, ``weight`` (word, language) times, to ``uses`` (language, piece)."""
    alpha = forward(lattice, p)
    beta = np.zeros_like(alpha)
    beta[-1] = 1.0
    scale = weight / alpha[-1]
    for end in range(lattice.length, 0, -1):
        begins, rows = lattice.spans(end)
        alone = rows[-1] < 0
        step = p[rows] * beta[end]
        part = alpha[begins] * step * scale
        hit = rows >= 0
        for k in range(p.shape[1]):
            uses[k] += np.bincount(rows[hit], part[..., k][hit], uses.shape[1])
        beta[begins] += step
        beta[end - 1][alone] += UNKNOWN * beta[end][alone]


def prior(v: Vocabulary) -> np.ndarray:
    """The vocabulary's own probabilities."""
    p = np.exp(v.scores - v.scores.max(initial=0.0))
    return p / p.sum()


@dataclass
class LanguageModel:
    """Fitted piece probabilities: ``p`` is (piece row, language); languages are in order."""

    path: str
    languages: list[str]
    p: np.ndarray

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts with one model; remembers words."""

    def __init__(self, model: LanguageModel):
        self.v, self.model = vocabulary(model.path), model
        self.p = np.vstack([model.p, np.zeros(len(model.languages))])
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def _learn(self, words: list[str]) -> None:
        fresh = np.empty((len(words), self.table.shape[1]))
        for run in by_length(words):
            fresh[run] = np.log(forward(Lattice(self.v, [words[i] for i in run]), self.p)[-1])
        begin = len(self.known)
        self.table = np.concatenate([self.table[:begin], fresh])
        self.known.update(zip(words, range(begin, begin + len(words))))

    def predict(self, texts: list[str | None], most: int = 1 << 20) -> tuple[list[str], np.ndarray]:
        """The best language of each text (of equal ones the first in order) and its share of the likelihood."""
        languages: list[str] = []
        scores = np.zeros(len(texts))
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (end == begin or held < most):
                held += len(texts[end] or "")
                end += 1
            words = [words_of(t) for t in texts[begin:end]]
            if len(self.known) > REMEMBERED:
                self.known, self.table = {}, self.table[:0]
            known = self.known
            self._learn(list({w for ws in words for w in ws if w not in known}))
            for i, ws in enumerate(words):
                if not ws or not self.model.languages:
                    languages.append(UNDETERMINED)
                    continue
                total = self.table[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmax())
                languages.append(self.model.languages[best])
                scores[begin + i] = 1.0 / np.exp(total - total[best]).sum()
            begin = end
        return languages, scores


def fit(docs: DataFrame, path: str, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        texts: int = FIT_TEXTS, rounds: int = ROUNDS) -> LanguageModel:
    """A model of the non-null values of ``lang_col``, fitted on about ``texts`` rows of each (all, if fewer;
    a hash of id and text chooses). Rows without letters add nothing; a table without labels gives a model
    without languages, under which every text is undetermined."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{id_col}`").cast("string").alias("id")).where("lang is not null")
    counts = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r["lang"] for r in counts]
    v = vocabulary(path)
    pieces = len(v.ids)
    p = np.repeat(prior(v)[:, None], max(1, len(languages)), axis=1)
    if not languages:
        return LanguageModel(path, [], p[:, :0])
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, texts / r["count"])))])
    draw = F.pmod(F.xxhash64("id", "text", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")
    for _ in range(rounds):
        uses = np.zeros((len(languages), pieces))
        sums = _expected(chosen, path, languages, p).toArrow()  # a row a language and piece at most
        uses[sums["language"].to_numpy(), sums["piece"].to_numpy()] = sums["uses"].to_numpy()
        uses += SMOOTHING
        p = (uses / uses.sum(axis=1, keepdims=True)).T.copy()
    return LanguageModel(path, languages, p)


def _expected(rows: DataFrame, path: str, languages: list[str], p: np.ndarray) -> DataFrame:
    """(language, piece, uses): expected uses of the pieces by language."""
    model = rows.sparkSession.sparkContext.broadcast(np.vstack([p, np.zeros(p.shape[1])]))
    place = {name: k for k, name in enumerate(languages)}

    def run(batches):
        v = vocabulary(path)
        p = model.value
        uses = np.zeros((len(place), len(v.ids)))
        for batch in batches:
            found: dict[str, int] = {}
            ids, langs = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words_of(text)
                ids += [found.setdefault(w, len(found)) for w in ws]
                langs += [place[lang]] * len(ws)
            weight = np.zeros((len(found), len(place)))
            np.add.at(weight, (np.array(ids, np.int64), np.array(langs, np.int64)), 1.0)
            words = list(found)
            for run_ in by_length(words):
                expected_uses(Lattice(v, [words[i] for i in run_]), p, weight[run_], uses)
        k, piece = np.nonzero(uses)
        for begin in range(0, len(k), 10_000):
            part = slice(begin, begin + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[part], pa.int32()), pa.array(piece[part], pa.int32()),
                                              pa.array(uses[k[part], piece[part]])], ["language", "piece", "uses"])

    return rows.mapInArrow(run, "language int, piece int, uses double").groupBy("language", "piece").agg(
        F.sum("uses").alias("uses"))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (both replaced if there): one scan, no shuffle, every row kept.

    Null, empty and letterless texts are ``und`` with score 0. Repeated rows get equal results."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    scorers: list[Scorer] = []

    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        if not scorers:
            scorers.append(sent.value.scorer())
        languages, scores = scorers[0].predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    kept = docs.drop("lang_pred", "score", "_language")
    return kept.withColumn("_language", run(F.col(f"`{text_col}`"))).select(
        *[F.col(f"`{c}`") for c in kept.columns], "_language.lang_pred", "_language.score")


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a row is kept from fitting: crc32 of its id as text is divisible by ``folds`` (null ids are kept)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))
