"""Benchmark decontamination by winnowing.

Texts are words (``ALNUM``, A-Z lower-cased). Of every ``WINDOW`` consecutive words the smallest hash of
the ``GRAM``-word grams in it is kept (of equal ones the last), in documents and in benchmark items
alike, so that each window that both hold leaves the same fingerprint at the same place of both. A
fingerprint carries the words around it as hashes; documents and items join on it and a hit is extended
word by word to both sides. A run of at least ``WINDOW`` equal words is a contaminated span, and every
such run is found. An item of fewer words is one window: its length's grams are all looked up.

Documents leave only fingerprints that a bit table of the benchmark's fingerprints lets through. The
table's size is bounded; a fuller one lets more through to the join, nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import BitTable, prepare, slices, staged, text_buffer
from riskline.llm.words import ALNUM, gram_hashes, mix, word_hashes

WINDOW = 10
GRAM = 5
_AROUND = WINDOW - GRAM

_HIT = "struct<gram: bigint, at: int, words: int, near: array<bigint>>"
_HIT_TYPE = pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("near", pa.list_(pa.int64()))])


def winnow(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the kept grams in texts laid end to end; ``first`` has each text's first word (n+1 values)."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64)
    grams = gram_hashes(words, GRAM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    m = len(words) - WINDOW + 1
    least, place = grams[:m].copy(), np.arange(m)
    for k in range(1, WINDOW - GRAM + 1):
        lower = grams[k:k + m] <= least
        least[lower] = grams[k:k + m][lower]
        place[lower] = np.flatnonzero(lower) + k
    return np.unique(place[text[:m] == text[WINDOW - 1:]])


def _near(words: np.ndarray, first: np.ndarray, text: np.ndarray, places: np.ndarray, missing: int) -> np.ndarray:
    """The words from ``_AROUND`` before each gram to as many after it; ``missing`` beyond the text."""
    at = places[:, None] + np.arange(-_AROUND, GRAM + _AROUND)
    inside = (at >= first[text[places]][:, None]) & (at < first[text[places] + 1][:, None])
    return np.where(inside, words[np.clip(at, 0, len(words) - 1)].view(np.int64), missing)


def fingerprints(words: np.ndarray, first: np.ndarray, short: list[int], passes, missing: int) -> pa.Array:
    """Per text a list of hits: kept grams with their surroundings, and grams of the ``short`` lengths."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    places = winnow(words, first)
    grams = gram_hashes(words, GRAM)[places] if len(places) else np.zeros(0, np.uint64)
    keep = passes(grams)
    places, grams = places[keep], grams[keep]
    found.append((places, grams, np.zeros(len(places), np.int64), _near(words, first, text, places, missing)))
    for n in short:
        if len(words) < n:
            continue
        grams = gram_hashes(words, n)
        m = len(grams)
        places = np.flatnonzero((text[:m] == text[n - 1:n - 1 + m]) & passes(mix(grams)))
        found.append((places, mix(grams[places]), np.full(len(places), n), np.zeros((len(places), 0), np.int64)))
    place = np.concatenate([f[0] for f in found])
    gram = np.concatenate([f[1] for f in found])
    size = np.concatenate([f[2] for f in found])
    around = np.concatenate([f[3].ravel() for f in found])
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.full(len(f[0]), f[3].shape[1]) for f in found]))])
    order = np.argsort(text[place], kind="stable")
    near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(around, pa.int64())).take(pa.array(order))
    owner = text[place][order]
    hits = pa.StructArray.from_arrays(
        [pa.array(gram[order].view(np.int64)), pa.array(place[order] - first[owner], pa.int32()),
         pa.array(size[order], pa.int32()), near], fields=list(_HIT_TYPE))
    ends = np.searchsorted(owner, np.arange(len(first)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)


def _fingerprinted(rows: DataFrame, short: list[int] | None, table, missing: int, n_words: str) -> DataFrame:
    """``rows`` (id, key, text) as (id, key, ``n_words``, sequence, hits); ``short`` None: an item's own length if short."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        def passes(grams: np.ndarray) -> np.ndarray:
            return np.ones(len(grams), bool) if table is None else table.value.holds(grams)

        for batch in batches:
            for part in slices(batch, "text"):
                words, first = word_hashes(*text_buffer(part.column(2)), ALNUM)
                n = np.diff(first)
                if short is None:
                    hits = _item_hits(words, first, n, passes, missing)
                else:
                    hits = fingerprints(words, first, short, passes, missing)
                place = np.arange(len(words)) - np.repeat(first[:-1], n)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(
                    mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
                sequence = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sequence), hits],
                    ["id", "key", n_words, "sequence", "hits"])

    return rows.mapInArrow(run, f"id {id_type}, key bigint, {n_words} bigint, sequence bigint, hits array<{_HIT}>")


def _item_hits(words, first, n, passes, missing) -> pa.Array:
    """An item's kept grams, or where it has fewer words than a window its one gram of all of them."""
    out = fingerprints(words, first, [], passes, missing).to_pylist()
    for i in np.flatnonzero((n > 0) & (n < WINDOW)):
        gram = mix(gram_hashes(words[first[i]:first[i + 1]], int(n[i])))
        out[i] = [{"gram": int(gram.view(np.int64)[0]), "at": 0, "words": int(n[i]), "near": []}]
    return pa.array(out, pa.list_(_HIT_TYPE))


def _row_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_.cast("string"), text)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``id_col``, ``row_key``, ``n_words``, ``spans`` (array of struct first, end: words
    that runs shared with an item cover, not merged) and ``items`` (the ids of the items, as sorted strings).

    Null, empty and wordless texts have no words and no hits; wordless items never occur; repeated rows of
    ``docs`` give equal rows each; items with equal words are looked up once and all named, items with a
    null id hit without a name. Whole texts are read, in slices of bounded bytes. Other columns are not
    read. Only hits are shuffled; a passage in a third of all documents makes one hot join key, whose rows
    a skew join splits, with one row per distinct item text on the other side."""
    spark = docs.sparkSession
    prepare(spark)
    item_rows = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.lit(0).cast("long").alias("key"),
                                 F.col(f"`{item_text_col}`").alias("text"))
    items = staged(_fingerprinted(item_rows, None, None, 1, "n"), "items").where("n > 0")
    grams = items.select("sequence", "n", F.explode("hits").alias("h")).select("sequence", "n", "h.*").drop("at").distinct()
    names = items.groupBy("sequence", "n").agg(F.collect_set(F.col("id").cast("string")).alias("names"))
    short = sorted(r["n"] for r in items.where(f"n < {WINDOW}").select("n").distinct().collect())
    table = BitTable.of(grams.select("gram").distinct(), "gram")
    id_ = F.col(f"`{id_col}`")
    text = F.col(f"`{text_col}`")
    rows = docs.select(id_.alias("id"), _row_key(id_, text).alias("key"), text.alias("text"))
    found = staged(_fingerprinted(rows, short, spark.sparkContext.broadcast(table), 0, "n_words"), "fingerprints")
    hits = found.where(F.size("hits") > 0).select(
        "key", F.col("id").cast("string").alias("name"), F.explode("hits").alias("d")).select("key", "name", "d.*")
    both = hits.alias("d").join(grams.alias("g"), (F.col("d.gram") == F.col("g.gram")) & (F.col("d.words") == F.col("g.words")))

    def run_of(places: list[int]) -> Column:
        """How many of these places in a row agree."""
        out = F.lit(len(places))
        for k in reversed(range(len(places))):
            same = F.get("d.near", F.lit(places[k])) == F.get("g.near", F.lit(places[k]))
            out = F.when(~same, F.lit(k)).otherwise(out)
        return out

    before = run_of(list(range(_AROUND - 1, -1, -1)))
    after = run_of(list(range(_AROUND + GRAM, 2 * _AROUND + GRAM)))
    spans = both.select("d.key", "d.name", "g.sequence", "g.n", F.col("d.words").alias("words"), F.col("d.at").alias("at"),
                        before.alias("before"), after.alias("after")).where(
        F.expr(f"words > 0 OR before + after >= {WINDOW - GRAM}")).select(
        "key", "name", "sequence", "n", F.expr("IF(words > 0, at, at - before)").alias("first"),
        F.expr(f"IF(words > 0, at + words, at + {GRAM} + after)").alias("end"))
    covered = spans.groupBy("key", "name").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    named = spans.select("key", "name", "sequence", "n").distinct().join(names, ["sequence", "n"]).groupBy("key", "name").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("items"))
    result = covered.join(named, [covered["key"] == named["key"], covered["name"].eqNullSafe(named["name"])]).select(
        covered["key"].alias("k"), covered["name"].alias("i"), "spans", "items")
    return found.join(result, (F.col("key") == F.col("k")) & F.col("id").cast("string").eqNullSafe(F.col("i")), "left").select(
        F.col("id").alias(id_col), F.col("key").alias("row_key"), "n_words", F.coalesce("spans", F.array()).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered_words(spans: Column) -> Column:
    """How many words the spans cover together."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("total"))

    def add(done, s):
        begin = F.greatest(done["reach"], s["first"])
        return F.struct(F.greatest(done["reach"], s["end"]).alias("reach"),
                        (done["total"] + F.greatest(s["end"] - begin, F.lit(0))).alias("total"))

    return F.aggregate(F.array_sort(spans), start, add, lambda done: done["total"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that share no window with an item, with all their columns."""
    bad = contamination(docs, benchmark, id_col, text_col).where(F.size("items") + F.size("spans") > 0)
    bad = bad.select(F.col(id_col).cast("string").alias("_name"), F.col("row_key").alias("_key")).distinct()
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.join(bad, (_row_key(id_, text) == F.col("_key")) & id_.cast("string").eqNullSafe(F.col("_name")), "left_anti")
