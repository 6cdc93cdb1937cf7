"""Spelling variants: words of a corpus one edit apart, found by a dynamic program over sorted lists.

Words one edit apart (one code point inserted, deleted or replaced) have one half in common: the first half of the
shorter one, or as many code points at the end. So every word is listed under its halves, and each list, the rest of
its words sorted, is scanned by each of its words: the edit matrix between the scanning word and the list's prefixes
is kept as a stack of rows of three cells (the band of one edit), rows up to the prefix that a list entry shares with
the one before are reused, and a range of entries whose shared prefix is already more than one edit away is skipped
in one step. All words of many lists advance together, one character a step, as NumPy arrays.

Lists of more than ``LEAF`` words are listed again by the halves of their rests, until they are small or their rests
have two code points at most, which the alphabet bounds. A pair of words meets in several lists; it counts in the
one that the pair's own halves name.

Words are counted where the texts are, and the counts added up; only distinct words are shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import prepare, staged

#: Letters of a word, lower case A-Z; runs of them are taken whole.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is this many times as frequent as its variant.
RATIO = 5
#: Of runs that this number divides the hash of, one code point is left out.
SLIP = 199
#: Words of a list that are scanned without listing them again.
LEAF = 512
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Words, and words times their length, that advance together (a list alone if it is larger).
TOGETHER, CELLS = 30_000, 3_000_000
#: Longer rests are compared directly.
LONG_REST = 200
_LIST_PAD, _WORD_PAD = 0x110000, 0x110001


def slipped(run: str, h: int) -> str:
    """A lower-cased run, without the code point that its hash names if ``SLIP`` divides that."""
    if h % SLIP:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of whole texts with at least ``least_length`` code points and ``least_count`` occurrences.

    Words are maximal runs of letters with A-Z lower-cased; the crc32 of ``<id>:<run>`` makes slips of the pen
    (:func:`slipped`), the same for every repetition of a run in a document. A null text has no words, a null id
    counts as an empty one, rows that repeat count each. Other columns are not read. An empty table gives an
    empty one."""
    prepare(docs.sparkSession)
    pattern = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{id_ or ''}:".encode())
                # bytes.lower() changes A-Z alone
                for word, n in Counter(pattern.findall(text.encode("utf-8").lower().decode("utf-8"))).items():
                    h = zlib.crc32(word.encode("utf-8"), seed)
                    if not h % SLIP:
                        word = slipped(word, h)
                        if len(word) < least_length:
                            continue
                    counts[word] += n
            if len(counts) >= COUNTED:
                yield flush(counts)
                counts = Counter()
        yield flush(counts)

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _listed(rows: DataFrame) -> DataFrame:
    """Each row (list, path, word, n, rest) under the halves of its rest.

    A pair's half has half the shorter word's length: a word is listed by its own as the shorter one, and by that
    of a word shorter by one. A half of no code points is one list for both ends."""
    size = F.length("rest")
    own, shorter = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    halves = F.when((size == 0) | (own == shorter), F.array(own)).otherwise(F.array(own, shorter))
    out = rows.withColumn("half", F.explode(halves)).withColumn(
        "end", F.explode(F.when(F.col("half") == 0, F.array(F.lit("f"))).otherwise(F.array(F.lit("f"), F.lit("r")))))
    front = F.col("end") == "f"
    key = F.when(front, F.expr("left(rest, half)")).otherwise(F.expr("right(rest, half)"))
    rest = F.when(front, F.expr("substring(rest, half + 1)")).otherwise(F.expr("left(rest, length(rest) - half)"))
    return out.select(F.xxhash64("list", "end", "half", key).alias("list"), F.concat_ws(".", "path", F.concat("end", F.col("half").cast("string"))).alias("path"),
                      "word", "n", rest.alias("rest"))


@lru_cache(maxsize=10_000)
def _steps(path: str) -> tuple[tuple[bool, int], ...]:
    return tuple((step[0] == "f", int(step[1:])) for step in path.split(".") if step)


def _belongs(a: str, b: str, path: str) -> bool:
    """Whether a list's path is the one that the pair's own halves name."""
    for front, half in _steps(path):
        if min(len(a), len(b)) // 2 != half or (a[:half] == b[:half]) != front:
            return False
        a, b = (a[half:], b[half:]) if front else (a[:len(a) - half], b[:len(b) - half])
    return True


def _one_edit(a: str, b: str) -> bool:
    """Whether two different strings are one edit apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[n:] == b[n + 1:] if len(a) < len(b) else a[n + 1:] == b[n + 1:]


def near_pairs(lists: np.ndarray, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of rests one edit apart in one list; sorted by list, then rest, rests distinct in a list."""
    n = len(rests)
    lengths = np.fromiter(map(len, rests), np.int64, n)
    width = int(lengths.max(initial=0))
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if width > LONG_REST:
        pairs = []
        begins = np.r_[0, np.flatnonzero(np.diff(lists)) + 1, n].tolist()
        for a, b in zip(begins, begins[1:]):
            pairs += [(i, j) for i in range(a, b) for j in range(i + 1, b) if _one_edit(rests[i], rests[j])]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]
    flat = np.frombuffer("".join(rests).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    entries = np.full((n, width + 1), _LIST_PAD, np.uint32)
    entries[row, column] = flat
    words = np.full((n, width + 4), _WORD_PAD, np.uint32)  # one pad in front
    words[row, column + 1] = flat
    # code points shared with the entry before, -1 where a list begins
    same = np.cumprod(entries[1:, :width] == entries[:-1, :width], axis=1).sum(axis=1) if width else np.zeros(n - 1, np.int64)
    shared = np.r_[-1, np.where(lists[1:] == lists[:-1], same, -1)].astype(np.int64)
    # the next entry that shares fewer than d code points with the one before it, for every d and entry
    after = np.full((width + 2, n + 1), n, np.int32)
    for d in range(width + 2):
        stop = np.where(shared < d, np.arange(n), n)
        after[d, :n - 1] = np.minimum.accumulate(stop[::-1])[::-1][1:]
    band = np.empty((n, width + 1, 3), np.int8)  # rows of each word against its own prefixes, to begin with
    band[:] = (1, 0, 1)
    band[:, 0] = (2, 0, 1)
    own = np.flatnonzero(shared[1:] >= 0)
    at = own + 1
    depth = shared[at]
    left, right = [], []
    while len(own):
        last = band[own, depth].astype(np.int16)
        depth = depth + 1
        c = entries[at, depth - 1]
        b0 = np.minimum(last[:, 0] + (c != words[own, depth - 1]), last[:, 1] + 1)
        b1 = np.minimum(np.minimum(last[:, 1] + (c != words[own, depth]), last[:, 2] + 1), b0 + 1)
        b2 = np.minimum(last[:, 2] + (c != words[own, depth + 1]), b1 + 1)
        new = np.minimum(np.stack([b0, b1, b2], axis=1), 2)
        band[own, depth] = new
        far = new.min(axis=1) > 1
        done = ~far & (depth == lengths[at])
        if done.any():
            k = np.flatnonzero(done)
            apart = lengths[own[k]] - lengths[at[k]]
            near = (np.abs(apart) <= 1)
            near[near] = new[k[near], apart[near] + 1] == 1
            left.append(own[k[near]])
            right.append(at[k[near]])
        moved = far | done
        at = np.where(far, after[np.where(far, depth, 0), at], np.where(done, at + 1, at))
        live = at < n
        live[live] = ~moved[live] | (shared[at[live]] >= 0)
        own, at, depth, moved = own[live], at[live], depth[live], moved[live]
        depth = np.where(moved, shared[at], depth)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _scan(batches):
    """Sorted rows (list, path, word, n, rest) to partial results (word, n_near, minus, best), a row for every word of
    a run of lists that has near ones; ``minus`` is the count of its most frequent near word, negated."""
    def results(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        lists = table.column("list").to_numpy()
        path, word, n, rest = (table.column(c).to_pylist() for c in ("path", "word", "n", "rest"))
        best: dict[str, list] = {}
        begin = 0
        starts = np.r_[0, np.flatnonzero(np.diff(lists)) + 1, len(lists)].tolist()
        most = 0
        for a, b in zip(starts, starts[1:]):  # runs of whole lists
            most = max(most, *map(len, rest[a:b]))
            if b < len(lists) and b - begin < TOGETHER and (b - begin) * most < CELLS:
                continue
            for i, j in zip(*(x.tolist() for x in near_pairs(lists[begin:b], rest[begin:b]))):
                i, j = i + begin, j + begin
                if not _belongs(word[i], word[j], path[i]):
                    continue
                for x, y in ((i, j), (j, i)):
                    mine, theirs = best.setdefault(word[x], [0, (0, "")]), (-n[y], word[y])
                    mine[0] += 1
                    if theirs < mine[1]:
                        mine[1] = theirs
            begin, most = b, 0
        return pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.string()), pa.array([v[0] for v in best.values()], pa.int64()),
             pa.array([v[1][0] for v in best.values()], pa.int64()), pa.array([v[1][1] for v in best.values()], pa.string())],
            ["word", "n_near", "minus", "best"])

    held: list = []
    rows = 0
    for batch in batches:
        lists = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(lists)) + 1
        if held and len(lists) and lists[0] != held[-1].column(0)[-1].as_py() and rows >= TOGETHER:
            yield results(held)
            held, rows = [], 0
        if rows + batch.num_rows >= TOGETHER and len(edges):
            cut = int(edges[-1])
            held.append(batch.slice(0, cut))
            yield results(held)
            held, rows = [], 0
            batch = batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield results(held)


def _near(counts: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near ones."""
    rows = counts.select(F.lit(0).cast("long").alias("list"), F.lit("").alias("path"), "word", "n", F.col("word").alias("rest"))
    leaves = []
    while True:
        listed = _listed(rows)
        sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.max(F.length("rest")).alias("longest")).where("size > 1")
        listed = staged(listed.join(sizes, "list"), "spelling-lists")
        small = (F.col("size") <= LEAF) | (F.col("longest") <= 2)
        leaves.append(listed.where(small).drop("size", "longest"))
        rows = listed.where(~small).drop("size", "longest")
        if rows.isEmpty():
            break
    lists = reduce(DataFrame.unionByName, leaves).repartition("list").sortWithinPartitions("list", "rest")
    found = lists.mapInArrow(_scan, "word string, n_near bigint, minus bigint, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "best")).alias("first"))
    return best.select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.minus")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last. Pointers double each round; a form's count grows
    ``RATIO``-fold a step, so the rounds grow with the logarithm of the logarithm of the largest count."""
    roots = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``counts`` (word, n; words distinct, columns beyond
    these are left out).

    Near words are one code point apart, inserted, deleted or replaced. A word's form is its most frequent near
    word, of equal ones the smallest in code-point order, if that has ``ratio`` times its count at least; its root is
    the last word that forms lead to, itself without a form. ``form`` and ``form_n`` are null without a form,
    ``n_near`` is 0 without near words. Null words and an empty table give no rows."""
    prepare(counts.sparkSession)
    counts = staged(counts.select("word", "n").where(F.col("word").isNotNull()), "spelling-words")
    near = _near(counts)
    fits = F.col("best_n") >= ratio * F.col("n")
    named = staged(counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"),
        F.when(fits, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = _roots(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
