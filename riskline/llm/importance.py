"""Quality by importance resampling.

Two bag-of-n-grams models are counted over hashed features: one of target texts (rows labelled good), one
of the whole raw corpus. A document's log importance weight is the sum, over its n-grams, of the log
ratio of the two models; adding Gumbel noise and keeping the k largest keys draws k documents without
replacement in proportion to their weights. The noise is a hash of the row, so a repeated run, or a task
run again, draws the same documents.

Features are words (ASCII letters and digits, anything beyond ASCII; A-Z lower-cased) and runs of other
characters but white space, and pairs of neighbours, hashed into ``BUCKETS`` buckets. The raw model is
counted over all rows; the target model over at most ``TARGET_ROWS`` labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.llm.common import prepare, slices, staged, text_buffer
from riskline.llm.words import ALNUM, NONSPACE, find_words, gram_hashes, hash_words

BUCKETS = 1 << 16
#: Labelled target rows that the target model is counted on, about; of more, a hash of their id chooses.
TARGET_ROWS = 50_000
#: Added to each bucket's count in both models, in units of its mean count.
SMOOTHING = 1.0
#: A group of keys of this size is sorted to find the last one kept.
SORTED_KEYS = 20_000


def features(data: np.ndarray, offsets: np.ndarray, size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, text of every n-gram): words and runs of symbols, and neighbouring pairs."""
    b1, e1, _ = find_words(data, offsets, ALNUM)
    b2, e2, _ = find_words(data, offsets, NONSPACE & ~ALNUM)
    begins, ends = np.concatenate([b1, b2]), np.concatenate([e1, e2])
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], ends[order]
    words = hash_words(data, begins, ends)
    text = np.searchsorted(offsets, begins, "right") - 1
    pairs = gram_hashes(words, 2)
    inside = text[:-1] == text[1:]
    shift = np.uint64(64 - (size.bit_length() - 1))
    buckets = np.concatenate([words >> shift, pairs[inside] >> shift]).astype(np.int64)
    return buckets, np.concatenate([text, text[:-1][inside]])


def _row_hash(id_: Column) -> Column:
    return F.xxhash64(id_.cast("string"))


def count_models(docs: DataFrame, targets: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                 size: int = BUCKETS) -> np.ndarray:
    """Counts per bucket over target rows (hash of the id in the sorted ``targets``) and over all rows: (2, buckets)."""
    sent = docs.sparkSession.sparkContext.broadcast(targets)  # TARGET_ROWS at most

    def run(batches):
        targets = sent.value
        counts = np.zeros((2, size))
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(targets, ids), max(0, len(targets) - 1))
                chosen = targets[at] == ids if len(targets) else np.zeros(len(ids), bool)
                buckets, text = features(*text_buffer(part.column(1)), size)
                counts[1] += np.bincount(buckets, minlength=size)
                counts[0] += np.bincount(buckets[chosen[text]], minlength=size)
        bucket = np.flatnonzero(counts[1])
        for begin in range(0, len(bucket), 10_000):
            b = bucket[begin:begin + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(counts[0, b]), pa.array(counts[1, b])],
                                             ["bucket", "target", "raw"])

    rows = docs.select(_row_hash(F.col(f"`{id_col}`")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    sums = rows.mapInArrow(run, "bucket int, target double, raw double").groupBy("bucket").agg(
        F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()  # one row a bucket at most
    out = np.zeros((2, size))
    for r in sums:
        out[:, r["bucket"]] = r["target"], r["raw"]
    return out


def log_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability per bucket; all 0 without target or raw n-grams."""
    if not counts.sum(axis=1).all():
        return np.zeros(counts.shape[1])
    mean = counts.sum(axis=1, keepdims=True) / counts.shape[1]
    p = counts + smoothing * mean
    p /= p.sum(axis=1, keepdims=True)
    return np.log(p[0]) - np.log(p[1])


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits ^ np.int64(-2**63), bits)


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_grams``, ``log_weight``, ``gumbel_key`` (the weight with its noise) and its order as a long."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(id_.alias("id"), F.xxhash64(id_.cast("string"), text, F.lit(seed)).alias("noise"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        ratios = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                buckets, text = features(*text_buffer(part.column(2)), len(ratios))
                n = part.num_rows
                weight = np.bincount(text, ratios[buckets], n).astype(float)
                bits = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)
                key = weight - np.log(-np.log((bits + 0.5) / 2.0**53))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.bincount(text, minlength=n), pa.int64()), pa.array(weight), pa.array(key),
                     pa.array(_ordered(key))], ["id", "n_grams", "log_weight", "gumbel_key", "place"])

    return rows.mapInArrow(run, f"id {id_type}, n_grams bigint, log_weight double, gumbel_key double, place bigint"
                           ).withColumnRenamed("id", id_col)


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The kth largest value of a long column (None if there are fewer): counts by leading bits, 16 more each
    round, until the group that holds it is small enough to sort."""
    left, n = k, rows.count()
    if k > n or k < 1:
        return None
    for shift in (48, 32, 16, 0):
        groups = rows.groupBy(F.shiftright(column, shift).alias("g")).count().collect()  # 65,536 rows at most
        for r in sorted(groups, key=lambda r: -r["g"]):
            if left <= r["count"]:
                break
            left -= r["count"]
        rows = rows.where(F.shiftright(column, shift) == r["g"])
        if shift == 0:
            return r["g"]
        if r["count"] <= SORTED_KEYS:
            return sorted((x[0] for x in rows.select(column).collect()), reverse=True)[left - 1]
    return None


def resample(docs: DataFrame, labels: DataFrame, is_target: Column, share: float | None = None, seed: int = 0,
             id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """Every row of ``docs`` with ``n_grams``, ``log_weight``, ``gumbel_key`` and ``kept``.

    ``is_target`` chooses target rows by columns of ``labels`` (joined by id; null ids match nothing). The
    share of rows drawn is ``share``, or without it that of target rows among the labelled. Rows that tie
    with the last one drawn, such as a row given twice, are drawn too. Null, empty and wordless texts
    have weight 0; without labels all weights are 0 and all rows are kept; other columns are not read."""
    spark = docs.sparkSession
    prepare(spark)
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(is_target, F.lit(False)).alias("good")).where("id is not null")
    total, good = marked.agg(F.count(F.lit(1)), F.count_if("good")).first()
    if share is None:
        share = good / total if total else 1.0
    hashes = marked.where("good").select(_row_hash(F.col("id")).alias("h")).distinct()
    chance = int(min(1.0, TARGET_ROWS / max(1, good)) * (1 << 30))
    hashes = hashes.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < chance)
    targets = np.sort(np.array([r["h"] for r in hashes.collect()], np.int64))
    ratios = log_ratios(count_models(docs, targets, id_col, text_col, buckets), smoothing)
    weighed = staged(weigh(docs, ratios, seed, id_col, text_col), "weights")
    last = kth_largest(weighed, "place", round(share * weighed.count()))
    kept = F.lit(share > 0) if last is None else F.col("place") >= F.lit(last)
    return weighed.withColumn("kept", kept).drop("place")
