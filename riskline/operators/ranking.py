"""Order-dependent building blocks that stay distributed.

A window without ``partitionBy`` runs in one task, and Spark's exact
``percentile``/``median`` keep every distinct value of a group in one buffer.
Both break on very large tables, so running sums work in two levels (and quantiles
by counting, see ``quantiles``):

1. ``range_buckets``: approximate quantiles of the ordering column (one partial
   aggregation; texts drawn by hash for a text column) split each part into ``buckets`` contiguous value ranges;
2. totals per (part, bucket) form a table of ``parts × buckets`` rows, whose
   running offsets are broadcast back (its size is bounded by the bucket count,
   not by the data);
3. the exact running value is offset + a window partitioned by (part, bucket).

Callers de-duplicate on the ordering value first (a value-frequency table), so a
value held by a third of all rows is one row here and cannot make a hot bucket.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BUCKETS = 64
# Rows that one bucket's window ranks, about: more rows make more buckets.
ROWS_A_BUCKET = 1_000_000
# Largest bucket count: bounds and offsets (parts × buckets rows) stay small; beyond it buckets grow and spill.
MAX_BUCKETS = 1 << 14
# Largest table that is broadcast on the promise that its rows are few.
BROADCAST_ROWS = 100_000
# Values of a bracket that are listed one by one; a larger bracket is counted by ranges first.
LISTED = 10_000
# Ranges a bracket is cut into.
RANGES = 1_024


def bucket_count(df: DataFrame) -> int:
    """Buckets for a frame: at least ``DEFAULT_BUCKETS``, more as its rows grow."""
    return max(DEFAULT_BUCKETS, min(MAX_BUCKETS, df.count() // ROWS_A_BUCKET))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast once its rows are counted to be few, else left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def one_row(df: DataFrame) -> dict:
    """The single row of a statistics frame as a dict (``{}`` if empty).

    Statistics are fitted, brought to the driver — one row, bounded by the number
    of columns — and applied as literals (Spark ML's fit/transform pattern), so no
    plan joins data to a statistics table.  More than one row is an error."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("expected at most one statistics row")
    return rows[0].asDict() if rows else {}


def _check_buckets(buckets: int) -> int:
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be in 1..{MAX_BUCKETS}")
    return buckets


def _below(bounds: Column, every: Column, v: Column, step: int) -> Column:
    """How many of the ascending ``bounds`` are below ``v``: every ``step``-th of them (``every``) is compared first,
    then those of one step, so a row takes about 2·√n comparisons in place of n."""
    coarse = F.size(F.filter(every, lambda x: x < v)) * step
    return coarse + F.size(F.filter(F.slice(bounds, coarse + 1, F.lit(step)), lambda x: x < v))


def _below_list(values: Sequence, v: Column, type_name: str) -> Column:
    """:func:`_below` for an ascending list on the driver."""
    step = math.isqrt(len(values)) + 1
    bounds, every = (F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast(f"array<{type_name}>") for xs in (values, values[step - 1::step]))
    return _below(bounds, every, v, step)


def range_buckets(df: DataFrame, order_col: str, part_cols: Sequence[str] = (),
                  buckets: int = DEFAULT_BUCKETS, accuracy: int = 10000) -> DataFrame:
    """Add ``_bucket``: the index of the value range of ``order_col`` within its part.

    Bounds come from ``percentile_approx`` per part; the bound table has one array
    of ``buckets - 1`` values per part and is broadcast.  A value equal to a bound
    falls into the lower bucket, so the bucket is monotone in the value.
    """
    _check_buckets(buckets)
    part_cols = list(part_cols)
    if buckets == 1:
        return df.withColumn("_bucket", F.lit(0))
    if isinstance(df.schema[order_col].dataType, T.StringType):
        return _text_buckets(df, order_col, buckets)
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*part_cols).agg(
        F.percentile_approx(F.col(order_col), probs, accuracy).alias("_bounds"))
    v = F.col(order_col)
    if not part_cols:
        b = one_row(bounds).get("_bounds") or []
        return df.withColumn("_bucket", _below_list(b, v, df.schema[order_col].dataType.simpleString()))
    step = math.isqrt(buckets) + 1
    bounds = bounds.withColumn("_every", F.filter("_bounds", lambda _, i: i % step == step - 1))
    x = df.join(broadcast_if_small(bounds, BROADCAST_ROWS // buckets), part_cols, "left")
    return x.withColumn("_bucket", _below(F.col("_bounds"), F.col("_every"), v, step)).drop("_bounds", "_every")


def _text_buckets(df: DataFrame, order_col: str, buckets: int) -> DataFrame:
    """Buckets of a text column: bounds are texts drawn by hash (they decide the balance, not the result)."""
    v = F.col(order_col)
    drawn = df.select(v.alias("v")).where(v.isNotNull()).distinct().orderBy(F.xxhash64("v"), "v").limit(8 * buckets).collect()
    texts = sorted(r["v"] for r in drawn)
    bounds = [texts[len(texts) * i // buckets] for i in range(1, buckets)] if texts else []
    return df.withColumn("_bucket", F.when(v.isNull(), F.lit(0)).otherwise(_below_list(sorted(set(bounds)), v, "string")))


def prefix_sums(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str],
                part_cols: Sequence[str] = (), buckets: int | None = None,
                prefix: str = "cum_") -> DataFrame:
    """Running (inclusive) sums of ``sum_cols`` within each part, ascending by
    ``order_cols`` (the first one is numeric, date, timestamp or text; the others
    only break ties).  Adds ``{prefix}{c}`` per summed column.  ``buckets`` follows
    from the row count unless given."""
    order_cols, sum_cols, part_cols = list(order_cols), list(sum_cols), list(part_cols)
    buckets = bucket_count(df) if buckets is None else buckets
    if buckets == 1:
        one = Window.partitionBy(*part_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({f"{prefix}{c}": F.sum(c).over(one) for c in sum_cols})
    x = range_buckets(df, order_cols[0], part_cols, buckets)
    totals = x.groupBy(*part_cols, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    before = Window.partitionBy(*part_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part_cols, "_bucket", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    x = x.join(broadcast_if_small(offsets) if part_cols else F.broadcast(offsets), [*part_cols, "_bucket"], "left")
    within = (Window.partitionBy(*part_cols, "_bucket").orderBy(*order_cols)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for c in sum_cols:
        x = x.withColumn(f"{prefix}{c}", F.col(f"_o_{c}") + F.sum(c).over(within))
    return x.drop("_bucket", *[f"_o_{c}" for c in sum_cols])


def add_row_index(df: DataFrame, key: str | Sequence[str], name: str = "row_index",
                  buckets: int | None = None) -> DataFrame:
    """0..n−1 in key order, computed without a single-task window.

    The index depends only on the key values, never on partitioning or task
    order, so a recomputed (lost) partition gets the same numbers.
    """
    keys = [key] if isinstance(key, str) else list(key)
    x = prefix_sums(df.withColumn("_one", F.lit(1)), keys, ["_one"], buckets=buckets, prefix="_cum")
    return x.withColumn(name, F.col("_cum_one") - 1).drop("_one", "_cum_one")


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                    fanout: int = 64, rank_name: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group by ``order`` (a total order), in two levels.

    Level 1 keeps the top ``k`` within (group, hash bucket of the row), so even a group
    holding a third of all rows is split over ``fanout`` tasks; level 2 ranks the at
    most ``fanout·k`` survivors per group.
    """
    group_cols = list(group_cols)
    order = list(order)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(fanout))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    first = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
               .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    out = first.withColumn("_rank", F.row_number().over(w2)).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank_name) if rank_name else out.drop("_rank")


# ---------------------------------------------------------------------------
# Value-frequency tables: one shuffle serves modes, value counts and distinct
# samples of many columns at once.
# ---------------------------------------------------------------------------
def unpivot(df: DataFrame, cols: Sequence[str], value_type: str = "string",
            extra: Sequence[str] = ()) -> DataFrame:
    """(extra..., column, value) with ``value`` cast to ``value_type``."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(value_type).alias("value")) for c in cols]))
    return df.select(*extra, pairs.alias("_p")).select(*extra, "_p.column", "_p.value")


def value_frequencies(df: DataFrame, cols: Sequence[str], value_type: str = "string",
                      first_seen: str | None = None, keep_nulls: bool = False) -> DataFrame:
    """(column, value, n[, first_seen]) over all listed columns; one partial aggregation.

    ``first_seen`` names a key column whose minimum per value is kept (first
    occurrence in key order)."""
    extra = [first_seen] if first_seen else []
    long = unpivot(df, cols, value_type, extra)
    if not keep_nulls:
        long = long.where(F.col("value").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    if first_seen:
        aggs.append(F.min(first_seen).alias("first_seen"))
    return long.groupBy("column", "value").agg(*aggs)


def modes(freq: DataFrame, tie: str = "smallest") -> DataFrame:
    """(column, mode): most frequent value; ties → smallest value or first seen."""
    if tie == "first":
        key = F.struct(-F.col("n"), F.col("first_seen"), F.col("value"))
    elif tie == "smallest":
        key = F.struct(-F.col("n"), F.col("value"))
    else:
        raise ValueError(f"unknown tie rule {tie!r}")
    return freq.groupBy("column").agg(F.min_by("value", key).alias("mode"))


def to_one_row(long: DataFrame, cols: Sequence[str], value: str, key: str = "column") -> DataFrame:
    """(column, value) rows → one row with a field per listed column: a single
    global aggregation (no pivot shuffle); an absent column gives null."""
    return long.agg(*[F.max(F.when(F.col(key) == F.lit(c), F.col(value))).alias(c) for c in cols])


# ---------------------------------------------------------------------------
# Quantiles by bracketing: rows are counted where they are, only counts move.
# ---------------------------------------------------------------------------
def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], midpoint: bool = False,
              accuracy: int = 10_000, listed: int = LISTED, ranges: int = RANGES) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of numeric columns: {column: {p: value}}, null for a column without values.

    Linear interpolation between the ranks around (n−1)·p (NumPy's default); ``midpoint=True`` with p = 0.5 gives
    (a + b) / 2 of the two middle values (the reference's median). Nulls and NaN take no part.

    A sketch of all columns (one row) brackets each wanted rank. Every further pass counts, for all brackets at once,
    the values below, in and above each: a bracket of at most ``listed`` values by value, a larger one by ``ranges``
    equal ranges, of which the one that holds the rank is the next bracket. Counts are exact, so a bracket that the
    sketch put wrong is only found later. What is shuffled and collected are counts, bounded by columns · probs ·
    max(``listed``, ``ranges``) whatever the table's size; no row moves. A value that fills a third of the table is one count.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    # one expression a column, computed once a row: the columns may be parsed texts, and each is compared many times
    df = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    value = {c: F.col(f"v{i}") for i, c in enumerate(cols)}
    near = 2.0 / accuracy
    grid = [x for p in probs for x in (max(0.0, p - near), min(1.0, p + near))]
    row = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(value[c]).alias(f"n{i}"), F.percentile_approx(value[c], grid, accuracy).alias(f"b{i}"))]).first()
    found: dict[tuple[str, int], float] = {}
    open_: list[tuple[str, float, float, int, list[int]]] = []   # column, least and greatest value, rows expected, ranks
    ranks_of = {}
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        for k, p in enumerate(probs):
            if n:
                pos = (n - 1) * p
                lo, hi = math.floor(pos), min(math.ceil(pos), n - 1)
                ranks_of[c, p] = (lo, hi, pos - lo)
                open_.append((c, row[f"b{i}"][2 * k], row[f"b{i}"][2 * k + 1], math.ceil(2 * near * n) + 1, sorted({lo, hi})))
    while open_:
        items = [F.struct(F.lit(t).alias("t"), *_bracketed(value[c], lo, hi, rows <= listed, ranges), value[c].alias("v"))
                 for t, (c, lo, hi, rows, _) in enumerate(open_)]
        counts = (df.select(F.explode(F.array(*items)).alias("_i")).where("_i.v IS NOT NULL")
                  .groupBy("_i.t", "_i.range", "_i.one").agg(F.count(F.lit(1)).alias("n"), F.min("_i.v").alias("lo"), F.max("_i.v").alias("hi")))
        groups: dict[int, list] = {}
        for r in counts.collect():
            groups.setdefault(r["t"], []).append(r)
        later = []
        for t, (c, _, _, _, ranks) in enumerate(open_):
            before = 0
            for r in sorted(groups[t], key=lambda r: r["lo"]):
                mine = [k for k in ranks if before <= k < before + r["n"]]
                if mine and r["lo"] == r["hi"]:
                    found.update({(c, k): r["lo"] for k in mine})
                elif mine:
                    later.append((c, r["lo"], r["hi"], r["n"], mine))
                before += r["n"]
        open_ = later
    out: dict[str, dict[float, float | None]] = {c: dict.fromkeys(probs) for c in cols}
    for (c, p), (lo, hi, frac) in ranks_of.items():
        a, b = found[c, lo], found[c, hi]
        out[c][p] = a if a == b else (a + b) / 2.0 if midpoint else a + frac * (b - a)
    return out


def _bracketed(v: Column, lo: float, hi: float, by_value: bool, ranges: int) -> tuple[Column, Column]:
    """(range, one): 0 below the bracket, ``ranges`` + 1 above it, in it 1 with the value itself where values are
    listed, else the value's range; both ends of a bracket lie in different ranges, so every pass narrows it."""
    low, high = max(lo, -sys.float_info.max), min(hi, sys.float_info.max)
    width = high / 2 - low / 2
    inside = F.lit(1)
    by_value = by_value or not width > 0
    if not by_value:
        part = (F.least(F.greatest(v, F.lit(low)), F.lit(high)) / 2 - F.lit(low / 2)) / F.lit(width)
        inside = F.least(F.floor(part * ranges).cast("int"), F.lit(ranges - 1)) + 1
    which = F.when(v < F.lit(lo), 0).when(v > F.lit(hi), ranges + 1).otherwise(inside)
    one = F.when(v.between(F.lit(lo), F.lit(hi)), v) if by_value else F.lit(None).cast("double")
    return which.alias("range"), one.alias("one")
