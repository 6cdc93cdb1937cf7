"""Data profiles (A1–A7, L1): the numbers behind the reference's cleaning charts.

Every profile of many columns is one pass: columns are unpivoted into
(column, value) rows and aggregated together, so ten columns cost one shuffle,
not ten.  Quantiles are exact and distributed (``ranking.quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.operators import ranking as K

NA = "NA"
BOX_SCHEMA = ("column string, n long, mean double, q1 double, median double, q3 double, iqr double, whisker_low double, "
              "whisker_high double, outliers long")


def value_counts(df: DataFrame, cols: Sequence[str], na: str = NA) -> DataFrame:
    """A1: (column, value, count) with null shown as ``na``, values as text,
    largest count first within a column."""
    long = K.unpivot(df, cols, "string").withColumn("value", F.coalesce("value", F.lit(na)))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("column", F.desc("count"), "value")


def missing_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: (column, missing) — nulls per column in one aggregation."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "missing")


def missing_mask(df: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A3: per-row null flags (the heat map data); a projection, no shuffle."""
    cols = [c for c in (cols or df.columns) if c != key]
    return df.select(key, *[F.col(f"`{c}`").isNull().cast("int").alias(c) for c in cols])


def shorten(text: Column | str, width: int = 120, placeholder: str = "...") -> Column:
    """Whitespace collapsed; if longer than ``width``, whole words (and parts of words
    joined by a hyphen) are dropped from the end until the rest plus ``placeholder``
    fits; a first word that does not fit leaves the placeholder alone (``textwrap.shorten``)."""
    t = F.col(text) if isinstance(text, str) else text
    s = F.trim(F.regexp_replace(t, r"\s+", " "))
    room = width - len(placeholder)
    # the longest head that ends before a space, or behind the hyphen between two words with letters
    head = F.regexp_extract(s, rf"^(.{{0,{room}}})(?<=\S)(?:(?= )|(?<=\w[^0-9\W]-)(?=\w+[^0-9\W]))", 1)
    return F.when(F.length(s) <= width, s).otherwise(F.concat(head, F.lit(placeholder)))


def sample_uniques(df: DataFrame, cols: Sequence[str], key: str, k: int = 6, width: int = 120,
                   sep: str = ", ") -> DataFrame:
    """A4: (column, sample_uniques) — the first ``k`` distinct non-null values in key
    order, joined and shortened.  Distinct values first (one partial aggregation),
    then a two-level top-k, so no task holds all distinct values of a column."""
    freq = K.value_frequencies(df, cols, "string", first_seen=key)
    top = K.top_k_per_group(freq, ["column"], [F.col("first_seen"), F.col("value")], k)
    joined = top.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("first_seen", "value"))).alias("_v"))
    text = F.array_join(F.transform("_v", lambda x: x["value"]), sep)
    return joined.select("column", shorten(text, width).alias("sample_uniques"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """A5: (column, bin, lower, upper, count) — ``bins`` equal-width bins from min to
    max, last bin closed, empty bins included; a constant column is centred in a
    unit range (NumPy's rule)."""
    long = K.unpivot(df, cols, "double").where(F.col("value").isNotNull() & ~F.isnan("value"))
    rng = long.groupBy("column").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    rng = rng.select("column",
                     F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                     F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    x = long.join(K.broadcast_if_small(rng), "column")  # a row a column
    idx = F.floor((F.col("value") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo"))))
    counts = x.groupBy("column", F.least(idx.cast("int"), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    grid = rng.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (grid.join(counts, ["column", "bin"], "left")
            .select("column", "bin", (F.col("lo") + F.col("bin") * w).alias("lower"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def box_stats(df: DataFrame, cols: Sequence[str], whis: float = 1.5) -> DataFrame:
    """Per column n, mean, quartiles (linear interpolation), IQR, whiskers (the
    most extreme data within ``whis``·IQR of the box) and the number of outliers.

    The quartiles are fitted by counting (``ranking.quantiles``) and applied as literals: one
    aggregation of one row gives the rest, nothing is joined and no row is shuffled.  Nulls and NaN
    take no part; a column without values has no row."""
    quart = {c: q for c, q in K.quantiles(df, cols, [0.25, 0.5, 0.75]).items() if q[0.5] is not None}
    aggs, rows = [], []
    for i, (c, q) in enumerate(quart.items()):
        q1, median, q3 = q[0.25], q[0.5], q[0.75]
        low, high = F.lit(q1 - whis * (q3 - q1)), F.lit(q3 + whis * (q3 - q1))
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)
        # a whisker is the most extreme value inside its fence, so the values beyond the
        # whiskers are exactly the values beyond the fences: one pass gives all of it
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.min(F.when(v >= low, v)).alias(f"l{i}"),
                 F.max(F.when(v <= high, v)).alias(f"h{i}"), F.count_if((v < low) | (v > high)).alias(f"o{i}")]
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.lit(q1).alias("q1"),
            F.lit(median).alias("median"), F.lit(q3).alias("q3"), F.lit(q3 - q1).alias("iqr"),
            F.least(F.col(f"l{i}"), F.lit(q1)).alias("whisker_low"),  # never inside the box
            F.greatest(F.col(f"h{i}"), F.lit(q3)).alias("whisker_high"), F.col(f"o{i}").alias("outliers")))
    if not rows:
        return df.sparkSession.createDataFrame([], BOX_SCHEMA)
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair (pairwise-complete rows);
    undefined (constant column) → null.

    Pass 1 (one row, bounded by the columns): means and null counts.  Without
    nulls, pass 2 sums centred products — one plain ``sum`` per pair, numerically
    stable and small enough for whole-stage codegen.  With nulls, each pair uses
    its own complete rows (``covar_pop`` / ``stddev_pop``).  ``corr()`` itself is
    avoided: under ANSI mode it raises on a constant column."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    val = {c: F.col(f"`{c}`").cast("double") for c in cols}
    first = df.agg(*[F.avg(val[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.count_if(val[c].isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    none = F.lit(None).cast(T.DoubleType())
    if all(first[f"n{i}"] == 0 for i in range(len(cols))):
        cen = {c: val[c] - F.lit(first[f"m{i}"] if first[f"m{i}"] is not None else 0.0) for i, c in enumerate(cols)}
        sums = df.agg(*[F.sum(cen[a] * cen[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
        var = {a: f"s{i}" for i, (a, b) in enumerate(pairs) if a == b}

        def cell(i, a, b):
            r = F.try_divide(F.col(f"s{i}"), F.sqrt(F.col(var[a]) * F.col(var[b])))
            return F.nanvl(r, none)
        one = sums.select(*[cell(i, a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    else:
        def pearson(a: str, b: str) -> Column:
            x, y = val[a], val[b]
            x2, y2 = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
            return F.nanvl(F.try_divide(F.covar_pop(x2, y2), F.stddev_pop(x2) * F.stddev_pop(y2)), none)
        one = df.agg(*[pearson(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"`{i}`").alias("corr"))
        for i, (a, b) in enumerate(pairs)] + [
        F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"`{i}`").alias("corr"))
        for i, (a, b) in enumerate(pairs) if a != b]))
    return one.select(cells.alias("c")).select("c.col_a", "c.col_b", "c.corr")


def preview(df: DataFrame, cols: Sequence[str], key: str, n: int = 10) -> DataFrame:
    """L1: the first ``n`` rows (key order) of the listed columns that exist.
    ``orderBy().limit()`` plans as a distributed top-n (TakeOrderedAndProject)."""
    present = [c for c in cols if c in df.columns]
    return df.orderBy(key).limit(n).select(key, *present)
