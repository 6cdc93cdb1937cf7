"""Splits, scaling and the Spark ML models.

The feature frame is prepared once (cleaned, assembled, cached by the caller)
and every model reads it.  Splits depend only on the row key and a seed — never
on partitioning — so a re-run or a lost executor gives the same rows.

Parity limits with the reference (stated, not hidden): random draws differ, so
fitted models are compared by invariants and quality.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.operators import ranking as K
from riskline.schema import FEATURES

HASH_SPACE = 16 ** 13  # 52-bit prefix of an md5 digest


def hash_rank(key: str | Column, seed: int) -> Column:
    """A 52-bit integer from md5(key:seed): uniform, reproducible in any engine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")


# --- T1 / T2 ---------------------------------------------------------------------
def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 42,
                     listed: int = K.LISTED) -> DataFrame:
    """Add ``split`` ('train'/'test') with exact per-class test counts.

    n_test = ceil(fraction · n); each class gets floor(n_k · n_test / n) and the
    rows left over go to the classes with the largest remainders (ties → smaller
    label).  Within a class, the rows with the smallest (hash(key, seed), key) are the
    test rows: the hash of the last of them is found by counting leading bits (radix
    selection, 16 bits a pass, until at most ``listed`` rows are left to list), so the
    split itself is a projection and no row is shuffled.  Classes are few: a class is
    65,536 counts and a literal at most.

    Rows without a label are left out; rows without a key are in 'train'.  Rows that repeat
    the last test key are all in 'test', so no key is on both sides."""
    x = df.where(F.col(label).isNotNull()).withColumn("_h", hash_rank(key, seed))
    cuts = _cuts(x.select(F.col(label).alias("c"), F.col("_h").alias("h"), F.col(key).alias("k")), test_fraction, listed)
    test = F.lit(False)
    for c, (h, k) in cuts.items():
        test = test | ((F.col(label) == F.lit(c)) & ((F.col("_h") < F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col(key) <= F.lit(k)))))
    return x.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h")


def _cuts(x: DataFrame, test_fraction: float, listed: int) -> dict:
    """{class: (hash, key) of its last test row} of rows (c, h, k); a class without test rows has no entry."""
    step, bits = 16, 52

    def counts(rows: DataFrame, taken: int) -> dict:
        out: dict = {}
        for r in rows.groupBy("c", F.shiftright("h", max(0, bits - taken)).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
            out.setdefault(r["c"], {})[r["p"]] = r["n"]
        return out

    first = counts(x, step)
    sizes = {c: sum(ps.values()) for c, ps in first.items()}
    want = _allocation(sizes, test_fraction)
    # per class: the leading bits of the cut, how many there are, the test rows at or below them, the rows that have them
    at: dict = {}

    def descend(c, ps: dict, rank: int, taken: int) -> None:
        for p in sorted(k for k in ps if k is not None):
            if rank <= ps[p]:
                at[c] = (p, taken, rank, ps[p])
                return
            rank -= ps[p]
        raise AssertionError("a rank beyond the rows of its class")

    for c, ps in first.items():
        rank = min(want[c], sum(n for p, n in ps.items() if p is not None))
        if rank:
            descend(c, ps, rank, step)

    def those(classes) -> DataFrame:
        keep = F.lit(False)
        for c in classes:
            p, taken, _, _ = at[c]
            keep = keep | ((F.col("c") == F.lit(c)) & (F.shiftright("h", max(0, bits - taken)) == F.lit(p)))
        return x.where(keep)

    while wide := [c for c, (_, taken, _, n) in at.items() if n > listed and taken < bits]:
        for c, ps in counts(those(wide), max(at[c][1] for c in wide) + step).items():
            descend(c, ps, at[c][2], at[c][1] + step)
    out: dict = {}
    if at:
        rows = those(at).groupBy("c", "h", "k").agg(F.count(F.lit(1)).alias("n")).collect()
        for c, (_, _, rank, _) in at.items():
            for r in sorted((r for r in rows if r["c"] == c), key=lambda r: (r["h"], r["k"])):
                rank -= r["n"]
                if rank <= 0:
                    out[c] = (r["h"], r["k"])
                    break
    return out


def _allocation(sizes: dict, fraction: float) -> dict:
    """Test rows of each class."""
    n = sum(sizes.values())
    total = math.ceil(fraction * n)
    exact = {c: k * total / n for c, k in sizes.items()}
    base = {c: math.floor(e) for c, e in exact.items()}
    left = total - sum(base.values())
    order = sorted(sizes, key=lambda c: (base[c] - exact[c], c))
    return {c: base[c] + (i < left) for i, c in enumerate(order)}


def random_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Unstratified split by hash(key, seed); a projection, no shuffle."""
    cut = int(test_fraction * HASH_SPACE)
    return df.withColumn("split", F.when(hash_rank(key, seed) < F.lit(cut), "test").otherwise("train"))


# --- T3 --------------------------------------------------------------------------
def standardize(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None,
                suffix: str = "") -> DataFrame:
    """(x − mean) / population std, statistics from ``fit_on`` (default: df);
    a zero std scales by 1.  One aggregation, applied as literals."""
    cols = list(cols)
    src = fit_on if fit_on is not None else df
    st = K.one_row(src.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                           *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    return scale_with(df, cols, st, suffix)


def scale_with(df: DataFrame, cols: Sequence[str], stats: dict, suffix: str = "") -> DataFrame:
    """Apply fitted means ``m_<c>`` and population stds ``s_<c>`` as literals (std 0 → 1)."""
    out = df
    for c in cols:
        m, s = stats.get(f"m_{c}"), stats.get(f"s_{c}")
        s = 1.0 if not s else float(s)
        out = out.withColumn(f"{c}{suffix}", (F.col(c) - F.lit(m).cast("double")) / F.lit(s))
    return out


def assemble(df: DataFrame, cols: Sequence[str] = FEATURES, out: str = "features",
             missing: dict[str, float] | None = None) -> DataFrame:
    """Ordered feature vector; a missing column is added with its fill value
    (0.0 unless given), other nulls are an error (as in the reference's models)."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(float((missing or {}).get(c, 0.0))))
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def positive_probability(col: str = "probability") -> Column:
    """P(class 1) from a Spark ML probability vector."""
    return vector_to_array(F.col(col))[1]


# --- T4–T10 ------------------------------------------------------------------------
def fit_logistic(train: DataFrame, label: str, n_rows: int, C: float = 1.0, max_iter: int = 3000,
                 features: str = "features"):
    """T4: L2 logistic regression equal to C-regularised liblinear/lbfgs objectives:
    regParam = 1/(C·n), no internal standardisation (inputs come from T3)."""
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (C * n_rows),
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10).fit(train)


def fit_gaussian_nb(train: DataFrame, label: str, features: str = "features"):
    """T5: Gaussian naive Bayes (variance smoothing 1e-9 · largest variance)."""
    return NaiveBayes(featuresCol=features, labelCol=label, modelType="gaussian").fit(train)


# T6 is in ``tree``, T7–T10 are in ``forest``, T12 and A18 in ``segments``
SEGMENT_INPUTS = ["TotalIncome", "LoanAmount", "Credit_History"]
