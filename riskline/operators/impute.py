"""Imputation (I1–I6) and the two cleaning pipelines built on it.

The statistics of a call are fitted by jobs of their own, one row of modes and one of
medians, and applied as literals: the cleaning itself is a projection, the rows are
never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskline.functions import encode as E
from riskline.functions import features as X
from riskline.operators import ranking as K


def mode_table(df: DataFrame, cols: Sequence[str], tie: str = "smallest",
               order_col: str | None = None) -> DataFrame:
    """Most frequent non-null value per column → one row per column (column, mode).

    One shuffle on (column, value) with map-side partial counts, then a tiny
    per-column pick.  Ties: ``smallest`` value, or ``first`` seen in ``order_col`` order.
    """
    if tie == "first" and order_col is None:
        raise ValueError("tie='first' needs order_col")
    freq = K.value_frequencies(df, cols, "string", first_seen=order_col if tie == "first" else None)
    return K.modes(freq, tie)


def mode_row(df: DataFrame, cols: Sequence[str], tie: str = "smallest",
             order_col: str | None = None) -> DataFrame:
    """One-row frame of modes (as text), one column per input column."""
    return K.to_one_row(mode_table(df, cols, tie, order_col), list(cols), "mode")


def fill_stats(df: DataFrame, mode_cols: Sequence[str] = (), median_cols: Sequence[str] = (),
               tie: str = "smallest", order_col: str | None = None, mode_fallback: str | None = None,
               median_fallback: float | None = None, approx: bool = False) -> DataFrame:
    """I1 + I2 (+ I4): the statistics of the frame itself, computed from the
    unfilled rows (one job each), then applied as literals in a single projection.
    """
    mode_cols, median_cols = list(mode_cols), list(median_cols)
    modes = K.one_row(mode_row(df, mode_cols, tie, order_col)) if mode_cols else {}
    medians = K.one_row(median_row(df, median_cols, approx)) if median_cols else {}
    types = dict(df.dtypes)
    fills = {}
    for c in mode_cols:
        parts = [F.col(c), F.lit(modes.get(c)).cast(types[c])]
        if mode_fallback is not None:
            parts.append(F.lit(mode_fallback).cast(types[c]))
        fills[c] = F.coalesce(*parts)
    for c in median_cols:
        parts = [F.col(c).cast("double"), F.lit(medians.get(c)).cast("double")]
        if median_fallback is not None:
            parts.append(F.lit(float(median_fallback)))
        fills[c] = F.coalesce(*parts)
    return df.select(*[fills[c].alias(c) if c in fills else F.col(f"`{c}`") for c in df.columns])


def fill_mode(df: DataFrame, cols: Sequence[str], tie: str = "smallest", order_col: str | None = None,
              fallback: str | None = None) -> DataFrame:
    """Fill nulls with the column's own mode; ``fallback`` when a column is all null."""
    return fill_stats(df, mode_cols=cols, tie=tie, order_col=order_col, mode_fallback=fallback)


def median_row(df: DataFrame, cols: Sequence[str], approx: bool = False, accuracy: int = 100000) -> DataFrame:
    """One-row frame of medians: exact (mean of the two middle values) or approximate.

    Exact medians are bracketed and counted (``ranking.quantiles``): no row is shuffled, and there is no
    single-group buffer of all distinct values; ``approx=True`` uses ``percentile_approx`` (one pass).
    """
    cols = list(cols)
    if approx:
        return df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in cols])
    med = K.quantiles(df, cols, [0.5], midpoint=True)
    return df.sparkSession.createDataFrame([tuple(med[c][0.5] for c in cols)], ", ".join(f"`{c}` double" for c in cols))


def fill_median(df: DataFrame, cols: Sequence[str], fallback: float | None = None,
                approx: bool = False) -> DataFrame:
    """Fill nulls with the column's own median; ``fallback`` when a column is all null."""
    return fill_stats(df, median_cols=cols, median_fallback=fallback, approx=approx)


def replace_zero_term(c: str | Column = "Loan_Amount_Term", standard: float = 360.0) -> Column:
    """A zero term → the standard term."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == 0, F.lit(standard)).otherwise(c)


def _number(df: DataFrame, c: str) -> Column:
    """P6 of a column; one of doubles or whole numbers is its own value (its text would be read back as the same)."""
    return F.col(c).cast("double") if dict(df.dtypes)[c] in _NUMBERS else E.to_numeric(c)


_NUMBERS = ("double", "tinyint", "smallint", "int", "bigint")


class MedianFill:
    """Medians learnt on one frame (after numeric parsing), applied to others.

    ``fit`` runs one aggregation and keeps a handful of doubles (one per column);
    ``transform`` is a projection with literals, so the model can be reused on a
    stream or another table.  An all-null column gets 0.0; a column missing from
    the frame being transformed is added with its median.
    """

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> MedianFillModel:
        parsed = df.select(*[_number(df, c).alias(c) for c in self.cols])
        row = median_row(parsed, self.cols).first()
        return MedianFillModel({c: (0.0 if row[c] is None else float(row[c])) for c in self.cols})


class MedianFillModel:
    def __init__(self, medians: dict[str, float]):
        self.medians = medians

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in self.medians.items():
            if c in df.columns:
                out = out.withColumn(c, F.coalesce(_number(df, c), F.lit(m)))
            else:
                out = out.withColumn(c, F.lit(m))
        return out


# ---------------------------------------------------------------------------
V1_MODE_COLS = ["Gender", "Married", "Dependents", "Self_Employed"]
V1_MEDIAN_COLS = ["LoanAmount", "Loan_Amount_Term", "Credit_History"]
V2_MODE_COLS = ["Gender", "Married", "Education", "Self_Employed", "Property_Area"]
V2_MEDIAN_COLS = ["ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History"]
V1_COLUMNS = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "ApplicantIncome",
              "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History", "Property_Area",
              "TotalIncome", "LoanAmount_log"]


def clean_v1(df: DataFrame, key: str = "Loan_ID", label: str | None = "Loan_Status",
             approx: bool = False) -> DataFrame:
    """Offline cleaning: modes (first-seen ties) and exact medians of the frame itself,
    pass-through codes as text, TotalIncome, guarded log of the amount.  The key is kept."""
    out = fill_stats(df, V1_MODE_COLS, V1_MEDIAN_COLS, tie="first", order_col=key, approx=approx)
    for c, mp in E.V1_MAPS.items():
        out = out.withColumn(c, E.encode_passthrough(c, mp))
    if label and label in df.columns:
        out = out.withColumn(label, E.encode_passthrough(label, E.LOAN_STATUS))
    out = out.withColumn("TotalIncome", X.total_income())
    out = out.withColumn("LoanAmount_log", X.log_guarded("LoanAmount"))
    keep = [key] + V1_COLUMNS + ([label] if label and label in df.columns else [])
    return out.select(*keep)


def clean_v2(df: DataFrame, key: str = "Loan_ID", label: str | None = "Loan_Status",
             interest_noise_sd: float = 0.2, seed: int = 42, approx: bool = False,
             keep_inputs: bool = False, stats: "CleanV2Model | None" = None) -> DataFrame:
    """Production features: numeric Dependents (null → 0), modes (smallest ties,
    ``Unknown`` if all null), medians (0.0 if all null), TotalIncome, ln(1+amount),
    Debt_to_Income (term 0 → 360), strict codes, targets on the same row."""
    out = df.withColumn("_dep_text", F.coalesce(F.col("Dependents").cast("string"), F.lit("0")))
    out = out.withColumn("Dependents", E.dependents_to_number("Dependents", 0.0))
    if stats is None:
        out = fill_stats(out, V2_MODE_COLS, V2_MEDIAN_COLS, tie="smallest", mode_fallback="Unknown",
                         median_fallback=0.0, approx=approx)
    else:
        types = dict(out.dtypes)
        for c in V2_MODE_COLS:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(stats.modes.get(c)).cast(types[c]),
                                               F.lit("Unknown").cast(types[c])))
        for c in V2_MEDIAN_COLS:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(stats.medians.get(c)).cast("double"),
                                               F.lit(0.0)))
    if keep_inputs:
        # the application as submitted (complete): filled values, Dependents as text
        out = out.withColumn("inputs", F.struct(*[
            (F.col("_dep_text") if c == "Dependents" else F.col(c)).alias(c) for c in INPUT_COLUMNS]))
    out = (out.withColumn("TotalIncome", X.total_income())
              .withColumn("LoanAmount_log", X.log1p("LoanAmount"))
              .withColumn("Debt_to_Income", X.debt_to_income(nonpositive_term=False)))
    for c, mp in E.V2_MAPS.items():
        out = out.withColumn(c, E.encode_strict(c, mp).cast("double"))
    cols = [key] + [c for c in X_FEATURES]
    if label and label in df.columns:
        out = (out.withColumn("Loan_Status_encoded", E.encode_strict(label, E.LOAN_STATUS))
                  .withColumn("Default", X.default_label("Loan_Status_encoded"))
                  .withColumn("Interest_Rate", X.interest_label(key=key, seed=seed, noise_sd=interest_noise_sd)))
        cols += ["Loan_Status_encoded", "Default", "Interest_Rate"]
    extra = [c for c in ("user_id", "ts") if c in df.columns] + (["inputs"] if keep_inputs else [])
    return out.select(*cols, *extra)


from riskline.schema import FEATURES as X_FEATURES, INPUT_COLUMNS  # noqa: E402


def request_features(df: DataFrame, key: str = "Loan_ID", medians: dict | None = None,
                     keep_inputs: bool = False) -> DataFrame:
    """The features of scoring requests (P3, P5, P7, P9, P10 in their request forms): a value that no map
    knows gets its column's default code, dependents are ``3+`` or an integer, else 0, and a term ≤ 0
    counts as 360 in the ratio (the term itself stays).  A missing number is the fitted median of its
    column, or 0.  Every row gets complete features, so none can fail a batch; a projection, also for
    streams."""
    medians = medians or {}
    out = df
    if keep_inputs:
        out = out.withColumn("inputs", F.struct(*[F.col(c) for c in INPUT_COLUMNS]))
    out = out.withColumn("Dependents", E.dependents_to_int("Dependents", 0).cast("double"))
    for c in V2_MEDIAN_COLS:
        known = medians.get(c)
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0 if known is None else float(known))))
    out = (out.withColumn("TotalIncome", X.total_income())
              .withColumn("LoanAmount_log", X.log1p("LoanAmount"))
              .withColumn("Debt_to_Income", X.debt_to_income(nonpositive_term=True)))
    for c, code in E.REQUEST_DEFAULTS.items():
        out = out.withColumn(c, E.encode_default(c, E.V2_MAPS[c], code).cast("double"))
    extra = [c for c in ("user_id", "ts") if c in df.columns] + (["inputs"] if keep_inputs else [])
    return out.select(key, *X_FEATURES, *extra)


class CleanV2Model:
    """``clean_v2`` with its statistics learnt once (I3-style) and applied as
    literals: the transform is a projection, so it also runs on a stream, where
    modes and medians of the unbounded input cannot be computed."""

    def __init__(self, modes: dict, medians: dict):
        self.modes, self.medians = modes, medians

    @classmethod
    def fit(cls, df: DataFrame, approx: bool = False) -> "CleanV2Model":
        base = df.withColumn("Dependents", E.dependents_to_number("Dependents", 0.0))
        # one row each, bounded by the number of columns
        m = K.one_row(mode_row(base, V2_MODE_COLS))
        md = K.one_row(median_row(base, V2_MEDIAN_COLS, approx))
        return cls({c: m.get(c) for c in V2_MODE_COLS}, {c: md.get(c) for c in V2_MEDIAN_COLS})

    def transform(self, df: DataFrame, key: str = "Loan_ID", label: str | None = "Loan_Status",
                  keep_inputs: bool = False, stats: "CleanV2Model | None" = None) -> DataFrame:
        return clean_v2(df, key, label, interest_noise_sd=0.0, keep_inputs=keep_inputs, stats=self)
