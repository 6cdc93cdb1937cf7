"""Prediction alignment and model evaluation.

Inputs are long frames — one row per (application, model) — so any number of
models is evaluated by one grouped aggregation instead of one pass per model.
ROC and AUC first reduce rows to distinct scores (partial aggregation), then
take running sums with ``ranking.prefix_sums`` (no single-task window).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskline.functions.encode import normalize_binary, strip
from riskline.operators import ranking as K
from riskline.session import scratch_path

# Column names the reference looks for, in its order.
PREDICTION_CANDIDATES = ("Loan_Status_Predicted", "NB_Predicted", "DT_Predicted", "Logistic_Predicted",
                         "RF_Predicted", "Loan_Status", "Prediction", "pred", "Predicted")
# The report's list of the same, in its order.
PREDICTION_CANDIDATES_REPORT = ("Loan_Status_Predicted", "NB_Predicted", "DT_Predicted", "Logistic_Predicted",
                                "RF_Predicted", "Prediction", "pred", "Loan_Status")
PROBABILITY_WORDS = ("prob", "proba", "score", "confidence")
BOOLEAN_TOKENS = ("Y", "N", "YES", "NO", "TRUE", "FALSE", "1", "0", "1.0", "0.0", "T", "F")
NOT_APPLICABLE = "MAE / MSE / RMSE not applicable to classification"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


# --- J1 / J2 / J3 -------------------------------------------------------------
def align_by_key(truth: DataFrame, preds: DataFrame, key: str, pred_col: str,
                 prob_col: str | None = None, mode: str = "zero") -> DataFrame:
    """Every truth row with its model's prediction (normalised, missing → 0)
    and probability (missing → 0).  A key predicted more than once counts once, with
    its smallest prediction (then smallest probability; nulls last), so no truth row
    is multiplied.  The predictions are reduced on the join's own key: no further
    shuffle; the planner broadcasts a small side by statistics."""
    cols = [pred_col] + ([prob_col] if prob_col else [])
    order = F.struct(*[x for c in cols for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c))])
    one = preds.groupBy(key).agg(F.min(order).alias("_p")).select(key, *[F.col(f"_p.{c}").alias(c) for c in cols])
    j = truth.join(one, key, "left")
    out = j.withColumn("prediction", F.coalesce(normalize_binary(pred_col, mode), F.lit(0))).drop(pred_col)
    if prob_col:
        out = out.withColumn("probability", F.coalesce(F.col(prob_col).cast("double"), F.lit(0.0))).drop(prob_col)
    return out


def align_by_position(truth: DataFrame, preds: DataFrame, truth_order: str, pred_order: str,
                      pred_cols: Sequence[str], mode: str = "zero") -> DataFrame:
    """Pair rows by position (each side numbered in its own order with P19);
    predictions missing at the end → 0, extra predictions are dropped."""
    t = K.add_row_index(truth, truth_order)
    p = K.add_row_index(preds.select(pred_order, *pred_cols), pred_order).drop(pred_order)
    j = t.join(p, "row_index", "left")
    for c in pred_cols:
        j = j.withColumn(c, F.coalesce(normalize_binary(c, mode), F.lit(0)))
    return j


def to_long(preds: Mapping[str, tuple[DataFrame, str] | tuple[DataFrame, str, str | None]], key: str) -> DataFrame:
    """{model: (frame, prediction column[, probability column])} → (key, model, prediction, probability)."""
    parts = []
    for model, spec in preds.items():
        df, pc = spec[0], spec[1]
        prob = spec[2] if len(spec) > 2 else None
        parts.append(df.select(F.col(key), F.lit(model).alias("model"), F.col(pc).cast("string").alias("prediction"),
                               (F.col(prob).cast("double") if prob else F.lit(None).cast("double")).alias("probability")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_predictions(truth: DataFrame, long: DataFrame, key: str, truth_col: str,
                        models: Sequence[str], mode: str = "zero") -> DataFrame:
    """One wide row per application: ``<model>_pred`` per model plus ``Actual_bin``.

    The truth rides in the same long frame as a pseudo-model, so one shuffle on
    the key (a pivot with fixed names) builds the table — not one join per model.
    """
    actual = "__actual__"
    t = truth.select(key, F.lit(actual).alias("model"),
                     normalize_binary(truth_col, "truth").alias("v"))
    p = long.select(key, "model", F.coalesce(normalize_binary("prediction", mode), F.lit(0)).alias("v"))
    names = list(models) + [actual]
    # the smallest of repeated values: a repeated key gives one row whatever the task order
    wide = t.unionByName(p).groupBy(key).pivot("model", names).agg(F.min("v"))
    return wide.where(F.col(f"`{actual}`").isNotNull()).select(
        key, *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(f"{m}_pred") for m in models],
        F.col(f"`{actual}`").alias("Actual_bin"))


# --- A8 / A9 / A10 --------------------------------------------------------------
def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction",
                     by: Sequence[str] = ("model",)) -> DataFrame:
    """Always the full 2×2 (TN, FP, FN, TP) per group; labels and predictions are 0/1."""
    y, p = _col(label), _col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """A9 from the four cells: accuracy, precision, recall, F1 (0 when undefined),
    support = number of positives."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)
    prec = F.coalesce(F.try_divide(tp, tp + fp), zero)
    rec = F.coalesce(F.try_divide(tp, tp + fn), zero)
    return cm.select(
        "*", F.coalesce(F.try_divide(tp + tn, tp + tn + fp + fn), zero).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), zero).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                           by: Sequence[str] = ("model",)) -> DataFrame:
    """A9 per group."""
    return metrics_from_confusion(confusion_matrix(df, label, pred, by))


def metrics_summary(df: DataFrame, label: str = "label", pred: str = "prediction",
                    by: Sequence[str] = ("model",)) -> DataFrame:
    """A10: A9 for every model, best accuracy first."""
    m = classification_metrics(df, label, pred, by)
    return m.select(*by, "accuracy", "precision", "recall", "f1", "support").orderBy(F.desc("accuracy"), *by)


# --- A11 / A12 / A16 ------------------------------------------------------------
def score_table(df: DataFrame, label: str = "label", score: str = "probability",
                by: Sequence[str] = ("model",), buckets: int | None = None) -> DataFrame:
    """Distinct scores per group, descending, with running positives/negatives
    (cum_pos, cum_neg count rows scoring ≥ the score) and group totals.  A missing
    score counts as 0; a group without any score (a model that gives no
    probability) has no rows.

    The distinct scores and their counts are written to the shared folder once: bounds, totals and running sums
    are read from there, not from the rows again."""
    by = list(by)
    s = df.groupBy(*by, F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score")).agg(
        F.count_if(_col(label) == 1).alias("pos"), F.count_if(_col(label) == 0).alias("neg"),
        F.count(F.col(score)).alias("_scored"))
    path = scratch_path(df.sparkSession, "scores")
    s.write.parquet(path)
    s = df.sparkSession.read.parquet(path)
    tot = s.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum("_scored").alias("_scored")).where(
        "_scored > 0").drop("_scored")
    s = s.drop("_scored").withColumn("_down", -F.col("score"))
    x = K.prefix_sums(s, ["_down"], ["pos", "neg"], by, buckets).drop("_down")
    if not by:
        t = K.one_row(tot)
        x = x.where(F.lit(bool(t)))
        return x.withColumn("P", F.lit(t.get("P") or 0).cast("long")).withColumn("N", F.lit(t.get("N") or 0).cast("long"))
    return x.join(K.broadcast_if_small(tot), by)


def roc_auc(df: DataFrame, label: str = "label", score: str = "probability",
            by: Sequence[str] = ("model",)) -> DataFrame:
    """A11 + A16: tie-aware area under the ROC curve (Mann–Whitney with ½ for ties)
    per group; with fewer than two classes the area is null and ``reason`` says why."""
    by = list(by)
    t = score_table(df, label, score, by)
    above = F.col("cum_pos") - F.col("pos")
    part = t.groupBy(*by, "P", "N").agg(
        F.sum(F.col("neg").cast("double") * (above.cast("double") + F.lit(0.5) * F.col("pos"))).alias("_u"))
    two = (F.col("P") > 0) & (F.col("N") > 0)
    return part.select(
        *by, (F.when(F.col("P") > 0, 1).otherwise(0) + F.when(F.col("N") > 0, 1).otherwise(0)).alias("classes"),
        F.when(two, F.col("_u") / (F.col("P").cast("double") * F.col("N").cast("double"))).alias("auc"),
        F.when(~two, F.lit("only one class present in the labels")).alias("reason"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "probability",
              by: Sequence[str] = ("model",), drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score (descending) plus the
    origin (threshold null, 0, 0); groups with one class are skipped.
    ``drop_intermediate`` removes points collinear with their neighbours (as
    scikit-learn's ``roc_curve`` does by default)."""
    by = list(by)
    t = score_table(df, label, score, by).where((F.col("P") > 0) & (F.col("N") > 0))
    pts = t.select(*by, F.col("score").alias("threshold"),
                   (F.col("cum_neg") / F.col("N")).alias("fpr"), (F.col("cum_pos") / F.col("P")).alias("tpr"))
    origin = t.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    if drop_intermediate:
        # sklearn's rule: a point whose incoming and outgoing steps are equal (pos and
        # neg counts of its score equal those of the next lower score) lies on a
        # straight run and is dropped; the first and last points are kept.  The next
        # score is found by an equi-join on the distributed rank, not by a window.
        ranked = K.prefix_sums(t.withColumn("_one", F.lit(1)).withColumn("_down", -F.col("score")),
                               ["_down"], ["_one"], by, prefix="_r").drop("_one", "_down")
        nxt = ranked.select(*by, (F.col("_r_one") - 1).alias("_r_one"), F.col("pos").alias("_npos"),
                            F.col("neg").alias("_nneg"))
        j = ranked.join(nxt, [*by, "_r_one"], "left")
        keep = (F.col("_r_one") == 1) | F.col("_npos").isNull() | (F.col("pos") != F.col("_npos")) | \
               (F.col("neg") != F.col("_nneg"))
        pts = j.where(keep).select(*by, F.col("score").alias("threshold"),
                                   (F.col("cum_neg") / F.col("N")).alias("fpr"), (F.col("cum_pos") / F.col("P")).alias("tpr"))
    return origin.unionByName(pts)


# --- A13 -------------------------------------------------------------------------
def rmse(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error per group."""
    d = _col(pred).cast("double") - _col(label).cast("double")
    return df.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.count(d).alias("n"))


# --- A14 / A15 -------------------------------------------------------------------
def detect_prediction_column(df: DataFrame, candidates: Sequence[str] = PREDICTION_CANDIDATES) -> str | None:
    """The first known name present; else the first column whose non-null
    values are all boolean-like tokens.  All columns and rows are tested in one
    aggregation; only one boolean per column reaches the driver."""
    for c in candidates:
        if c in df.columns:
            return c
    checks = []
    for c in df.columns:
        s = F.upper(strip(F.col(f"`{c}`").cast("string")))
        checks.append(F.struct(F.bool_and(F.when(s.isNotNull(), s.isin(*BOOLEAN_TOKENS))).alias("ok"),
                               F.count(s).alias("n")).alias(c))
    row = df.agg(*checks).first()
    for c in df.columns:
        ok, n = row[c]["ok"], row[c]["n"]
        if n and ok:
            return c
    return None


def detect_probability_column(df: DataFrame, words: Sequence[str] = PROBABILITY_WORDS,
                              fallback: bool = False, exclude: Sequence[str] = ()) -> str | None:
    """The first numeric column whose name contains a probability word; with
    ``fallback`` the first numeric column entirely within [0, 1] (excluding
    ``exclude``, e.g. the features — the reference's fallback can pick a feature)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    for c in numeric:
        if any(w in c.lower() for w in words):
            return c
    if not fallback:
        return None
    cand = [c for c in numeric if c not in set(exclude)]
    if not cand:
        return None
    row = df.agg(*[F.bool_and(F.col(f"`{c}`").between(0, 1)).alias(c) for c in cand]).first()
    for c in cand:
        if row[c]:
            return c
    return None


# --- A20 -------------------------------------------------------------------------
def model_report(long: DataFrame, label: str = "label", pred: str = "prediction", score: str = "probability",
                 by: Sequence[str] = ("model",), expected_rows: Column | int | None = None) -> DataFrame:
    """Confusion, metrics and AUC per model in one table.  A model whose row
    count differs from ``expected_rows`` gets an error text instead of numbers."""
    by = list(by)
    m = classification_metrics(long, label, pred, by)
    a = roc_auc(long, label, score, by)
    n = long.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    out = m.join(a, by, "left").join(n, by)
    err = F.lit(None).cast("string")
    if expected_rows is not None:
        exp = F.lit(expected_rows) if isinstance(expected_rows, int) else expected_rows
        err = F.when(F.col("rows") != exp, F.format_string("length mismatch: %d rows vs %d expected",
                                                           F.col("rows"), exp))
    return out.select(*by, "rows", "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "support",
                      "auc", F.coalesce(F.col("reason"), F.lit("")).alias("auc_note"), err.alias("error"),
                      F.lit(NOT_APPLICABLE).alias("regression_note"))
