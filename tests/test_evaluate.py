"""Alignment, confusion, metrics, ROC/AUC, detection; golden metrics of the reference."""

import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskline.operators import evaluate as V
from tests.conftest import reference_file


def brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def test_auc_matches_brute_force_and_symmetry(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(400)]  # many ties
    df = spark.createDataFrame(rows, "k int, label int, s double").withColumn("neg", -F.col("s"))
    a = V.roc_auc(df, "label", "s", by=()).first()["auc"]
    b = V.roc_auc(df, "label", "neg", by=()).first()["auc"]
    assert abs(a - brute_auc([r[1] for r in rows], [r[2] for r in rows])) < 1e-12
    assert abs(a + b - 1.0) < 1e-12


def test_auc_one_class_and_curve(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, p double")
    r = V.roc_auc(df, "label", "p", by=()).first()
    assert r["auc"] is None and r["classes"] == 1 and "one class" in r["reason"]
    assert V.roc_curve(df, "label", "p", by=()).count() == 0
    df2 = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, p double")
    pts = [(r["threshold"], r["fpr"], r["tpr"]) for r in
           V.roc_curve(df2, "label", "p", by=()).orderBy(F.col("threshold").desc_nulls_first()).collect()]
    assert pts == [(None, 0.0, 0.0), (0.9, 0.0, 0.5), (0.8, 0.5, 0.5), (0.7, 0.5, 1.0), (0.1, 1.0, 1.0)]
    kept = V.roc_curve(df2, "label", "p", by=(), drop_intermediate=True).count()
    assert kept == 5  # no three collinear points here


def _sklearn_rule(labels, scores):
    """Reference behaviour of drop_intermediate, written out with NumPy."""
    import numpy as np
    order = np.argsort(-np.asarray(scores), kind="mergesort")
    y, s = np.asarray(labels)[order], np.asarray(scores)[order]
    idx = np.r_[np.where(np.diff(s))[0], y.size - 1]
    tps, fps, thr = np.cumsum(y)[idx], (1 + idx) - np.cumsum(y)[idx], s[idx]
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    return sorted(float(t) for t in thr[keep])


def test_roc_drop_intermediate_matches_rule(spark):
    import random
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 40))) for _ in range(300)]
    rows += [(1, 100.0 + i) for i in range(6)] + [(0, -10.0 - i) for i in range(6)]  # straight runs
    df = spark.createDataFrame(rows, "label int, p double")
    got = sorted(r["threshold"] for r in V.roc_curve(df, "label", "p", by=(), drop_intermediate=True).collect()
                 if r["threshold"] is not None)
    assert got == _sklearn_rule([r[0] for r in rows], [r[1] for r in rows])


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    m = V.classification_metrics(df, by=()).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (1, 0, 1, 0)
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["accuracy"] == 0.5


def test_golden_metrics_summary(spark):
    """The reference's published train metrics follow from the implied confusion cells."""
    golden = pd.read_csv(reference_file("metrics_summary_train.csv"))
    cells = {"random_forest": (178, 14, 7, 415), "decision_tree": (106, 86, 14, 408),
             "logistic_regression": (84, 108, 7, 415), "naive_bayes": (90, 102, 21, 401)}
    cm = spark.createDataFrame([(m, *c) for m, c in cells.items()], "model string, tn long, fp long, fn long, tp long")
    got = {r["model"]: r for r in V.metrics_from_confusion(cm).collect()}
    for _, g in golden.iterrows():
        key = next(k for k in cells if k.split("_")[0] in str(g["model"]).lower())
        r = got[key]
        for c in ("accuracy", "precision", "recall", "f1"):
            assert abs(r[c] - float(g[c])) < 5e-4, (key, c)
        assert r["support"] == int(g["support"])


def test_align_by_position_pads_and_cuts(spark):
    truth = spark.createDataFrame([(i, "Y") for i in range(5)], "k int, Loan_Status string")
    short = spark.createDataFrame([(10, "Y"), (11, "N")], "p int, pred string")
    long = spark.createDataFrame([(i, "N") for i in range(8)], "p int, pred string")
    a = V.align_by_position(truth, short, "k", "p", ["pred"]).orderBy("row_index").collect()
    b = V.align_by_position(truth, long, "k", "p", ["pred"]).orderBy("row_index").collect()
    assert [r["pred"] for r in a] == [1, 0, 0, 0, 0] and len(b) == 5


def test_golden_compare_predictions(spark):
    """The four prediction files, aligned by position, give the reference's comparison table."""
    golden = pd.read_csv(reference_file("comparison_all_test.csv"))
    files = {"naive_bayes": ("test_naive_bayes.csv", "Loan_Status_Predicted"),
             "decision_tree": ("test_decision_tree.csv", "Loan_Status_Predicted"),
             "logistic": ("logistic_test_output.csv", "Logistic_Predicted"),
             "random_forest": ("comparison_test_with_rf.csv", "RF_Predicted")}
    preds = {}
    for m, (f, col) in files.items():
        pdf = pd.read_csv(reference_file(f))
        assert V.detect_prediction_column(spark.createDataFrame(pdf.astype(str))) == col
        sdf = spark.createDataFrame([(i, str(v)) for i, v in enumerate(pdf[col])], f"pos int, {col} string")
        preds[m] = (sdf, col)
    truth = spark.createDataFrame([(i, None) for i in range(len(golden))], "pos int, Loan_Status string")
    long = V.to_long(preds, "pos")
    wide = V.compare_predictions(truth, long, "pos", "Loan_Status", list(files)).orderBy("pos").toPandas()
    for m in files:
        assert (wide[f"{m}_pred"].to_numpy() == golden[f"{m}_pred"].to_numpy()).all(), m
    assert V.detect_probability_column(
        spark.createDataFrame(pd.read_csv(reference_file("logistic_test_output.csv")).drop(
            columns=["Dependents"]))) == "Logistic_Prob"


def test_missing_scores_count_as_zero(spark):
    from riskline.operators.evaluate import model_report, roc_auc, roc_curve
    rows = [("m", 1, 0, 0.9), ("m", 0, 0, 0.1), ("m", 1, 0, None), ("m", 0, 0, 0.2), ("none", 1, 1, None), ("none", 0, 0, None)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int, probability double")
    assert [(r.model, r.auc) for r in roc_auc(df).collect()] == [("m", 0.5)]
    assert sorted(r.threshold for r in roc_curve(df).collect() if r.threshold is not None) == [0.0, 0.1, 0.2, 0.9]
    report = {r.model: r for r in model_report(df).collect()}
    assert report["m"].auc == 0.5 and report["none"].auc is None and report["none"].rows == 2


def test_repeated_keys_do_not_multiply(spark):
    from riskline.operators.evaluate import align_by_key, compare_predictions
    truth = spark.createDataFrame([("a", "Y"), ("b", "N")], "k string, t string")
    preds = spark.createDataFrame([("a", "N", 0.2), ("a", "Y", 0.9), ("a", None, None)], "k string, p string, q double")
    got = {r.k: (r.prediction, r.probability) for r in align_by_key(truth, preds, "k", "p", "q").collect()}
    assert got == {"a": (0, 0.2), "b": (0, 0.0)}
    long = spark.createDataFrame([("a", "m", "1"), ("a", "m", "0")], "k string, model string, prediction string")
    assert sorted((r.k, r.m_pred) for r in compare_predictions(truth, long, "k", "t", ["m"]).collect()) == [("a", 0), ("b", 0)]


def test_positions_of_text_keys(spark):
    from riskline.operators.evaluate import align_by_position
    from riskline.operators.ranking import add_row_index
    keys = [f"LP{i * 7919 % 100003:06d}" for i in range(3000)]
    truth = spark.createDataFrame([(k,) for k in keys], "Loan_ID string")
    assert [r.Loan_ID for r in add_row_index(truth, "Loan_ID").orderBy("row_index").collect()] == sorted(keys)
    preds = truth.where("Loan_ID < 'LP05'").withColumn("pred", F.lit("Y"))
    got = align_by_position(truth, preds, "Loan_ID", "Loan_ID", ["pred"])
    assert got.count() == 3000 and got.where("pred = 1").count() == preds.count()


def test_detect_columns_query_reads_values(spark):
    from riskline.plans.base import model_outputs
    from riskline.plans.registry import QUERIES
    from tests.conftest import SF_SMALL, needs_testdata
    needs_testdata()
    got = {r["model"]: (r["prediction_column"], r["probability_column"]) for r in QUERIES["detect_columns"](spark, SF_SMALL).collect()}
    for m, (df, pred, prob) in model_outputs(spark, SF_SMALL).items():
        at = df.columns.index
        assert got[m] == (pred, prob)
        assert got[f"{m}_unnamed"] == (f"c{at(pred)}", f"c{at(prob)}" if prob else None)


def test_answers_carry_only_the_fields_they_use(spark, tmp_path):
    """Attributions and other inputs of the log take no part; a decision without outputs is answered as before."""
    from riskline.operators.portfolio import answer_messages
    from riskline.schema import LOG
    from pyspark.sql import functions as F
    empty = spark.createDataFrame([], LOG)
    rows = spark.range(3).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("u"), "id").alias("user_id"),
                                 F.timestamp_seconds("id").alias("timestamp"))
    log = empty.unionByName(rows, allowMissingColumns=True)
    path = str(tmp_path / "log")
    log.write.parquet(path)
    got = answer_messages(spark.createDataFrame([("u1", "how to improve"), ("zz", "how to improve")], "user_id string, text string"), spark.read.schema(LOG).parquet(path))
    assert len({r["answer"] for r in got.collect()}) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "shap_values" not in plan and "recommendations" in plan
