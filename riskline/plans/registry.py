"""The registered queries: name → callable(spark, sf_dir) → DataFrame.

Every query reads the driver tables (through the loan view or directly) and runs
over all of their rows.  Double columns are rounded to 6 digits at the end
(``finish``) so that the DuckDB oracle can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.functions import encode as E
from riskline.functions import rules as R
from riskline.operators import impute as I
from riskline.operators.decide import area_centers, name_segments
from riskline.plans.base import features, finish, loans, scorecard_decisions
from riskline.sources.validate import rejection_reasons

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _map_text(m):
    """map<string,double> → 'k=v;k=v' in insertion order (comparable across engines)."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="),
                                                                        e["value"].cast("string"))), ";")


# --- sources, cleaning, encoding ---------------------------------------------
@query("loans")
def q_loans(spark, d):
    return finish(loans(spark, d))


@query("clean_v1")
def q_clean_v1(spark, d):
    return finish(I.clean_v1(loans(spark, d)))


@query("clean_v2")
def q_clean_v2(spark, d):
    # the cleaning itself, not the prepared copy other queries share
    return finish(I.clean_v2(loans(spark, d), interest_noise_sd=0.0).drop("user_id", "ts"))


@query("encode_strict")
def q_encode_strict(spark, d):
    df = loans(spark, d)
    return df.select("Loan_ID", *[E.encode_strict(c, mp).alias(c) for c, mp in E.V2_MAPS.items()])


@query("encode_passthrough")
def q_encode_passthrough(spark, d):
    df = loans(spark, d)
    return df.select("Loan_ID", *[E.encode_passthrough(c, mp).alias(c) for c, mp in E.V1_MAPS.items()],
                     E.encode_passthrough("Loan_Status", E.LOAN_STATUS).alias("Loan_Status"))


@query("encode_default")
def q_encode_default(spark, d):
    df = loans(spark, d)
    return df.select("Loan_ID", *[E.encode_default(c, E.V2_MAPS[c], dflt).alias(c)
                                  for c, dflt in E.REQUEST_DEFAULTS.items()],
                     E.dependents_to_int("Dependents", 0).alias("Dependents"))


@query("validate")
def q_validate(spark, d):
    df = loans(spark, d)
    r = rejection_reasons(df)
    return df.select("Loan_ID", (F.size(r) == 0).alias("valid"), F.array_join(r, "; ").alias("reasons"))


@query("interest_label")
def q_interest_label(spark, d):
    return finish(features(spark, d).select("Loan_ID", "Credit_History", "LoanAmount", "TotalIncome",
                                            "Interest_Rate"))


@query("clean_fit_transform")
def q_clean_fit_transform(spark, d):
    """Medians of the train part, applied to every row of the offline cleaning."""
    from riskline.plans.base import numeric_v1
    return finish(numeric_v1(spark, d).drop("label"))


# --- decision rules -----------------------------------------------------------
@query("fraud_rules")
def q_fraud_rules(spark, d):
    dec = scorecard_decisions(spark, d)
    return finish(dec.select("Loan_ID", R.scorecard_anomaly().alias("raw_anomaly"), "fraud_score", "fraud_detected"))


@query("risk_score")
def q_risk_score(spark, d):
    return finish(scorecard_decisions(spark, d).select("Loan_ID", "default_probability", "risk_score", "risk_level"))


@query("approve")
def q_approve(spark, d):
    return finish(scorecard_decisions(spark, d).select("Loan_ID", "risk_score", "fraud_detected", "approved"))


@query("recommended_loan")
def q_recommended_loan(spark, d):
    return finish(scorecard_decisions(spark, d).select("Loan_ID", "recommended_loan_amount"))


@query("interest_rate")
def q_interest_rate(spark, d):
    return finish(scorecard_decisions(spark, d).select("Loan_ID", "risk_level", "predicted_interest_rate"))


@query("recommendations")
def q_recommendations(spark, d):
    dec = scorecard_decisions(spark, d)
    return dec.select("Loan_ID", F.size("recommendations").alias("n_recommendations"),
                      F.array_join("recommendations", " | ").alias("recommendations"))


@query("gauges")
def q_gauges(spark, d):
    return finish(scorecard_decisions(spark, d).select("Loan_ID", *R.gauge_values()))


@query("segment_names")
def q_segment_names(spark, d):
    c = area_centers(features(spark, d))
    return finish(c.join(name_segments(c), "cluster"))


@query("rule_attributions")
def q_rule_attributions(spark, d):
    return scorecard_decisions(spark, d).select("Loan_ID", _map_text("shap_values").alias("attributions"))


@query("top_contributions")
def q_top_contributions(spark, d):
    from riskline.operators.attribution import top_contributions
    dec = scorecard_decisions(spark, d)
    return dec.select("Loan_ID", _map_text(top_contributions("shap_values", 6)).alias("top6"))


@query("global_importance")
def q_global_importance(spark, d):
    from riskline.operators.attribution import global_importance
    return finish(global_importance(scorecard_decisions(spark, d), "shap_values"))


@query("kpis")
def q_kpis(spark, d):
    from riskline.operators.portfolio import portfolio_kpis
    return finish(portfolio_kpis(scorecard_decisions(spark, d)))


@query("kpis_by_area")
def q_kpis_by_area(spark, d):
    from riskline.operators.portfolio import portfolio_kpis
    f = scorecard_decisions(spark, d).withColumn("area", F.col("Property_Area").cast("int"))
    return finish(portfolio_kpis(f, by=["area"]))


# --- profiles -------------------------------------------------------------------
CAT_COLS = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "Property_Area"]
# every numeric column of the cleaned frame
HIST_COLS = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "ApplicantIncome", "CoapplicantIncome",
             "LoanAmount", "Loan_Amount_Term", "Credit_History", "Property_Area", "TotalIncome", "LoanAmount_log",
             "Debt_to_Income"]
BOX_COLS = ["ApplicantIncome", "CoapplicantIncome", "LoanAmount", "TotalIncome"]
DEMO_COLS = ["ApplicantIncome", "CoapplicantIncome", "TotalIncome", "LoanAmount", "LoanAmount_log"]


def cleaned_v1(spark, d):
    from riskline.plans.base import prepared
    return prepared(spark, d, "clean_v1", lambda: I.clean_v1(loans(spark, d)))


@query("value_counts")
def q_value_counts(spark, d):
    from riskline.operators.profile import value_counts
    return value_counts(loans(spark, d), CAT_COLS)


@query("missing_table")
def q_missing_table(spark, d):
    from riskline.operators.profile import missing_table
    return missing_table(loans(spark, d))


@query("missing_mask")
def q_missing_mask(spark, d):
    from riskline.operators.profile import missing_mask
    return missing_mask(loans(spark, d), "Loan_ID")


@query("sample_uniques")
def q_sample_uniques(spark, d):
    from riskline.operators.profile import sample_uniques
    return sample_uniques(loans(spark, d), CAT_COLS, "Loan_ID")


@query("histogram20")
def q_histogram20(spark, d):
    from riskline.operators.profile import histogram
    return finish(histogram(features(spark, d), HIST_COLS, 20))


@query("box_stats")
def q_box_stats(spark, d):
    from riskline.operators.profile import box_stats
    return finish(box_stats(cleaned_v1(spark, d), BOX_COLS))


@query("correlation")
def q_correlation(spark, d):
    from riskline.operators.profile import correlation
    from riskline.schema import FEATURES
    return finish(correlation(features(spark, d), FEATURES))


@query("preview")
def q_preview(spark, d):
    from riskline.operators.profile import preview
    return finish(preview(cleaned_v1(spark, d), DEMO_COLS, "Loan_ID", 10))


# --- evaluation -----------------------------------------------------------------
@query("align_key")
def q_align_key(spark, d):
    from riskline.operators.evaluate import align_by_key
    from riskline.plans.base import model_outputs, truth
    df, pc, prob = model_outputs(spark, d)["logistic"]
    return finish(align_by_key(truth(spark, d), df, "Loan_ID", pc, prob))


@query("align_position")
def q_align_position(spark, d):
    from riskline.operators.evaluate import align_by_position
    from riskline.plans.base import model_outputs, truth
    df, pc, _ = model_outputs(spark, d)["random_forest"]
    return align_by_position(truth(spark, d), df, "Loan_ID", "Loan_ID", [pc])


@query("compare_predictions")
def q_compare_predictions(spark, d):
    from riskline.operators.evaluate import compare_predictions
    from riskline.plans.base import MODELS, predictions_long, truth
    return compare_predictions(truth(spark, d), predictions_long(spark, d), "Loan_ID", "Loan_Status", MODELS)


@query("confusion")
def q_confusion(spark, d):
    from riskline.operators.evaluate import confusion_matrix
    from riskline.plans.base import evaluation_long
    return confusion_matrix(evaluation_long(spark, d))


@query("metrics_summary")
def q_metrics_summary(spark, d):
    from riskline.operators.evaluate import metrics_summary
    from riskline.plans.base import evaluation_long
    return finish(metrics_summary(evaluation_long(spark, d)))


@query("roc_auc")
def q_roc_auc(spark, d):
    from riskline.operators.evaluate import roc_auc
    from riskline.plans.base import evaluation_long
    return finish(roc_auc(evaluation_long(spark, d)))


@query("roc_curve")
def q_roc_curve(spark, d):
    from riskline.operators.evaluate import roc_curve
    from riskline.plans.base import evaluation_long
    return finish(roc_curve(evaluation_long(spark, d)))


@query("model_report")
def q_model_report(spark, d):
    from riskline.operators.evaluate import model_report
    from riskline.plans.base import evaluation_long, features
    n = features(spark, d).count()
    return finish(model_report(evaluation_long(spark, d), expected_rows=n))


@query("rmse")
def q_rmse(spark, d):
    from riskline.operators.evaluate import rmse
    return finish(rmse(scorecard_decisions(spark, d), "Interest_Rate", "predicted_interest_rate", ["risk_level"]))


@query("label_agreement")
def q_label_agreement(spark, d):
    """A8/A9 on the driver's ``labels`` table: quality as truth, not-toxic as prediction."""
    from pyspark.sql import functions as F2
    from riskline.operators.evaluate import classification_metrics
    lab = spark.read.parquet(f"{d.rstrip('/')}/labels.parquet").select(
        F2.col("quality").alias("label"), (F2.lit(1) - F2.col("toxic")).alias("prediction"))
    return finish(classification_metrics(lab, by=()))


@query("detect_columns")
def q_detect_columns(spark, d):
    """A14/A15 over the four prediction tables, and over the same tables under names that tell nothing,
    whose columns are found by all rows' values: the detected column names."""
    from riskline.operators.evaluate import detect_prediction_column, detect_probability_column
    from riskline.plans.base import model_outputs
    rows = []
    for m, (df, _, _) in model_outputs(spark, d).items():
        rows.append((m, detect_prediction_column(df), detect_probability_column(df)))
        plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        found = detect_prediction_column(plain)
        rows.append((f"{m}_unnamed", found, detect_probability_column(plain, fallback=True, exclude=("c0", found))))
    return spark.createDataFrame(rows, "model string, prediction_column string, probability_column string")


# --- decision log and portfolio --------------------------------------------------------
def _ts(c="timestamp"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("decision_log")
def q_decision_log(spark, d):
    from riskline.plans.base import log_table
    log = log_table(spark, d)
    return finish(log.select("id", "user_id", _ts(), F.col("month").cast("string").alias("month"),
                             F.col("outputs.approved").alias("approved"), F.col("outputs.risk_score").alias("risk_score"),
                             F.col("outputs.risk_level").alias("risk_level"),
                             F.col("outputs.segment_name").alias("segment_name"),
                             F.size("outputs.recommendations").alias("n_recommendations"),
                             F.col("inputs.Dependents").alias("dependents_text")))


@query("log_kpis")
def q_log_kpis(spark, d):
    from riskline.operators.portfolio import portfolio_kpis
    from riskline.plans.base import log_table
    return finish(portfolio_kpis(log_table(spark, d)))


@query("user_history")
def q_user_history(spark, d):
    from riskline.operators.portfolio import busiest_user, user_history
    from riskline.plans.base import log_table
    log = log_table(spark, d)
    h = user_history(log, busiest_user(log))
    return finish(h.select("id", "user_id", _ts(), F.col("outputs.risk_score").alias("risk_score"),
                           F.col("outputs.approved").alias("approved")))


@query("all_history")
def q_all_history(spark, d):
    from riskline.operators.portfolio import all_history
    from riskline.plans.base import log_table
    h = all_history(log_table(spark, d))
    return finish(h.select("id", "user_id", _ts(), F.col("outputs.risk_level").alias("risk_level"),
                           F.col("outputs.approved").alias("approved")))


@query("history_view")
def q_history_view(spark, d):
    from riskline.operators.portfolio import history_view
    from riskline.plans.base import log_table
    return history_view(log_table(spark, d))


@query("segment_points")
def q_segment_points(spark, d):
    """R12 + U1: every logged application's point, plus one mean point per display
    segment, concatenated by name."""
    from riskline.operators.portfolio import segment_points, union_by_name
    from riskline.plans.base import log_table
    pts = segment_points(log_table(spark, d)).withColumn("kind", F.lit("application"))
    centres = pts.groupBy("cluster").agg(F.avg("income").alias("income"), F.avg("loan_amount").alias("loan_amount"))
    return finish(union_by_name(pts, centres.withColumn("kind", F.lit("centre"))))


@query("answers")
def q_answers(spark, d):
    """Rule answers to every user message of ``conversations`` (conv_id as the user)."""
    from riskline.operators.portfolio import answer_messages
    from riskline.plans.base import log_table
    msgs = (spark.read.parquet(f"{d.rstrip('/')}/conversations.parquet")
            .where(F.col("role") == "user").select(F.col("conv_id").cast("string").alias("user_id"), "turn", "text"))
    return answer_messages(msgs, log_table(spark, d)).drop("text")


# --- splits, scaling, models ------------------------------------------------------------
@query("stratified_split")
def q_stratified_split(spark, d):
    from riskline.operators.models import stratified_split
    f = features(spark, d).select("Loan_ID", F.col("Loan_Status_encoded").alias("label"))
    return stratified_split(f, "label", "Loan_ID", 0.2, 42)


@query("random_split")
def q_random_split(spark, d):
    from riskline.operators.models import random_split
    return random_split(features(spark, d).select("Loan_ID"), "Loan_ID", 0.2, 42)


@query("standardize")
def q_standardize(spark, d):
    from riskline.operators.models import SEGMENT_INPUTS, standardize
    z = standardize(features(spark, d).select("Loan_ID", *SEGMENT_INPUTS), SEGMENT_INPUTS, suffix="_z")
    return finish(z.select("Loan_ID", *[f"{c}_z" for c in SEGMENT_INPUTS]))


def _labelled(spark, d):
    from riskline.operators.models import assemble
    f = features(spark, d).where(F.col("Loan_Status_encoded").isNotNull())
    return assemble(f.withColumn("label", F.col("Loan_Status_encoded").cast("double")))


@query("gaussian_nb")
def q_gaussian_nb(spark, d):
    """T5 fitted on every labelled application, applied to the same rows (as the
    reference labels its training file)."""
    from riskline.operators.models import fit_gaussian_nb
    x = _labelled(spark, d)
    m = fit_gaussian_nb(x, "label")
    return m.transform(x).select("Loan_ID", F.col("prediction").cast("int").alias("prediction"))


@query("logistic")
def q_logistic(spark, d):
    """T4 on standardised features (T3), C = 1; probability and Y/N label per row."""
    from riskline.operators.models import assemble, fit_logistic, positive_probability, standardize
    from riskline.schema import FEATURES
    f = features(spark, d).where(F.col("Loan_Status_encoded").isNotNull())
    z = standardize(f, FEATURES)
    x = assemble(z.withColumn("label", F.col("Loan_Status_encoded").cast("double")))
    m = fit_logistic(x, "label", f.count())
    p = m.transform(x).withColumn("Logistic_Prob", positive_probability())
    return finish(p.select("Loan_ID", "Logistic_Prob", E.label_yn(E.threshold("Logistic_Prob")).alias("Logistic_Predicted")))


@query("decision_tree")
def q_decision_tree(spark, d):
    """T6 fitted on every labelled application, applied to the same rows."""
    from riskline.operators.tree import fit_tree
    from riskline.schema import FEATURES
    f = features(spark, d).where(F.col("Loan_Status_encoded").isNotNull())
    return f.select("Loan_ID", E.label_yn(fit_tree(f, "Loan_Status_encoded", FEATURES).prediction()).alias("DT_Predicted"))


@query("random_forest")
def q_random_forest(spark, d):
    """Fitted on the stratified 80 % (seed 42, forest seed 22), applied to every
    row; ``split`` says which rows were fitted (D-3)."""
    from riskline.operators import forest
    from riskline.operators.models import stratified_split
    from riskline.plans.base import prepared, spread
    from riskline.schema import FEATURES
    f = features(spark, d).where(F.col("Loan_Status_encoded").isNotNull()).select("Loan_ID", "Loan_Status_encoded", *FEATURES)
    x = prepared(spark, d, "forest-split", lambda: stratified_split(f, "Loan_Status_encoded", "Loan_ID", 0.2, 42))
    m = forest.fit_forest(x.where(F.col("split") == "train"), "Loan_Status_encoded", FEATURES, "Loan_ID", seed=22)
    p = spread(x, x).withColumn("RF_Prob", forest.predicted(spark, m))
    return finish(p.select("Loan_ID", "split", "RF_Prob", E.label_yn(E.threshold("RF_Prob")).alias("RF_Predicted")))


# the v1 pipeline: cleaning → I3 → T4–T7 → J3, A9–A12, A20 on what the fitted models predict
@query("v1_predictions")
def q_v1_predictions(spark, d):
    from riskline.plans.base import baseline_predictions
    return finish(baseline_predictions(spark, d))


@query("v1_comparison")
def q_v1_comparison(spark, d):
    from riskline.operators.evaluate import compare_predictions
    from riskline.plans.base import MODELS, baseline_long, baseline_predictions
    labels = baseline_predictions(spark, d).select("Loan_ID", F.col("label").alias("Loan_Status"))
    return compare_predictions(labels, baseline_long(spark, d, binary=False), "Loan_ID", "Loan_Status", MODELS)


@query("v1_summary")
def q_v1_summary(spark, d):
    from riskline.operators.evaluate import metrics_summary
    from riskline.plans.base import baseline_long
    return finish(metrics_summary(baseline_long(spark, d)))


@query("v1_report")
def q_v1_report(spark, d):
    from riskline.operators.evaluate import model_report
    from riskline.plans.base import baseline_long, baseline_predictions
    return finish(model_report(baseline_long(spark, d), expected_rows=baseline_predictions(spark, d).count()))


@query("v1_roc")
def q_v1_roc(spark, d):
    from riskline.operators.evaluate import roc_curve
    from riskline.plans.base import baseline_long
    return finish(roc_curve(baseline_long(spark, d)))


@query("approval")
def q_approval(spark, d):
    from riskline.operators import training as T
    from riskline.plans.base import applications, trained
    m = trained(spark, d)
    x = T.with_risk(T.with_approval(applications(spark, d), m), m)
    return x.select("Loan_ID", "approval_pred", R.approved("approval_pred").alias("approved"))


@query("default_pd")
def q_default_pd(spark, d):
    from riskline.operators import training as T
    from riskline.plans.base import applications, trained
    x = T.with_risk(applications(spark, d), trained(spark, d))
    return finish(x.select("Loan_ID", "default_probability", "risk_score", "risk_level"))


@query("interest_rf")
def q_interest_rf(spark, d):
    from riskline.operators import training as T
    from riskline.plans.base import applications, trained
    m = trained(spark, d)
    x = T.with_interest(T.with_risk(applications(spark, d), m), m)
    return finish(x.select("Loan_ID", "interest_pred", R.interest_rate("interest_pred").alias("predicted_interest_rate")))


@query("segments")
def q_segments(spark, d):
    from riskline.operators import training as T
    from riskline.plans.base import trained
    x = T.with_segment(features(spark, d, noise_sd=0.2), trained(spark, d))
    return x.select("Loan_ID", "segment_cluster", "segment_name")


@query("isolation_forest")
def q_isolation_forest(spark, d):
    from riskline.operators import training as T
    from riskline.plans.base import applications, trained
    x = T.with_anomaly(applications(spark, d), trained(spark, d))
    return finish(x.select("Loan_ID", "raw_anomaly", "fraud_score", "fraud_detected"))


@query("score")
def q_score(spark, d):
    """Every model and rule over every application, with the approval forest's attributions."""
    from riskline.plans.base import scored
    s = scored(spark, d)
    return finish(s.select("Loan_ID", "approved", "risk_score", "risk_level", "default_probability", "fraud_score",
                           "fraud_detected", "recommended_loan_amount", "predicted_interest_rate",
                           F.array_join("recommendations", " | ").alias("recommendations"),
                           _map_text("shap_values").alias("attributions"), "segment_cluster", "segment_name"))


@query("tree_attributions")
def q_tree_attributions(spark, d):
    """TreeSHAP of the approval forest that decides for every application, with the
    additivity residual |Σφ + E[f] − P(approve)|."""
    from riskline.operators import training as T
    from riskline.plans.base import NEAR, applications, trained
    m = trained(spark, d)
    s = T.with_attributions(T.with_approval(applications(spark, d, NEAR), m), m)
    total = F.aggregate(F.map_values("shap_values"), F.lit(0.0), lambda a, b: a + b)
    return finish(s.select("Loan_ID", _map_text("shap_values").alias("attributions"),
                           F.abs(total + F.col("shap_values_expected") - F.col("approval_probability"))
                           .alias("additivity_residual")))


def requests(spark, d):
    """Scoring requests: the applications, some with values no map knows, odd dependents or terms ≤ 0."""
    df, k = loans(spark, d), F.col("Loan_ID")
    return (df.withColumn("Property_Area", F.when(k % 11 == 0, F.lit("Coast")).otherwise(F.col("Property_Area")))
              .withColumn("Married", F.when(k % 23 == 0, F.lit("Unknown")).otherwise(F.col("Married")))
              .withColumn("Dependents", F.when(k % 13 == 0, F.lit("3 +")).when(k % 29 == 0, F.lit(" 2 ")).otherwise(F.col("Dependents")))
              .withColumn("Loan_Amount_Term", F.when(k % 17 == 0, F.lit(0.0)).when(k % 31 == 0, F.lit(-12.0))
                          .otherwise(F.col("Loan_Amount_Term"))))


@query("request_features")
def q_request_features(spark, d):
    """T18's input for raw requests (P3, P5, P10 in request form)."""
    return finish(I.request_features(requests(spark, d)).drop("user_id", "ts"))


@query("score_requests")
def q_score_requests(spark, d):
    """T18 from raw requests with the fitted models."""
    from riskline.operators.training import score_requests
    from riskline.plans.base import spread, trained
    s = score_requests(spread(requests(spark, d), spark.read.parquet(f"{d.rstrip('/')}/orders.parquet")), trained(spark, d))
    return finish(s.select("Loan_ID", "approved", "risk_score", "risk_level", "default_probability", "fraud_score",
                           "recommended_loan_amount", "predicted_interest_rate", _map_text("shap_values").alias("attributions"), "segment_name"))


@query("score_stream_models")
def q_score_stream_models(spark, d):
    """ST1 with the fitted models: the orders stream as raw requests, every decision column logged."""
    from riskline.operators.training import score_requests
    from riskline.plans.base import trained
    from riskline.streaming import application_stream, score_stream
    models, cores = trained(spark, d), spark.sparkContext.defaultParallelism
    # a micro-batch is dealt to all cores: its attributions cost far more than moving its rows
    out = _streamed(spark, d, "score-stream-models",
                    lambda sink, ck: score_stream(application_stream(spark, d).repartition(cores), lambda x: score_requests(x, models), sink, ck))
    return finish(out.select("Loan_ID", "approved", "risk_score", "default_probability", "predicted_interest_rate",
                             F.array_join("recommendations", " | ").alias("recommendations"),
                             _map_text("shap_values").alias("attributions"), "segment_name"))


@query("runs_view")
def q_runs_view(spark, d):
    """S6 → S5 → R10: the training run appended to a run log, read back, displayed."""
    from riskline.operators.portfolio import runs_view
    from riskline.operators.training import run_row
    from riskline.plans.base import prepared, trained
    from riskline.session import scratch_path
    from riskline.sources.io import append_run, read_runs

    def build():
        path = scratch_path(spark, "runs")
        append_run(run_row(spark, trained(spark, d)), path)
        return read_runs(spark, path)
    return runs_view(prepared(spark, d, "runs", build, write=False))


# --- streaming --------------------------------------------------------------------------
_FITTED: dict = {}


def _stream_decisions(spark, d):
    """Decisions of the orders stream; the cleaner (one row of statistics) and the
    k-row segment names are fitted on the table once per session."""
    from riskline.operators.impute import CleanV2Model
    from riskline.plans.base import prepared, scorecard_decide, segment_names_for
    from riskline.streaming import application_stream
    key = (spark.sparkContext.applicationId, d.rstrip("/"))
    if key not in _FITTED:
        _FITTED[key] = CleanV2Model.fit(loans(spark, d))
    names = prepared(spark, d, "segment-names", lambda: segment_names_for(features(spark, d)))
    return scorecard_decide(_FITTED[key].transform(application_stream(spark, d)), names)


def _streamed(spark, d, name, start):
    from riskline.plans.base import prepared
    from riskline.session import scratch_path
    from riskline.streaming.scoring import run_to_end

    def build():
        sink, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
        run_to_end(start(sink, ck))
        return spark.read.parquet(sink)
    return prepared(spark, d, name, build, write=False)


@query("score_stream")
def q_score_stream(spark, d):
    """ST1: the orders stream scored and appended; equals the batch decisions."""
    from riskline.streaming import score_stream
    out = _streamed(spark, d, "score-stream",
                    lambda sink, ck: score_stream(_stream_decisions(spark, d), lambda x: x, sink, ck))
    return finish(out.select("Loan_ID", "default_probability", "risk_score", "risk_level", "approved",
                             "recommended_loan_amount", "predicted_interest_rate", "segment_name",
                             F.array_join("recommendations", " | ").alias("recommendations"),
                             F.size("shap_values").alias("n_attributions")))


@query("kpi_stream")
def q_kpi_stream(spark, d):
    """ST2 (complete mode) per property area; equals the batch KPIs."""
    from riskline.streaming import kpi_stream
    out = _streamed(spark, d, "kpi-stream",
                    lambda sink, ck: kpi_stream(_stream_decisions(spark, d).withColumn(
                        "area", F.col("Property_Area").cast("int")), sink, ck, by=["area"]))
    return finish(out)


@query("kpi_stream_windowed")
def q_kpi_stream_windowed(spark, d):
    """ST2 with 30-day event-time windows and a 60-day watermark (append mode):
    the windows the watermark has closed."""
    from riskline.streaming import windowed_kpi_stream
    out = _streamed(spark, d, "kpi-window-stream",
                    lambda sink, ck: windowed_kpi_stream(_stream_decisions(spark, d), "ts", sink, ck))
    return finish(out.select("window_start", "window_end", "total_applications", "approval_rate_pct",
                             "avg_default_pct", "fraud_flags"))


@query("feature_importance")
def q_feature_importance(spark, d):
    """T17 (model side): the approval forest's impurity importances beside the mean
    |TreeSHAP| contribution would be the dashboard's global chart; the importances
    are read from the fitted model (one value per feature)."""
    from riskline.plans.base import trained
    from riskline.schema import FEATURES
    imp = trained(spark, d).approval.importances()
    rows = sorted(zip(FEATURES, map(float, imp)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")
