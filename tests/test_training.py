"""v2 training and batch scoring end to end on the smallest driver tables."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, needs_testdata


def test_train_and_score(spark, tmp_path):
    needs_testdata()
    from riskline.operators.impute import clean_v2
    from riskline.operators.training import run_row, score, train
    from riskline.sources.io import append_run, read_runs
    from riskline.sources.loans import loan_view

    feats = clean_v2(loan_view(spark, SF_SMALL), interest_noise_sd=0.2, keep_inputs=True).cache()
    m = train(spark, feats, trees=10, n_init=2, iso_trees=20, iso_samples=64)
    # one split for all targets: the interest forest learns its label up to the noise
    assert "approval" not in vars(m)
    assert 0.5 < m.metrics["approval_accuracy"] <= 1.0
    assert m.metrics["default_auc"] > 0.6
    assert m.metrics["interest_rate_rmse"] < 1.0
    assert -1.0 <= m.metrics["segmentation_silhouette"] <= 1.0

    s = score(feats, m).cache()
    assert s.count() == feats.count()
    bad = s.where(~F.col("risk_level").isin("Low Risk", "Medium Risk", "High Risk")
                  | ~F.col("risk_score").between(0, 100) | ~F.col("fraud_score").between(0, 1)
                  | ~F.col("predicted_interest_rate").between(6.5, 18) | F.col("segment_name").isNull()
                  | (F.col("approved") & (F.col("risk_score") >= 65)))
    assert bad.count() == 0
    assert s.select("segment_name").distinct().count() <= 3

    # saved, loaded and applied again: equal scores
    from riskline.operators.training import load_trained, save_trained, score_requests
    save_trained(m, str(tmp_path / "models"), spark)
    again = load_trained(spark, str(tmp_path / "models"))
    cols = ["Loan_ID", "risk_score", "fraud_score", "predicted_interest_rate", "segment_cluster", "segment_name", "approved"]
    assert sorted(map(tuple, score(feats, again).select(cols).collect())) == sorted(map(tuple, s.select(cols).collect()))
    assert again.params == m.params and again.metrics == m.metrics

    # a request that no map knows is scored like any other; a stream equals the table
    apps = loan_view(spark, SF_SMALL)
    odd = apps.limit(50).withColumn("Property_Area", F.lit("Moon")).withColumn("Loan_Amount_Term", F.lit(-12.0)).withColumn(
        "Dependents", F.lit(None).cast("string")).withColumn("LoanAmount", F.lit(None).cast("double"))
    got = score_requests(odd, again).collect()
    assert len(got) == 50 and all(r["risk_level"] and r["segment_name"] and r["Debt_to_Income"] >= 0 for r in got)
    from riskline.streaming import application_stream, score_stream
    from riskline.streaming.scoring import run_to_end
    run_to_end(score_stream(application_stream(spark, SF_SMALL), lambda x: score_requests(x, again),
                            str(tmp_path / "sink"), str(tmp_path / "ck")))
    streamed = spark.read.parquet(str(tmp_path / "sink"))
    assert {"recommendations", "shap_values"} <= set(streamed.columns)
    table = score_requests(apps, again)
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, table.select(cols).collect()))

    append_run(run_row(spark, m), str(tmp_path / "runs"))
    r = read_runs(spark, str(tmp_path / "runs")).first()
    assert r["parameters"]["rf_estimators"] == 10 and r["metrics"]["default_auc"] == m.metrics["default_auc"]


def test_attributions_are_those_of_the_forest_that_decides(spark):
    needs_testdata()
    from riskline.operators.impute import clean_v2
    from riskline.operators.training import score, train
    from riskline.sources.loans import loan_view

    feats = clean_v2(loan_view(spark, SF_SMALL), interest_noise_sd=0.2, keep_inputs=True)
    m = train(spark, feats, trees=3, n_init=1, iso_trees=5, iso_samples=32)
    assert not {"approval", "default", "interest", "fraud", "segments"} & set(vars(m))  # nothing is fitted unasked
    total = F.aggregate(F.map_values("shap_values"), F.lit(0.0), lambda a, b: a + b) + F.col("shap_values_expected")
    residual = F.abs(total - F.col("approval_probability"))
    assert score(feats.limit(40), m).agg(F.max(residual)).first()[0] < 1e-9
    assert "metrics" not in vars(m) and max(m.approval.depths()) > 8
    rules = score(feats.limit(40), m, explain="rules")
    assert "shap_values_expected" not in rules.columns and rules.where("shap_values['Credit_History'] IN (0.45, -0.55)").count() == 40


def test_spread_deals_rows_not_parts(spark, tmp_path):
    """A file of one row group is scanned in several parts of which one holds every row."""
    from riskline.plans import base

    path = str(tmp_path / "one")
    spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"),
                               F.xxhash64("id").alias("b")).coalesce(1).write.parquet(path)
    with_parts = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    before = {c: spark.conf.get(c) for c in with_parts}
    try:
        for c, v in with_parts.items():
            spark.conf.set(c, v)
        x = spark.read.parquet(path)
        assert x.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
        for near in ((), ("a", "k")):
            dealt = base.spread(x, x, near)
            held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
            assert len(held) == spark.sparkContext.defaultParallelism and max(held) < 13_000 and sum(held) == 40_000
        assert base.spread(x, x, ("a", "k")).groupBy(F.spark_partition_id()).agg(F.max("a") - F.min("a")).agg(F.max(F.col("(max(a) - min(a))"))).first()[0] < 4
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
