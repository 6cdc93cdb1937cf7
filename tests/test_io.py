"""Readers and writers (S1, S2, S4–S8) and the run view (R10) on the reference's run file."""

from pyspark.sql import functions as F

from riskline.operators.portfolio import runs_view
from riskline.sources import io as IO
from tests.conftest import reference_file

CSV = """Loan_ID,Gender,Married,Dependents,Education,Self_Employed,ApplicantIncome,CoapplicantIncome,LoanAmount,Loan_Amount_Term,Credit_History,Property_Area,Loan_Status
LP1,Female,No,2,Graduate,Yes,4100,250,87,180,0,Rural,N
LP2,Female,No,3+,Graduate,,2222,1111,,240,1,Semiurban,Y
LP3,Male,No,1,Not Graduate,No,not-a-number,40,95,120,1,Urban,Y
"""


def test_read_applications_and_rejects(spark, tmp_path):
    p = tmp_path / "apps.csv"
    p.write_text(CSV)
    good, bad = IO.read_with_rejects(spark, str(p))
    assert sorted(r["Loan_ID"] for r in good.collect()) == ["LP1", "LP2"]
    assert bad.count() == 1 and "not-a-number" in bad.first()["_corrupt_record"]
    r = {x["Loan_ID"]: x for x in IO.read_applications(spark, str(p)).collect()}
    assert r["LP2"]["LoanAmount"] is None and r["LP2"]["Self_Employed"] is None
    missing_good, missing_bad = IO.read_with_rejects(spark, str(tmp_path / "absent.csv"))
    assert missing_good.count() == 0 and missing_bad.count() == 0


def test_columns_come_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    lines = [x.split(",") for x in CSV.splitlines()]
    order = [6, 0, 12, 7, 2, 1, 3, 4, 5, 8, 9, 10, 11]
    (tmp_path / "b.csv").write_text("\n".join(",".join(x[k] for k in order) for x in lines) + "\n")
    a, b = (sorted(map(tuple, IO.read_applications(spark, str(tmp_path / f)).collect()), key=str) for f in ("a.csv", "b.csv"))
    assert a == b and a[0][6:9] == (4100.0, 250.0, 87.0)
    (tmp_path / "c.csv").write_text("Loan_ID,LoanAmount\nLP9,12\nLP8,\n")
    good, bad = IO.read_with_rejects(spark, str(tmp_path / "c.csv"))
    assert bad.count() == 0 and {(r.Loan_ID, r.LoanAmount, r.Loan_Status) for r in good.collect()} == {("LP9", 12.0, None), ("LP8", None, None)}


def test_unlabelled_reference_file_has_no_rejects(spark):
    good, bad = IO.read_with_rejects(spark, str(reference_file("test.csv")))
    assert (good.count(), bad.count()) == (367, 0)


def test_every_run_of_a_file_is_read(spark, tmp_path):
    run = '{"run_name": "r%d", "metrics": {"default_auc": 0.5}}'
    (tmp_path / "runs.json").write_text("\n".join(run % i for i in range(3)) + "\n")
    (tmp_path / "array.json").write_text("[\n" + ",\n".join(run % i for i in range(3, 5)) + "\n]\n")
    (tmp_path / "line.json").write_text("[" + ", ".join(run % i for i in range(5, 7)) + "]")
    assert {r.run_name for r in IO.read_runs(spark, str(tmp_path)).collect()} == {f"r{i}" for i in range(7)}


def test_write_table_csv_has_header_and_no_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    IO.write_table(df, str(tmp_path / "out"), fmt="csv")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.splitlines()[0] == "x,y"


def test_run_log_roundtrip_and_reference_history(spark, tmp_path):
    hist = reference_file("backend/experiment_history.json")
    runs = IO.read_runs(spark, str(hist))
    assert runs.count() == 1
    view = runs_view(runs).first()
    assert view["approval_accuracy"] == "87.0%" and view["default_auc"] == "0.520"
    assert view["interest_rmse"] == "1.92%" and view["silhouette"] == "0.683" and view["estimators"] == 100
    IO.append_run(runs, str(tmp_path / "runs"))
    IO.append_run(runs, str(tmp_path / "runs"))
    assert IO.read_runs(spark, str(tmp_path / "runs")).count() == 2
    assert IO.read_runs(spark, str(tmp_path / "nothing")).count() == 0


def test_save_and_load_models(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel
    from riskline.operators import models as M
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"),
                                 (F.col("id") % 2).cast("double").alias("y"))
    x = M.assemble(df, ["a"])
    m = M.fit_logistic(x, "y", 200, max_iter=50)
    IO.save_models({"lr": m}, ["a"], str(tmp_path / "m"), spark)
    loaded, feats = IO.load_models(spark, str(tmp_path / "m"), {"lr": LogisticRegressionModel})
    assert feats == ["a"]
    assert loaded["lr"].transform(x).select("prediction").collect() == m.transform(x).select("prediction").collect()


def test_decision_log_append_and_prune(spark, tmp_path):
    from riskline.schema import DECISION, INPUT_COLUMNS
    rows = [(f"{i}", f"u{i % 3}" if i != 5 else "", f"2024-0{1 + i % 3}-15 10:00:00", 0.5 + i / 100) for i in range(9)]
    d = spark.createDataFrame(rows, "Loan_ID string, user_id string, ts string, risk_score double")
    d = d.withColumn("inputs", F.struct(*[F.lit(None).cast("string").alias(c) for c in INPUT_COLUMNS]))
    log = IO.decision_log(d)
    assert [f.name for f in log.schema["outputs"].dataType.fields] == [f.name for f in DECISION.fields]
    IO.append_decisions(log, str(tmp_path / "log"))
    back = IO.read_log(spark, str(tmp_path / "log"))
    assert back.count() == 8  # the row without a user is not logged
    assert back.where(F.col("month") == F.lit("2024-02-01").cast("date")).count() == 3


def test_log_files_hold_a_bloom_filter_of_the_users(spark, tmp_path):
    from riskline.schema import INPUT_COLUMNS
    # more users than a dictionary page holds: the file cannot answer by its dictionary
    d = spark.range(120_000, numPartitions=1).select(
        F.col("id").cast("string").alias("Loan_ID"), F.md5(F.col("id").cast("string")).alias("user_id"),
        F.lit("2024-01-15 10:00:00").alias("ts"), F.lit(0.5).alias("risk_score"),
        F.struct(*[F.lit(None).cast("string").alias(c) for c in INPUT_COLUMNS]).alias("inputs"))
    path = tmp_path / "log"
    IO.append_decisions(IO.decision_log(d).coalesce(1), str(path))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for f in path.rglob("*.parquet"):
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(f)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        columns = list(reader.getFooter().getBlocks().get(0).getColumns())
        offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in columns}
        reader.close()
        assert offsets["user_id"] > 0 and offsets["id"] <= 0
    one = IO.read_log(spark, str(path)).where(F.col("user_id") == "cfcd208495d565ef66e7dff9f98764da")
    assert [r["id"] for r in one.select("id").collect()] == ["0"]


def test_appending_computes_the_decisions_once(spark, tmp_path):
    """The log's partitioning takes no sample, for which every decision would be computed again."""
    from riskline.sources import io as IO
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x
    once = F.udf(count, "double").asNondeterministic()
    log = spark.range(400, numPartitions=4).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("user_id"),
        F.timestamp_seconds(F.col("id") * 86400).alias("timestamp"), once(F.col("id").cast("double")).alias("v"))
    IO.append_decisions(log, str(tmp_path / "log"))
    assert seen.value == 400
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 400 and back.select("month").distinct().count() == 14
