"""Column expressions: encoders, normalisers, features and decision rules."""

import math

import pytest
from pyspark.sql import functions as F

from riskline.functions import encode as E
from riskline.functions import features as X
from riskline.functions import rules as R


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


TOKENS = [None, "", "y", " Yes ", "T", "TRUE", "n", "false", "1", "1.0", "0.49", "0.5", "nan", "abc", "1d"]


@pytest.mark.parametrize("mode,expected", [
    ("null", [None, None, 1, 1, 1, 1, 0, 0, 1, 1, 0, 1, 0, None, None]),
    ("zero", [0, 0, 1, 1, 1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 0]),
    ("truth", [0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0]),
])
def test_normalize_binary_token_table(spark, mode, expected):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TOKENS)], "i int, v string")
    got = [r["r"] for r in df.select("i", E.normalize_binary("v", mode).alias("r")).orderBy("i").collect()]
    assert got == expected


@pytest.mark.parametrize("text,expected", [("0", 0.0), ("2", 2.0), ("3+", 3.0), ("3 +", 3.0), (None, 0.0), ("x", 0.0)])
def test_dependents(spark, text, expected):
    assert one(spark, E.dependents_to_number("v", 0.0), text) == expected


@pytest.mark.parametrize("text,expected", [("1_0", 10.0), ("1d", None), (" 2.5 ", 2.5), ("1e3", 1000.0), ("abc", None)])
def test_to_numeric_follows_python_float(spark, text, expected):
    assert one(spark, E.to_numeric("v"), text) == expected


def test_encoders(spark):
    df = spark.createDataFrame([("Male",), ("Female",), ("Unknown",), ("x",), (None,)], "v string")
    strict = [r[0] for r in df.select(E.encode_strict("v", E.GENDER)).collect()]
    passthrough = [r[0] for r in df.select(E.encode_passthrough("v", E.GENDER)).collect()]
    default = [r[0] for r in df.select(E.encode_default("v", E.V2_MAPS["Gender"], 1)).collect()]
    assert strict == [1, 0, None, None, None]
    assert passthrough == ["1", "0", "Unknown", "x", None]
    assert default == [1, 0, 1, 1, 1]


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.4999,), (0.5,), (0.7,)], "p double")
    assert [r[0] for r in df.select(E.label_yn(E.threshold("p"))).collect()] == ["N", "Y", "Y"]


def test_features(spark):
    df = spark.createDataFrame([(0.0, 0.0, 100.0, 0.0), (-5.0, 1000.0, 50.0, -1.0), (math.e, 500.0, 500.0, 360.0)],
                               "LoanAmount double, ApplicantIncome double, CoapplicantIncome double, Loan_Amount_Term double")
    df = df.withColumn("TotalIncome", X.total_income())
    rows = df.select(X.log_guarded("LoanAmount").alias("g"), X.log1p("LoanAmount").alias("p"),
                     X.debt_to_income().alias("dti"), X.debt_to_income(nonpositive_term=False).alias("dti0")).collect()
    assert rows[0]["g"] == 0.0 and rows[1]["g"] == 0.0 and abs(rows[2]["g"] - 1.0) < 1e-12
    assert abs(rows[2]["p"] - math.log1p(math.e)) < 1e-12
    # term 0 → 360 in both paths; term −1 → 360 only on the request path
    assert rows[0]["dti"] == 0.0
    assert abs(rows[1]["dti"] - (-5000.0 / (1050.0 * 360 + 1))) < 1e-12
    assert abs(rows[1]["dti0"] - (-5000.0 / (1050.0 * -1 + 1))) < 1e-12


@pytest.mark.parametrize("raw,score", [(-0.45, 0.0), (-0.5345, 0.65), (-0.58, 1.0), (-0.7, 1.0)])
def test_fraud_score(spark, raw, score):
    got = one(spark, R.fraud_score("v"), raw, "v double")
    assert abs(got - score) < 1e-9


@pytest.mark.parametrize("pd_,credit,fraud,score,level", [
    (0.2999, 1.0, False, 29.99, "Low Risk"), (0.30, 1.0, False, 30.0, "Medium Risk"),
    (0.6499, 1.0, False, 64.99, "Medium Risk"), (0.65, 1.0, False, 65.0, "Medium Risk"),
    (0.6501, 1.0, False, 65.01, "High Risk"), (0.1, 0.0, False, 85.0, "High Risk"),
    (0.1, 1.0, True, 90.0, "High Risk"), (0.1, 0.0, True, 90.0, "High Risk"),
])
def test_risk_score_and_level(spark, pd_, credit, fraud, score, level):
    df = spark.createDataFrame([(pd_, credit, fraud, 1)], "p double, Credit_History double, fraud_detected boolean, m int")
    r = df.select(R.risk_score("p").alias("s")).select("*", R.risk_level("s").alias("lv")).first()
    assert abs(r["s"] - score) < 1e-9 and r["lv"] == level


@pytest.mark.parametrize("score,fraud,model,approved", [
    (64.99, False, 1, True), (65.0, False, 1, False), (30.0, True, 1, False), (10.0, False, 0, False)])
def test_approval_rule(spark, score, fraud, model, approved):
    df = spark.createDataFrame([(score, fraud, model)], "risk_score double, fraud_detected boolean, m int")
    assert df.select(R.approved("m")).first()[0] is approved


def test_recommended_loan_hand_values(spark):
    df = spark.createDataFrame([(5000.0, 0.0, 360.0, 1.0, "0"), (5000.0, 0.0, 360.0, 0.0, "3+")],
                               "ApplicantIncome double, CoapplicantIncome double, Loan_Amount_Term double, "
                               "Credit_History double, Dependents string")
    assert [r[0] for r in df.select(R.recommended_loan()).collect()] == [60.0, 15.0]


@pytest.mark.parametrize("p,level,rate", [
    (5.0, "Low Risk", 6.5), (12.0, "Low Risk", 9.0), (5.0, "Medium Risk", 9.0), (12.0, "Medium Risk", 12.0),
    (9.0, "High Risk", 14.0), (20.0, "High Risk", 18.0)])
def test_interest_rate(spark, p, level, rate):
    df = spark.createDataFrame([(p, level)], "p double, risk_level string")
    assert df.select(R.interest_rate("p")).first()[0] == rate


REC_COLS = ("Credit_History double, LoanAmount double, ApplicantIncome double, CoapplicantIncome double, "
            "Loan_Amount_Term double, risk_score double, recommended_loan_amount double")


def recs(spark, *row):
    return spark.createDataFrame([row], REC_COLS).select(R.recommendations()).first()[0]


def test_recommendations_each_rule(spark):
    assert recs(spark, 0.0, 10.0, 10000.0, 1.0, 360.0, 20.0, 100.0) == [R.ADVICE_CREDIT]
    reduce = recs(spark, 1.0, 150.0, 100000.0, 1.0, 360.0, 20.0, 100.0)
    assert reduce == ["Reduce loan request: Decrease your loan amount by ₹50,000 to bring it under your safe "
                      "limit of ₹100,000."]
    income = recs(spark, 1.0, 100.0, 1000.0, 1.0, 360.0, 20.0, 100.0)
    assert income[0].startswith("Increase annual income: Adding an extra ₹19,832 ")
    assert recs(spark, 1.0, 10.0, 10000.0, 0.0, 360.0, 41.0, 100.0) == [R.ADVICE_COAPPLICANT]
    assert recs(spark, 1.0, 10.0, 10000.0, 1.0, 180.0, 31.0, 100.0) == [R.ADVICE_TERM]
    assert recs(spark, 1.0, 10.0, 10000.0, 1.0, 360.0, 29.0, 100.0) == [R.ADVICE_PRAISE]
    assert recs(spark, 1.0, 10.0, 10000.0, 1.0, 360.0, 35.0, 100.0) == []


def test_rule_attributions_and_display(spark):
    df = spark.createDataFrame([(1.0, 5000.0, 200.0, 0.0, 100.0, "Premium Customer")],
                               "Credit_History double, ApplicantIncome double, LoanAmount double, "
                               "CoapplicantIncome double, recommended_loan_amount double, name string")
    r = df.select(R.rule_attributions().alias("m"), R.segment_display("name").alias("d")).first()
    m = r["m"]
    assert m["Credit_History"] == 0.45 and m["ApplicantIncome"] == 0.15 and m["LoanAmount"] == -0.15
    assert m["Debt_to_Income"] == -0.20 and m["CoapplicantIncome"] == 0.0 and m["Gender"] == 0.0
    assert r["d"] == R.DISPLAY_PREMIUM


def test_rates_and_amounts_round_as_the_reference(spark):
    import random

    import numpy as np
    from riskline.functions import rules as R
    rng = random.Random(1)
    values = [9.005, 6.675, 17.995, 10.125] + [round(rng.uniform(6.5, 18), 3) for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("level", F.lit("Medium Risk"))
    got = [r.y for r in df.select(R.interest_rate("x", "level").alias("y")).collect()]
    assert got == [float(np.round(min(max(max(v, 9.0), 6.5), 18.0), 2)) for v in values]
    values = [0.05, 0.15, 0.25, 0.35, 1.05, 2.675, 1e9 + 0.05, -0.25, 0.0] + [rng.randrange(-10**6, 10**6) / 20 for _ in range(3000)]
    values += [v * 0.1 for v in range(-999, 999)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert [r.y for r in df.select(R.round_one_decimal("x").alias("y")).collect()] == [round(float(v), 1) for v in values]


def test_strip_takes_all_white_space(spark):
    from riskline.functions import encode as E
    df = spark.createDataFrame([("Y\t",), ("\tyes\n",), ("\u00a01 ",), (" n",)], "x string")
    assert [r.y for r in df.select(E.normalize_binary("x").alias("y")).collect()] == [1, 1, 1, 0]
    df = spark.createDataFrame([("\t2 ",), ("3+",)], "x string")
    assert [r.y for r in df.select(E.dependents_to_int("x").alias("y")).collect()] == [2, 3]


def test_plain_texts_are_parsed_without_patterns(spark):
    """Digits and points, and tokens as written, take the short way; it gives what the patterns give."""
    import math
    from riskline.functions import encode as E
    from riskline.operators.impute import MedianFill

    def python(t):
        try:
            return float(t)
        except (TypeError, ValueError):
            return None
    texts = ["12", "0.5", ".5", "5.", ".", "", "1.2.3", "0007", " 12 ", "1_0", "1d", "1e3", "-3", "+4", "nan", "inf", "9" * 40, "3+", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", E.to_numeric("t").alias("v")).collect()
    for r in got:
        want = python(texts[r["i"]])
        assert r["v"] == want or (want is not None and math.isnan(want) and math.isnan(r["v"]))
    tokens = ["Y", "y", " yes ", "1", "0", "N", "no", "TRUE", "F", "0.7", "0.2", "odd", "nan", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    rows = df.select("i", E.normalize_binary("t", "null").alias("n"), E.normalize_binary("t").alias("z"), E.normalize_binary("t", "truth").alias("y")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [1, 1, 1, 1, 0, 0, 0, 1, 0, 1, 0, None, 0, None, None]
    assert [r["z"] for r in rows] == [1, 1, 1, 1, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0]
    assert [r["y"] for r in rows] == [1, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    num = spark.createDataFrame([(1.5, 3, "7"), (float("nan"), None, "x"), (1e300, 5, None)], "a double, b long, c string")
    m = MedianFill(["a", "b", "c"]).fit(num)
    assert m.medians == {"a": (1.5 + 1e300) / 2, "b": 4.0, "c": 7.0}
    plan = m.transform(num)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("rlike") <= 1   # doubles and whole numbers are not read as texts
    assert "translate" in plan.lower()
