"""Profiles against NumPy / pandas."""

import numpy as np
from pyspark.sql import functions as F

from riskline.operators import profile as P


def test_value_counts_missing_and_samples(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, None, None), (3, "a", 2.0), (4, "b", None)],
                               "k int, c string, x double")
    vc = {(r["column"], r["value"]): r["count"] for r in P.value_counts(df, ["c"]).collect()}
    assert vc == {("c", "b"): 2, ("c", "NA"): 1, ("c", "a"): 1}
    mt = {r["column"]: r["missing"] for r in P.missing_table(df).collect()}
    assert mt == {"k": 0, "c": 1, "x": 2}
    su = P.sample_uniques(df, ["c"], "k").first()
    assert su["sample_uniques"] == "b, a"


def test_shorten(spark):
    text = " ".join(f"word{i}" for i in range(40))
    r = spark.createDataFrame([(text,)], "t string").select(P.shorten("t", 30).alias("s")).first()["s"]
    assert r == "word0 word1 word2 word3..." and len(r) <= 30


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    h = P.histogram(df, ["x"], 20).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=20)
    assert [r["count"] for r in h] == list(counts)
    assert np.allclose([r["lower"] for r in h], edges[:-1])


def test_box_stats_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(10, 2, 300), [40.0, -20.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    b = P.box_stats(df, ["x"]).first()
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    inside = x[(x >= q1 - 1.5 * iqr) & (x <= q3 + 1.5 * iqr)]
    assert np.isclose(b["q1"], q1) and np.isclose(b["median"], med) and np.isclose(b["q3"], q3)
    assert b["whisker_low"] == inside.min() and b["whisker_high"] == inside.max()
    assert b["outliers"] == len(x) - len(inside)


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=200)
    df = spark.createDataFrame([(float(u), float(2 * u + v), 1.0) for u, v in zip(a, rng.normal(size=200))],
                               "a double, b double, k double")
    c = {(r["col_a"], r["col_b"]): r["corr"] for r in P.correlation(df, ["a", "b", "k"]).collect()}
    assert np.isclose(c[("a", "b")], np.corrcoef(a, [r[1] for r in df.collect()])[0, 1])
    assert c[("a", "b")] == c[("b", "a")] and c[("a", "k")] is None and len(c) == 9


def test_preview_is_first_rows(spark):
    df = spark.range(100).withColumn("k", 100 - F.col("id"))
    assert [r["k"] for r in P.preview(df, ["id", "nope"], "k", 3).collect()] == [1, 2, 3]


def test_shorten_equals_textwrap(spark):
    import random
    import textwrap

    from riskline.operators.profile import shorten
    rng = random.Random(2)
    texts = ["x" * 200, "a " * 100, "well-known semi-urban high-income " * 9, "a\tb \n c", "", "one " + "y" * 130 + " z", "ab-c1 3-x " * 20]
    texts += [" ".join("".join(rng.choices("abc-", k=rng.randrange(1, 9))).strip("-") or "a" for _ in range(40)) for _ in range(40)]
    texts = [t for t in texts if "--" not in t]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(shorten("t", 60).alias("s")).collect()] == [textwrap.shorten(t, 60, placeholder="...") for t in texts]


def test_whiskers_stay_outside_the_box(spark):
    from riskline.operators.profile import box_stats
    r = box_stats(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (10.0,)], "x double"), ["x"]).first()
    assert (r.q3, r.whisker_high, r.whisker_low, r.outliers) == (3.25, 3.25, 1.0, 1)
