"""Distributed order-dependent helpers against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskline.operators import ranking as K


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 50, 2000)
    parts = rng.integers(0, 3, 2000)
    df = spark.createDataFrame([(int(i), int(p), int(v)) for i, (p, v) in enumerate(zip(parts, vals))],
                               "k long, p int, v long")
    got = K.prefix_sums(df, ["k"], ["v"], ["p"], buckets=16).orderBy("k").collect()
    for part in range(3):
        sel = [r for r in got if r["p"] == part]
        assert [r["cum_v"] for r in sel] == list(np.cumsum([r["v"] for r in sel]))


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_row_index_is_dense_and_ordered(spark, buckets):
    df = spark.range(0, 3000, 3).withColumn("k", F.col("id") * 7 % 10007)
    idx = K.add_row_index(df, "k", buckets=buckets).orderBy("k").select("row_index").collect()
    assert [r[0] for r in idx] == list(range(1000))


def test_row_index_independent_of_partitioning(spark):
    df = spark.range(500).withColumn("k", (F.col("id") * 37) % 1009)
    a = K.add_row_index(df.repartition(1), "k").orderBy("k").collect()
    b = K.add_row_index(df.repartition(8), "k").orderBy("k").collect()
    assert a == b


@pytest.mark.parametrize("buckets", [2, 3, 10, 200])
def test_range_buckets_count_the_bounds_below(spark, buckets):
    df = spark.range(2000).select(F.when(F.col("id") % 50 != 7, F.col("id") * 37 % 1009).alias("v"), (F.col("id") % 2).alias("p"))
    for x in (K.range_buckets(df, "v", [], buckets), K.range_buckets(df, "v", ["p"], buckets),
              K.range_buckets(df.withColumn("v", F.format_string("%05d", "v")).withColumn("p", F.lit(0)), "v", [], buckets)):
        per = x.where("v IS NOT NULL").groupBy("p", "_bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("p", "_bucket").collect()
        assert len({r["_bucket"] for r in per}) > buckets // 2 and all(0 <= r["_bucket"] < buckets for r in per)
        assert all(a["hi"] < b["lo"] for a, b in zip(per, per[1:]) if a["p"] == b["p"])


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("listed, ranges, accuracy", [(10_000, 1024, 10_000), (5, 4, 100), (1, 2, 10), (0, 1024, 10_000)])
def test_quantiles_match_numpy(spark, listed, ranges, accuracy):
    rng = np.random.default_rng(3)
    x = np.round(rng.lognormal(8, 1, 1001), 2)
    x[:400] = x[0]  # a hot value
    wide = np.where(rng.random(1001) < 0.5, 1e-300, 1e300) * rng.normal(size=1001)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, wide)], "x double, `a b` double, none double")
    df = df.unionByName(spark.createDataFrame([(float("nan"), None, None)], df.schema))
    got = K.quantiles(df, ["x", "a b", "none"], PROBS, accuracy=accuracy, listed=listed, ranges=ranges)
    for p in PROBS:
        assert np.isclose(got["x"][p], np.percentile(x, p * 100), rtol=1e-12)
        assert np.isclose(got["a b"][p], np.percentile(wide, p * 100), rtol=1e-12)
        assert got["none"][p] is None
    assert K.quantiles(df, ["x"], [0.5], midpoint=True, accuracy=accuracy, listed=listed, ranges=ranges)["x"][0.5] == np.median(x)


def test_quantiles_of_infinite_and_no_values(spark):
    v = [-np.inf, -np.inf, 1.0, 2.0, 5.0, 7.0, np.inf]
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    for listed in (0, 10_000):
        got = K.quantiles(df, ["x"], [0.0, 0.5, 1.0], accuracy=10, listed=listed, ranges=4)["x"]
        assert got == {0.0: -np.inf, 0.5: 2.0, 1.0: np.inf}
    assert K.quantiles(df.limit(0), ["x"], [0.5])["x"] == {0.5: None}


def test_top_k_per_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = K.top_k_per_group(df, ["g"], [F.col("id").desc()], 4, fanout=8).orderBy("g", F.desc("id")).collect()
    assert [(r["g"], r["id"]) for r in got] == [(0, 999), (0, 996), (0, 993), (0, 990), (1, 997), (1, 994),
                                                (1, 991), (1, 988), (2, 998), (2, 995), (2, 992), (2, 989)]
