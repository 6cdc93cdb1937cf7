"""Splits, models and the two executor-side jobs (isolation forest, TreeSHAP)."""

import numpy as np
from pyspark.sql import functions as F

from riskline.operators import models as M


def test_stratified_split_exact_counts(spark):
    df = spark.range(614).select(F.col("id").alias("k"), (F.col("id") % 3 != 0).cast("int").alias("y"))
    s = M.stratified_split(df, "y", "k", 0.2, 42)
    counts = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    n_test = counts.get((0, "test"), 0) + counts.get((1, "test"), 0)
    assert n_test == 123 and sum(counts.values()) == 614
    # shares follow the classes: 205 of class 0, 409 of class 1
    assert counts[(0, "test")] == 41 and counts[(1, "test")] == 82
    again = M.stratified_split(df.repartition(7), "y", "k", 0.2, 42)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect()))


def test_stratified_split_equals_plain_ranking(spark):
    """Whatever is listed: the test rows of a class are its smallest (hash, key); null labels and keys have their place."""
    df = spark.range(3000).select(F.when(F.col("id") % 41 != 0, F.concat(F.lit("k"), "id")).alias("k"),
                                  F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("y"), "id")
    rows = df.withColumn("h", M.hash_rank("k", 5)).where("y IS NOT NULL").collect()
    sizes = {c: sum(r["y"] == c for r in rows) for c in range(3)}
    want = M._allocation(sizes, 0.3)
    assert sum(want.values()) == int(np.ceil(0.3 * len(rows)))
    test = {r["id"] for c in range(3) for r in sorted((r for r in rows if r["y"] == c and r["k"] is not None), key=lambda r: (r["h"], r["k"]))[:want[c]]}
    for listed in (0, 3, 10_000):
        got = M.stratified_split(df, "y", "k", 0.3, 5, listed=listed)
        assert got.columns == ["k", "y", "id", "split"] and got.count() == len(rows)
        assert {r["id"] for r in got.where("split = 'test'").collect()} == test
    assert M.stratified_split(df.limit(0), "y", "k").count() == 0


def test_stratified_split_keeps_repeated_keys_together(spark):
    df = spark.range(400).select((F.col("id") % 10).alias("k"), F.lit(1).alias("y"))
    got = M.stratified_split(df, "y", "k", 0.25, 1).groupBy("k").agg(F.count_distinct("split").alias("n"), F.min("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in got) and sum(r["s"] == "test" for r in got) == 3


def _plain_tree(x, y, depth, min_split, left=0):
    """The tree's rule by plain loops: (n, p) of a leaf, or (feature, cut, left, right)."""
    def disorder(n, p):
        return sum(-c * np.log2(c / n) for c in (p, n - p) if c > 0)
    n, p = len(y), int(y.sum())
    if left < depth and 0 < p < n and n >= min_split:
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for v, w in zip(values, values[1:]):
                m = x[:, f] <= v
                score = (disorder(m.sum(), y[m].sum()) + disorder((~m).sum(), y[~m].sum()), f, v, w)
                if best is None or score[0] < best[0] - 1e-9:
                    best = score
        if best:
            _, f, v, w = best
            m = x[:, f] <= v
            return f, v + (w - v) / 2, _plain_tree(x[m], y[m], depth, min_split, left + 1), _plain_tree(x[~m], y[~m], depth, min_split, left + 1)
    return n, p


def test_tree_equals_plain(spark):
    from riskline.operators.tree import fit_tree
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=300).round(3), rng.integers(0, 4, 300), np.ones(300)]).astype(float)
    y = ((x[:, 0] + x[:, 1] / 3 + rng.normal(size=300) / 2) > 0.5).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "`a b` double, b double, c double, y int")
    t = fit_tree(df, "y", ["a b", "b", "c"], 5, 8)

    def shape(i):
        if t.feature[i] < 0:
            return t.rows[i], t.positives[i]
        return t.feature[i], t.threshold[i], shape(t.left[i]), shape(t.left[i] + 1)
    assert shape(0) == _plain_tree(x, y, 5, 8) and t.depth() == 5
    leaves = {i: (n, p) for i, (f, n, p) in enumerate(zip(t.feature, t.rows, t.positives)) if f < 0}
    got = df.groupBy(t.node().alias("i")).agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert {r["i"]: (r["n"], r["p"]) for r in got} == leaves
    share = df.groupBy(t.node().alias("i")).agg(F.avg(t.probability()).alias("s"), F.max(t.prediction()).alias("c")).collect()
    assert all(np.isclose(r["s"], leaves[r["i"]][1] / leaves[r["i"]][0]) and r["c"] == (2 * leaves[r["i"]][1] > leaves[r["i"]][0]) for r in share)


def test_tree_counts_by_value_only_where_a_range_may_hold_the_best_boundary(spark, monkeypatch):
    """However coarse the ranges, the tree is the plain one; and where the label follows a feature, few ranges are opened."""
    from riskline.operators import tree as TR
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=900).round(3), rng.integers(0, 400, 900) * (rng.random(900) < 0.5), rng.choice([-0.0, 0.0, 1.5], 900)])
    x[:9, 0] = [np.inf, -np.inf, np.inf, 7, 7, 7, -np.inf, 8, 9]
    y = ((np.clip(x[:, 0], -3, 3) + x[:, 1] / 300 + rng.normal(size=900) / 2) > 0.5).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "`a b` double, b double, c double, y int")
    written, opened = TR._staged, []

    def staged(table, name):
        out = written(table, name)
        if name == "tree-inside":
            opened.append(out.count())
        return out
    monkeypatch.setattr(TR, "_staged", staged)
    for bins in (2, 16):
        monkeypatch.setattr(TR, "BINS", bins)
        t = TR.fit_tree(df, "y", ["a b", "b", "c"], 3, 8)

        def shape(i):
            if t.feature[i] < 0:
                return t.rows[i], t.positives[i]
            return t.feature[i], t.threshold[i], shape(t.left[i]), shape(t.left[i] + 1)
        assert shape(0) == _plain_tree(x, y, 3, 8)
    sharp = spark.range(20_000).select((F.col("id") * 1.0).alias("a"), F.xxhash64("id").cast("double").alias("b"), (F.col("id") > 12_345).cast("int").alias("y"))
    opened.clear()
    monkeypatch.setattr(TR, "BINS", 64)
    t = TR.fit_tree(sharp, "y", ["a", "b"], 1)
    assert t.threshold[0] == 12_345.5 and t.feature[0] == 0 and opened[0] <= 3  # the one that holds it and those at the best edge


def test_tree_of_missing_values_and_single_class(spark):
    import pytest
    from riskline.operators.tree import fit_tree
    rows = [(None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i % 4), int(i % 4 < 2), i) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y int, id int")
    t = fit_tree(df, "y", ["x"])
    assert t.feature == [0, -1, -1] and t.threshold[0] == 3.0 and t.rows == [40, 20, 20]
    assert df.where(t.prediction() != F.col("y")).count() == 0
    assert fit_tree(df.where("y = 1"), "y", ["x"]).feature == [-1]
    assert fit_tree(df.limit(7), "y", ["x"]).feature == [-1]  # fewer rows than a split needs
    with pytest.raises(ValueError):
        fit_tree(df.where("y > 1"), "y", ["x"])


def test_random_split_is_key_based(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = M.random_split(df, "k").where("split = 'test'").count()
    b = M.random_split(df.repartition(3), "k").where("split = 'test'").count()
    assert a == b and 850 < a < 1150


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    z = M.standardize(df, ["a", "c"]).collect()
    assert [r["a"] for r in z] == [-1.0, 1.0] and [r["c"] for r in z] == [0.0, 0.0]


def _toy(spark, n=2000):
    df = spark.range(n).select("id", (F.rand(11) * 10).alias("a"), (F.rand(12) * 5).alias("b"), F.rand(13).alias("c"))
    return df.withColumn("y", ((F.col("a") + 4 * F.col("c") + F.rand(14) * 2) > 7).cast("double"))


def test_naive_bayes_and_logistic_fit(spark):
    x = M.assemble(_toy(spark), ["a", "b", "c"])
    nb = M.fit_gaussian_nb(x, "y")
    lr = M.fit_logistic(x, "y", 2000)
    for m in (nb, lr):
        acc = m.transform(x).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
        assert acc > 0.75


def test_isolation_forest_flags_outliers(spark):
    from riskline.operators.isolation import anomaly_score, fit_isolation_forest
    base = _toy(spark, 1500)
    odd = spark.createDataFrame([(100000 + i, 60.0 + i, 40.0, 9.0, 1.0) for i in range(5)], base.schema)
    df = base.unionByName(odd)
    iso = fit_isolation_forest(df, ["a", "b", "c"], "id", trees=60, samples=128, seed=3)
    s = anomaly_score(df, iso, ["a", "b", "c"])
    worst = [r["id"] for r in s.orderBy("raw_anomaly").limit(5).collect()]
    assert set(worst) == {100000 + i for i in range(5)}
    r = s.agg(F.min("raw_anomaly"), F.max("raw_anomaly")).first()
    assert -1.0 <= r[0] < r[1] <= 0.0
    iso2 = fit_isolation_forest(df.repartition(5), ["a", "b", "c"], "id", trees=60, samples=128, seed=3)
    assert np.array_equal(iso.threshold, iso2.threshold)


def test_isolation_forest_of_a_small_table_takes_every_row(spark):
    from riskline.operators.isolation import fit_isolation_forest
    iso = fit_isolation_forest(_toy(spark, 40), ["a", "b", "c"], "id", trees=5, samples=256)
    assert iso.samples == 40 and iso.size[:, 0].tolist() == [40] * 5
    big = fit_isolation_forest(_toy(spark, 5000), ["a", "b", "c"], "id", trees=7, samples=64)
    assert big.size[:, 0].tolist() == [64] * 7


def _forest(spark, n=1500, **how):
    from riskline.operators.forest import fit_forest
    df = _toy(spark, n)
    return df, fit_forest(df, "y", ["a", "b", "c"], "id", **how)


def test_forest_draws_depend_on_keys_only(spark):
    from riskline.operators.forest import draws, fit_forest, poisson_table
    df = spark.range(20000)
    per_tree = {r["tree"]: r["count"] for r in draws(df, "id", 10, 0.05, 3).groupBy("tree").count().collect()}
    assert len(per_tree) == 10 and all(850 < n < 1150 for n in per_tree.values())
    assert abs(poisson_table(100.0)[-1] - 1.0) < 1e-9 and poisson_table(0.1)[0] == np.exp(-0.1)
    toy, a = _forest(spark, trees=6, rows_per_tree=500)
    b = fit_forest(toy.repartition(7), "y", ["a", "b", "c"], "id", trees=6, rows_per_tree=500)
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.cover, b.cover)
    assert all(350 < a.cover[s] < 650 for s in a.start)


def test_trees_draw_as_many_rows_as_there_are(spark):
    from riskline.operators import forest as G
    df = _toy(spark, 20_000)   # more than any cap of draws there was
    forest = G.fit_forest(df, "y", ["a", "b", "c"], "id", trees=3)
    assert all(19_400 < forest.cover[s] < 20_600 for s in forest.start)
    # the draws are those of the hash, a row once with their number; rows that share a key keep their own numbers
    two = df.where("id < 50").unionByName(df.where("id < 50").withColumn("a", F.col("a") + 1))
    got = {(r["tree"], r["id"], r["a"]): r["_w"] for r in G.dealt(two, "id", 3, 1.0, 5).collect()}
    want = {(r["tree"], r["id"], r["a"]): r["count"] for r in G.draws(two, "id", 3, 1.0, 5).groupBy("tree", "id", "a").count().collect()}
    assert got == want
    grown = G.fit_forest(two, "y", ["a", "b", "c"], "id", trees=3, seed=5)
    assert grown.cover[grown.start].tolist() == [sum(w for (t, _, _), w in got.items() if t == tree) for tree in range(3)]


def test_training_caps_no_bootstrap(spark):
    from riskline.operators.training import train
    from riskline.schema import FEATURES
    rows = spark.range(20_000).withColumn("u", F.rand(3))
    feats = rows.select(F.col("id").alias("Loan_ID"), *[F.round(F.rand(i) * 9, 2).alias(c) for i, c in enumerate(FEATURES)],
                        (F.col("u") > 0.4).cast("int").alias("Loan_Status_encoded"), (F.col("u") > 0.8).cast("int").alias("Default"),
                        F.lit(8.0).alias("Interest_Rate"))
    m = train(spark, feats, trees=2)
    for forest in (m.approval, m.default, m.interest):
        assert all(15_500 < forest.cover[s] < 16_500 for s in forest.start)


def test_a_forest_in_files_and_parts_is_the_same(spark, monkeypatch):
    from riskline.operators import forest as G
    from riskline.operators import treeshap as S
    df, whole = _forest(spark, trees=5, rows_per_tree=400)
    x = df.toPandas().sort_values("id")[["a", "b", "c"]].to_numpy()
    want, phi = whole.predict(x), S.shap_matrix(whole, x[:300])
    monkeypatch.setattr(G, "PART", 2 * len(whole.feature) // 5)
    monkeypatch.setattr(S, "AT_ONCE", 7)
    cut = G.forest_of(G.forest_rows(spark, whole), whole.names)
    assert isinstance(cut.value, np.memmap) and len(cut.parts()) > 2
    for k in ("start", *G._TYPES):
        assert np.array_equal(getattr(cut, k), getattr(whole, k))
    got = df.select("id", G.predicted(spark, cut).alias("p"), S.shap_values(spark, cut).alias("v")).orderBy("id").collect()
    assert [r["p"] for r in got] == want.tolist()
    assert np.abs(np.array([r["v"] for r in got[:300]]) - phi).max() < 1e-12   # subtree by subtree
    assert np.abs(S.shap_matrix(cut, x[:300]) - phi).max() < 1e-12
    leaves = sum((p.feature < 0).sum() for t in range(5) for p in S._subtrees(cut, t))
    assert leaves == whole.leaves()


def test_every_split_of_a_grown_tree_is_a_best_one():
    from riskline.operators.forest import CRITERIA, grow
    rng = np.random.default_rng(4)
    for kind in ("gini", "entropy", "variance"):
        x = np.c_[rng.normal(size=80), rng.integers(0, 4, 80), rng.normal(size=80).round(1)]
        y = rng.normal(size=80) if kind == "variance" else (rng.random(80) < 0.4).astype(float)
        w = rng.integers(1, 4, 80).astype(float)
        for max_depth, least in ((None, 2), (3, 2), (6, 8)):
            t = grow(x, y, w, np.random.default_rng(1), 3, kind, max_depth, least)
            todo = [(0, np.arange(80), 0)]
            nodes = 0
            while todo:
                node, rows, depth = todo.pop()
                nodes += 1
                score = lambda m: CRITERIA[kind](w[m].sum(), (w[m] * (y[m] - (y @ w / w.sum() if kind == "variance" else 0))).sum())  # noqa: B023, E731
                assert abs(t["value"][node] - np.average(y[rows], weights=w[rows])) < 1e-9 and t["cover"][node] == w[rows].sum()
                cuts = [(f, a) for f in range(3) for a in sorted(set(x[rows, f]))[:-1]]
                ends = len(set(y[rows])) == 1 or w[rows].sum() < least or depth == max_depth or not cuts
                assert (t["feature"][node] < 0) == ends
                if ends:
                    continue
                best = max(score(rows[x[rows, f] <= a]) + score(rows[x[rows, f] > a]) for f, a in cuts)
                right = x[rows, t["feature"][node]] > t["threshold"][node]
                assert abs(score(rows[~right]) + score(rows[right]) - best) < 1e-9
                left = t["child"][node]
                todo += [(left, rows[~right], depth + 1), (left + 1, rows[right], depth + 1)]
            assert nodes == len(t["feature"])
    constant = grow(np.zeros((5, 2)), np.arange(5.0), np.ones(5), np.random.default_rng(1), 1, "variance")
    assert constant["feature"].tolist() == [-1] and constant["value"][0] == 2.0


def test_forest_grows_until_leaves_are_pure(spark):
    df, forest = _forest(spark, trees=5, rows_per_tree=10_000)
    inner = forest.feature >= 0
    assert set(np.unique(forest.value[~inner])) <= {0.0, 1.0} and forest.depths().max() > 6
    x = df.toPandas()
    p = forest.predict(x[["a", "b", "c"]].to_numpy())
    assert ((p > 0.5) == x["y"]).mean() > 0.9
    assert abs(forest.importances().sum() - 1) < 1e-9 and forest.importances().argmin() == 1
    from riskline.operators.forest import fit_forest, forest_of, forest_rows, predicted
    again = forest_of(forest_rows(spark, forest), forest.names)
    assert np.array_equal(again.predict(x[["a", "b", "c"]].to_numpy()), p)
    got = df.select("id", predicted(spark, forest).alias("p")).toPandas().set_index("id")["p"]
    assert np.allclose(got[x["id"]].to_numpy(), p, atol=0)
    values = fit_forest(df, "a", ["b", "c"], "id", trees=3, regression=True)
    assert np.all(values.cover[values.feature < 0] >= 1)


def _brute_shap(forest, row):
    import itertools
    import math
    p = len(forest.names)
    phi = np.zeros(p)

    def value(t, known):
        s = forest.tree(t)
        f, cut, child, v, cover = (getattr(forest, k)[s] for k in ("feature", "threshold", "child", "value", "cover"))

        def go(n):
            if f[n] < 0:
                return v[n]
            left = child[n]
            if f[n] in known:
                return go(left + (row[f[n]] > cut[n]))
            return (cover[left] * go(left) + cover[left + 1] * go(left + 1)) / cover[n]
        return go(0)
    for t in range(forest.trees):
        for i in range(p):
            for k in range(p):
                for known in itertools.combinations([j for j in range(p) if j != i], k):
                    weight = math.factorial(k) * math.factorial(p - k - 1) / math.factorial(p)
                    phi[i] += weight * (value(t, {*known, i}) - value(t, set(known)))
    return phi / forest.trees


def test_tree_shap_equals_its_definition_and_adds_up(spark):
    from riskline.operators.forest import predicted
    from riskline.operators.treeshap import shap_matrix, tree_attributions
    df, forest = _forest(spark, trees=4, rows_per_tree=300)
    x = df.toPandas()[["a", "b", "c"]].to_numpy()
    got = shap_matrix(forest, x[:30])
    assert np.abs(got[:5] - [_brute_shap(forest, r) for r in x[:5]]).max() < 1e-12
    assert np.abs(shap_matrix(forest, x[:1]) - got[:1]).max() < 1e-12 and shap_matrix(forest, x[:0]).shape == (0, 3)
    sh = tree_attributions(df.withColumn("p", predicted(spark, forest)), forest)
    total = F.aggregate(F.map_values("shap_values"), F.lit(0.0), lambda a, b: a + b)
    err = sh.agg(F.max(F.abs(total + F.col("shap_values_expected") - F.col("p")))).first()[0]
    assert err < 1e-9
    mean_abs = sh.select(F.explode("shap_values")).groupBy("key").agg(F.avg(F.abs("value")).alias("m"))
    ranked = [r["key"] for r in mean_abs.orderBy(F.desc("m")).collect()]
    assert ranked[-1] == "b"  # b carries no signal


def test_tree_shap_looks_rows_up_by_subtree(spark, monkeypatch):
    """However the trees are cut, the values are those of the leaves; many rows cost far fewer lookups than rows times leaves."""
    from riskline.operators import treeshap as S
    _, forest = _forest(spark, trees=3, rows_per_tree=400)
    x = np.random.default_rng(5).random((4000, 3)) * [10, 5, 1]
    x[7] = forest.threshold[forest.feature == 0][0]
    plain = np.zeros((len(x), 3))
    for t in range(3):
        paths = S._Paths(forest, t)
        S._add_leaves(plain, paths, np.flatnonzero(paths.feature < 0), paths.places(x)[0])
    looked, gather = [], S._gather
    monkeypatch.setattr(S, "_gather", lambda phi, table, place: (looked.append(place.size), gather(phi, table, place)))
    assert np.abs(S.shap_matrix(forest, x) - plain / 3).max() < 1e-12
    assert sum(looked) < len(x) * forest.leaves() / 4
    for cells, few in (((64,), 1), ((1 << 12, 1 << 6, 4), 10), ((1,), 1)):
        monkeypatch.setattr(S, "CELLS", cells)
        monkeypatch.setattr(S, "FEW", few)
        assert np.abs(S.shap_matrix(forest, x) - plain / 3).max() < 1e-12


def test_tree_shap_column_keeps_rows_over_several_held_lots(spark, monkeypatch):
    from riskline.operators import treeshap as S
    df, forest = _forest(spark, trees=2, rows_per_tree=200)
    x = df.toPandas().set_index("id")
    want = dict(zip(x.index, S.shap_matrix(forest, x[["a", "b", "c"]].to_numpy())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = df.select("id", S.shap_values(spark, forest).alias("v")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and all(np.allclose(r["v"], want[r["id"]], atol=1e-12) for r in got)
    x = x[["a", "b", "c"]].to_numpy()
    lots = list(S._in_batches(forest, [x[:10], x[10:11], x[11:50]]))
    assert [len(p) for p in lots] == [10, 1, 39] and not list(S._in_batches(forest, []))


def test_forest_walk_equals_plain_walk(spark):
    from riskline.operators import forest as G
    _, forest = _forest(spark, trees=3, rows_per_tree=300)
    x = np.random.default_rng(6).random((9001, 3)) * [10, 5, 1]

    def walk(t, row):
        s, n = forest.tree(t), 0
        while forest.feature[s][n] >= 0:
            n = forest.child[s][n] + (row[forest.feature[s][n]] > forest.threshold[s][n])
        return forest.value[s][n]
    rows = [0, 3999, 4000, 9000]
    assert np.allclose(forest.predict(x)[rows], [np.mean([walk(t, x[i]) for t in range(3)]) for i in rows], atol=1e-12)
    assert forest.predict(x[:0]).shape == (0,) and G.ROWS == 4_000


def _blobs(spark, n=900):
    rng = np.random.default_rng(2)
    centers = np.array([[0, 0, 0], [8, 1, 0], [0, 9, 2.0]])
    x = np.concatenate([rng.normal(c, 1, (n // 3, 3)) for c in centers])
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "Loan_ID long, TotalIncome double, LoanAmount double, Credit_History double")


def test_segments_are_k_means_and_the_silhouette_is_euclidean(spark):
    from riskline.operators import segments as S
    x, df = _blobs(spark)
    m = S.fit_segments(df, n_init=4)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    far = ((z[:, None] - m.centers[None]) ** 2).sum(axis=2)
    own = far.argmin(axis=1)
    assert abs(m.cost - far.min(axis=1).sum()) < 1e-6
    assert np.abs(np.array([z[own == c].mean(axis=0) for c in range(3)]) - m.centers).max() < 0.02  # means of their rows
    got = {r["Loan_ID"]: r["c"] for r in df.select("Loan_ID", S.nearest(m).alias("c")).collect()}
    assert [got[i] for i in range(len(x))] == own.tolist()
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    same = own[:, None] == own[None]
    a = np.where(same, d, 0).sum(axis=1) / (same.sum(axis=1) - 1)
    b = np.min([np.where(own == c, np.inf, d[:, own == c].mean(axis=1)) for c in range(3)], axis=0)
    exact = float(np.mean((b - a) / np.maximum(a, b)))
    assert abs(S.silhouette(df, m) - exact) < 1e-9
    assert abs(S.silhouette(df, m, anchors=100) - exact) < 0.02
    one = S.fit_segments(df.limit(1), n_init=2)
    assert one.k == 3 and S.silhouette(df.limit(1), one) is None


def test_the_silhouette_measures_all_pairs_of_large_clusters(spark):
    from riskline.operators import segments as S
    x, df = _blobs(spark, 4500)   # clusters of more rows than any sample of 1,000 held
    m = S.Segments(["TotalIncome", "LoanAmount", "Credit_History"],
                   {f"{s}_{c}": v for c in ("TotalIncome", "LoanAmount", "Credit_History") for s, v in (("m", 0.0), ("s", 1.0))},
                   np.array([[0, 0, 0], [8, 1, 0], [0, 9, 2.0], [90.0, 90, 90]]))
    own = ((x[:, None] - m.centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    d = np.sqrt(sum((x[:, None, f] - x[None, :, f]) ** 2 for f in range(3)))
    sums = np.stack([d[:, own == c].sum(axis=1) for c in range(3)], axis=1)
    size, rows = np.bincount(own, minlength=3), np.arange(len(x))
    a, means = sums[rows, own] / (size[own] - 1), sums / size
    means[rows, own] = np.inf
    b = means.min(axis=1)
    exact = float(np.mean((b - a) / np.maximum(a, b)))
    assert abs(S.silhouette(df, m) - exact) < 1e-12
    # the order, the tiles and a repeated key change nothing; a row alone in its cluster counts 0
    assert abs(S.silhouette(df.withColumn("Loan_ID", F.lit(1)).orderBy("LoanAmount"), m, anchors=37) - exact) < 1e-12
    single = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 90.0, 90.0, 90.0)], df.schema)
    far = [(90 ** 2 * 3) ** 0.5, (90 ** 2 * 2 + 89 ** 2) ** 0.5]
    assert abs(S.silhouette(single, m) - sum((f - 1) / f for f in far) / 3) < 1e-12


def test_baselines_fit_and_predict(spark):
    """Four models fitted side by side; their long frame gives the same counts as plain ones."""
    from riskline.operators import baseline as B
    from riskline.operators.evaluate import metrics_summary
    from riskline.functions.encode import normalize_binary
    df = M.stratified_split(_toy(spark, 800).withColumn("y", F.col("y").cast("int")), "y", "id").cache()
    got = B.fit_baselines(df, "y", ["a", "b", "c"], "id", trees=10).predict(df)
    assert got.columns[:len(df.columns)] == df.columns and got.count() == 800
    rows = got.collect()
    assert all((r["Logistic_Prob"] >= 0.5) == (r["Logistic_Predicted"] == "Y") and (r["RF_Prob"] >= 0.5) == (r["RF_Predicted"] == "Y") for r in rows)
    long = B.predictions_long(got, "id", "y").withColumn("prediction", normalize_binary("prediction", "zero"))
    accuracy = {r["model"]: r["accuracy"] for r in metrics_summary(long, "y").collect()}
    assert set(accuracy) == set(B.OUTPUTS)
    for m, (p, _) in B.OUTPUTS.items():
        plain = np.mean([(r[p] == "Y") == bool(r["y"]) for r in rows])
        assert np.isclose(accuracy[m], plain) and plain > 0.75


def test_distances_hold_no_array_of_rows_centres_and_columns():
    import tracemalloc
    from riskline.operators.segments import _distances
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(2000, 3)), rng.normal(size=(500, 3))
    assert np.abs(_distances(x[:50], c) - ((x[:50, None] - c[None]) ** 2).sum(axis=2)).max() < 1e-12
    tracemalloc.start()
    _distances(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * 8 * 2000 * 500   # 2 arrays of rows and centres beside the result
