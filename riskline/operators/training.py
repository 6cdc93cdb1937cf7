"""Production training (v2) and batch scoring.

``train`` prepares one split, with all three targets on the same row (the reference
splits three times and misaligns the default and interest targets: D-1, D-2). The
models are fitted by name, each when it is first asked for: approval and default
forests, the interest forest, the isolation forest, the segments, and the hold-out
metrics as one run-log row.

``score`` applies all of them to any frame of features (each model is a projection
once fitted), then the decision rules — the same code serves a table and a stream.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.functions import rules as R
from riskline.operators import forest as G
from riskline.operators import models as M
from riskline.operators import segments as S
from riskline.operators.decide import decide, name_segments
from riskline.operators.evaluate import roc_auc, rmse
from riskline.operators.isolation import IsolationForestModel, anomaly_score, fit_isolation_forest
from riskline.schema import FEATURES, RUN


class TrainedModels:
    """The v2 models over one prepared table; ``how`` are the parameters of :func:`train`."""

    def __init__(self, spark: SparkSession, data: DataFrame | None, key: str, **how):
        self.spark, self.data, self.key, self.how = spark, data, key, how

    @cached_property
    def _train(self) -> DataFrame:
        return self.data.where("split = 'train'")

    @cached_property
    def _test(self) -> DataFrame:
        return self.data.where("split = 'test'")

    def _forest(self, label: str, regression: bool = False) -> G.Forest:
        rows = self.how["value_rows"] if regression else self.how["class_rows"]
        return G.fit_forest(self._train, label, FEATURES, self.key, trees=self.how["trees"], seed=self.how["forest_seed"],
                            regression=regression, rows_per_tree=rows)

    @cached_property
    def approval(self) -> G.Forest:
        return self._forest("Loan_Status_encoded")

    @cached_property
    def default(self) -> G.Forest:
        return self._forest("Default")

    @cached_property
    def interest(self) -> G.Forest:
        return self._forest("Interest_Rate", regression=True)

    @cached_property
    def fraud(self) -> IsolationForestModel:
        return fit_isolation_forest(self._train, FEATURES, self.key, trees=self.how["iso_trees"], samples=self.how["iso_samples"],
                                    seed=self.how["seed"])

    @cached_property
    def segments(self) -> S.Segments:
        return S.fit_segments(self.data, self.key, k=self.how["k"], seed=self.how["seed"], n_init=self.how["n_init"])

    def fit(self) -> "TrainedModels":
        """Fit whatever is not fitted yet; the fits are independent Spark jobs and run side by side."""
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(5) as pool:
            list(pool.map(lambda name: getattr(self, name), ("interest", "segments", "approval", "default", "fraud")))
        return self

    @cached_property
    def segment_names(self) -> dict[int, str]:
        """The name of each of the k clusters."""
        return {r["cluster"]: r["segment_name"] for r in name_segments(S.centers_frame(self.spark, self.segments)).collect()}

    @cached_property
    def params(self) -> dict:
        return {"rf_estimators": self.how["trees"], "kmeans_clusters": self.how["k"], "fraud_contamination": self.how["contamination"]}

    @cached_property
    def metrics(self) -> dict:
        """Hold-out metrics; fits the models."""
        self.fit()
        held = with_interest(with_default(with_approval(self._test, self), self), self)
        held = held.select("Loan_Status_encoded", F.col("Default").alias("label"), "Interest_Rate", "approval_pred",
                           F.col("default_probability").alias("p"), "interest_pred").cache()
        out = {"approval_accuracy": held.agg(F.avg((F.col("approval_pred") == F.col("Loan_Status_encoded")).cast("double"))).first()[0],
               "default_auc": roc_auc(held.select("label", "p"), "label", "p", by=()).first()["auc"],
               "interest_rate_rmse": rmse(held, "Interest_Rate", "interest_pred").first()["rmse"],
               "segmentation_silhouette": S.silhouette(self.data, self.segments, self.key, self.how["seed"])}
        held.unpersist()
        return out


def train(spark: SparkSession, feats: DataFrame, key: str = "Loan_ID", trees: int = 100, seed: int = 42, forest_seed: int = 22,
          k: int = 3, n_init: int = 10, iso_trees: int = 100, iso_samples: int = 256, contamination: float = 0.05,
          class_rows: int | None = None, value_rows: int | None = None) -> TrainedModels:
    """The v2 models for ``feats`` (v2 features with Loan_Status_encoded, Default, Interest_Rate); nothing is fitted
    before it is asked for. Key, features, targets and split are written to the shared folder once.

    Trees grow until their leaves are pure, each on a bootstrap of the training rows (of ``class_rows`` or ``value_rows``
    draws only where the caller names a number)."""
    from riskline.session import scratch_path
    targets = [c for c in ("Loan_Status_encoded", "Default", "Interest_Rate") if c in feats.columns]
    data = feats.where(F.col("Loan_Status_encoded").isNotNull()).select(key, *FEATURES, *targets)
    path = scratch_path(spark, "training")
    M.stratified_split(data, "Loan_Status_encoded", key, 0.2, seed).write.parquet(path)
    return TrainedModels(spark, spark.read.parquet(path), key, trees=trees, seed=seed, forest_seed=forest_seed, k=k, n_init=n_init,
                         iso_trees=iso_trees, iso_samples=iso_samples, contamination=contamination, class_rows=class_rows, value_rows=value_rows)


def run_row(spark: SparkSession, models: TrainedModels, when: datetime | None = None) -> DataFrame:
    """One run-log row (S6 input) from a training result."""
    when = when or datetime.now(timezone.utc)
    row = (f"run_{when:%Y%m%d_%H%M%S}", when.isoformat(), models.params, models.metrics)
    return spark.createDataFrame([row], RUN)


# --- one model each, as projections ------------------------------------------------------
def complete(df: DataFrame) -> DataFrame:
    """A feature column that is missing altogether is added as 0."""
    for c in FEATURES:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    return df


def with_approval(df: DataFrame, models: TrainedModels) -> DataFrame:
    """``approval_probability`` and ``approval_pred`` (1 from a probability above one half on, as the larger class)."""
    out = complete(df).withColumn("approval_probability", G.predicted(df.sparkSession, models.approval))
    return out.withColumn("approval_pred", (F.col("approval_probability") > 0.5).cast("int"))


def with_default(df: DataFrame, models: TrainedModels) -> DataFrame:
    return complete(df).withColumn("default_probability", G.predicted(df.sparkSession, models.default))


def with_interest(df: DataFrame, models: TrainedModels) -> DataFrame:
    return complete(df).withColumn("interest_pred", G.predicted(df.sparkSession, models.interest))


def with_anomaly(df: DataFrame, models: TrainedModels) -> DataFrame:
    out = anomaly_score(complete(df), models.fraud, FEATURES, out="raw_anomaly")
    return out.withColumn("fraud_score", R.fraud_score("raw_anomaly")).withColumn("fraud_detected", R.fraud_detected("fraud_score"))


def with_risk(df: DataFrame, models: TrainedModels) -> DataFrame:
    """Default probability, anomaly, risk score and level."""
    out = with_anomaly(with_default(df, models), models)
    return out.withColumn("risk_score", R.risk_score("default_probability")).withColumn("risk_level", R.risk_level("risk_score"))


def with_segment(df: DataFrame, models: TrainedModels) -> DataFrame:
    """``segment_cluster`` and ``segment_name``; the k names are literals."""
    out = complete(df).withColumn("segment_cluster", S.nearest(models.segments))
    names = F.create_map(*[F.lit(v) for pair in models.segment_names.items() for v in pair])
    return out.withColumn("segment_name", F.element_at(names, F.col("segment_cluster")))


def with_attributions(df: DataFrame, models: TrainedModels) -> DataFrame:
    """``shap_values`` of the approval forest that decides, and ``shap_values_expected``."""
    from riskline.operators.treeshap import tree_attributions
    return tree_attributions(complete(df), models.approval)


def score(df: DataFrame, models: TrainedModels, key: str = "Loan_ID", explain: str = "shap") -> DataFrame:
    """Every model over every row, then the decision rules (§2.9); no step shuffles.

    ``explain``: ``shap`` (T15 of the approval forest itself) or ``rules`` (the T16 fallback map)."""
    if explain not in ("shap", "rules"):
        raise ValueError("explain is 'shap' or 'rules'")
    models.fit()
    x = with_approval(df, models).withColumn("_pd", G.predicted(df.sparkSession, models.default))
    x = anomaly_score(with_interest(x, models), models.fraud, FEATURES, out="raw_anomaly")
    x = with_segment(x, models)
    attributions = None
    if explain == "shap":
        x = with_attributions(x, models)
        attributions = F.col("shap_values")
    out = decide(x, default_probability="_pd", raw_anomaly="raw_anomaly", approval_prediction="approval_pred",
                 predicted_interest="interest_pred", attributions=attributions, segment_cluster="segment_cluster",
                 segment_name="segment_name")
    return out.drop("_pd")


def score_requests(df: DataFrame, models: TrainedModels, key: str = "Loan_ID", medians: dict | None = None,
                   explain: str = "shap") -> DataFrame:
    """T18 on raw applications, a table or a stream: request features, then every model and rule.  A request
    with unknown categories, missing numbers or a term of 0 is scored like any other."""
    from riskline.operators.impute import request_features
    return score(request_features(df, key, medians), models, key, explain)


# --- S8 -------------------------------------------------------------------------------------
_FORESTS = ("approval", "default", "interest")
_NODE_FIELDS = ("feature", "threshold", "left", "right", "size", "depth")


def save_trained(models: TrainedModels, path: str, spark: SparkSession) -> None:
    """Everything ``score`` needs under one folder, as Parquet tables readable by a later session: the
    forests' and the isolation forest's nodes, segments, metrics and parameters, and the feature order."""
    from riskline.sources.io import save_models
    base = path.rstrip("/")
    for name in _FORESTS:
        G.forest_rows(spark, getattr(models, name)).write.mode("overwrite").parquet(f"{base}/{name}")
    save_models({}, list(FEATURES), base, spark)
    f = models.fraud
    nodes = [(t, n, *[getattr(f, a)[t, n].item() for a in _NODE_FIELDS])
             for t in range(f.trees) for n in range(f.feature.shape[1]) if n == 0 or f.size[t, n] > 0]
    spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, left int, right int, size int, depth int") \
        .write.mode("overwrite").parquet(f"{base}/_isolation")
    s = models.segments
    segments = [(i, models.segment_names[i], [float(v) for v in c]) for i, c in enumerate(s.centers)]
    spark.createDataFrame(segments, "cluster int, name string, center array<double>").write.mode("overwrite").parquet(f"{base}/_segments")
    values = [("segment_stats", k, float(v)) for k, v in s.stats.items() if v is not None]
    values += [("metrics", k, float(v)) for k, v in models.metrics.items() if v is not None]
    values += [("params", k, float(v)) for k, v in models.params.items()]
    values += [("isolation", "samples", float(f.samples)), ("isolation", "max_depth", float(f.max_depth)),
               ("isolation", "trees", float(f.trees)), ("isolation", "nodes", float(f.feature.shape[1]))]
    spark.createDataFrame(values, "part string, name string, value double").write.mode("overwrite").parquet(f"{base}/_values")


def load_trained(spark: SparkSession, path: str, key: str = "Loan_ID") -> TrainedModels:
    """The models as ``save_trained`` left them; scores equal those of the session that fitted them."""
    from riskline.sources.io import load_models
    base = path.rstrip("/")
    _, names = load_models(spark, base, {})
    if names != list(FEATURES):
        raise ValueError("the saved models use other features")
    out = TrainedModels(spark, None, key)
    for name in _FORESTS:
        setattr(out, name, G.forest_of(spark.read.parquet(f"{base}/{name}"), FEATURES))
    values: dict[str, dict[str, float]] = {}
    for r in spark.read.parquet(f"{base}/_values").collect():  # one row a statistic
        values.setdefault(r["part"], {})[r["name"]] = r["value"]
    size = values["isolation"]
    shape = (int(size["trees"]), int(size["nodes"]))
    arrays = {a: np.zeros(shape) if a == "threshold" else np.full(shape, 0 if a in ("size", "depth") else -1, np.int32)
              for a in _NODE_FIELDS}
    nodes = spark.read.parquet(f"{base}/_isolation").toPandas()  # bounded by trees * (2 * samples - 1)
    for a in _NODE_FIELDS:
        arrays[a][nodes["tree"], nodes["node"]] = nodes[a]
    out.fraud = IsolationForestModel(samples=int(size["samples"]), max_depth=int(size["max_depth"]), **arrays)
    clusters = spark.read.parquet(f"{base}/_segments").orderBy("cluster").collect()  # k rows
    out.segments = S.Segments(list(S.INPUTS), values["segment_stats"], np.array([r["center"] for r in clusters]))
    out.segment_names = {r["cluster"]: r["name"] for r in clusters}
    out.metrics = values.get("metrics", {})
    out.params = {k: v if k == "fraud_contamination" else int(v) for k, v in values.get("params", {}).items()}
    return out


__all__ = ["TrainedModels", "train", "score", "score_requests", "save_trained", "load_trained", "run_row"]
