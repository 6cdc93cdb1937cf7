"""Turn model outputs into explained decisions (§2.9) and name segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskline.functions import rules as R
from riskline.functions.features import total_income

DECISION_COLUMNS = ["approved", "risk_score", "risk_level", "default_probability", "fraud_score",
                    "fraud_detected", "recommended_loan_amount", "predicted_interest_rate",
                    "recommendations", "shap_values", "segment_cluster", "segment_name"]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def recommended_loan_numeric(dependents: str = "Dependents") -> Column:
    """R5 over features where Dependents is already a number."""
    return R.recommended_loan(dependents=F.coalesce(F.floor(F.col(dependents)).cast("int"), F.lit(0)))


def decide(df: DataFrame, default_probability, raw_anomaly, approval_prediction, predicted_interest,
           attributions: Column | None = None, segment_cluster=None, segment_name=None,
           dependents_numeric: bool = True) -> DataFrame:
    """R1–R7 (+ T16 fallback attributions) on a frame of application features.

    All inputs are Column expressions or column names; every step is a projection,
    so the whole decision is one whole-stage-codegen span with no shuffle.
    """
    out = (df.withColumn("default_probability", _col(default_probability).cast("double"))
             .withColumn("fraud_score", R.fraud_score(raw_anomaly))
             .withColumn("fraud_detected", R.fraud_detected("fraud_score"))
             .withColumn("risk_score", R.risk_score("default_probability"))
             .withColumn("risk_level", R.risk_level("risk_score"))
             .withColumn("approved", R.approved(approval_prediction))
             .withColumn("recommended_loan_amount",
                         recommended_loan_numeric() if dependents_numeric else R.recommended_loan())
             .withColumn("predicted_interest_rate", R.interest_rate(predicted_interest))
             .withColumn("recommendations", R.recommendations()))
    out = out.withColumn("shap_values", attributions if attributions is not None else R.rule_attributions())
    if segment_cluster is not None:
        out = out.withColumn("segment_cluster", _col(segment_cluster).cast("int"))
    if segment_name is not None:
        out = out.withColumn("segment_name", _col(segment_name))
    return out


def name_segments(centers: DataFrame, cluster: str = "cluster", income: str = "income_center",
                  credit: str = "credit_center") -> DataFrame:
    """Centre table (one row per cluster) → (cluster, segment_name).

    Lowest credit centre → High Risk / Subprime; of the other two the strictly larger
    income centre → Premium (a tie gives Premium to the second by cluster id), the
    other → Regular.  Window aggregates over the k-row centre table only.
    """
    w = Window.partitionBy(F.lit(1))  # the k centres
    c = centers.select(F.col(cluster).alias("cluster"), F.col(income).alias("inc"), F.col(credit).alias("cr"))
    c = c.withColumn("hr", F.min_by("cluster", F.struct("cr", "cluster")).over(w))
    other = F.col("cluster") != F.col("hr")
    c = (c.withColumn("a", F.min(F.when(other, F.col("cluster"))).over(w))
          .withColumn("b", F.max(F.when(other, F.col("cluster"))).over(w)))
    c = (c.withColumn("inc_a", F.max(F.when(F.col("cluster") == F.col("a"), F.col("inc"))).over(w))
          .withColumn("inc_b", F.max(F.when(F.col("cluster") == F.col("b"), F.col("inc"))).over(w)))
    premium = F.when(F.col("inc_a") > F.col("inc_b"), F.col("a")).otherwise(F.col("b"))
    return c.select(
        "cluster",
        F.when(F.col("cluster") == F.col("hr"), F.lit(R.SEGMENT_HIGH_RISK))
         .when(F.col("cluster") == premium, F.lit(R.SEGMENT_PREMIUM))
         .otherwise(F.lit(R.SEGMENT_REGULAR)).alias("segment_name"))


def area_centers(features: DataFrame, cols: Sequence[str] = ("TotalIncome", "LoanAmount", "Credit_History"),
                 cluster: str = "Property_Area") -> DataFrame:
    """Standardised (population std) centre per group: a fixed three-group segmentation
    (by property area) used where a k-means model is not wanted.  The means and stds
    are fitted (one row) and applied as literals; the centres are one partial
    aggregation with one output row per group."""
    from riskline.operators.models import scale_with
    from riskline.operators.ranking import one_row
    cols = list(cols)
    stats = one_row(features.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    z = scale_with(features.select(F.col(cluster).cast("int").alias("cluster"), *cols), cols, stats, suffix="_z")
    return z.groupBy("cluster").agg(*[F.avg(f"{c}_z").alias(c) for c in cols]).select(
        "cluster", F.col(cols[0]).alias("income_center"), F.col(cols[1]).alias("amount_center"),
        F.col(cols[2]).alias("credit_center"))
