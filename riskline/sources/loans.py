"""The portable loan view over the driver's TPC-H-like tables.

The driver tables hold no loans, so every query runs on one derived view: an
order is an application, its customer the applicant.  The derivation is fixed
(the oracle statement in ``riskline.plans.oracle`` is the same view in SQL).
Nulls are placed by key arithmetic so that imputation has work to do; no row
is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


def loan_view(spark: SparkSession, sf_dir: str, with_status: bool = True) -> DataFrame:
    """orders ⋈ customer ⋈ nation → raw applications (+ Loan_Status, user_id, ts).

    Join plan: ``nation`` has 25 rows by the TPC-H definition, so it is broadcast;
    ``orders`` ⋈ ``customer`` is left to the planner (broadcast below
    ``autoBroadcastJoinThreshold`` by statistics, sort-merge on ``custkey`` beyond, AQE
    re-plans on runtime sizes).  Only the columns used are read.
    """
    return loan_view_from(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"),
                          read_table(spark, sf_dir, "nation"), with_status)


def loan_view_from(orders: DataFrame, customer: DataFrame, nation: DataFrame, with_status: bool = True) -> DataFrame:
    """The loan view over given frames; ``orders`` may be a stream (stream–static joins)."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = nation.select("n_nationkey", "n_regionkey")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")))
    k = F.col("o_orderkey")
    ck = F.col("c_custkey")
    cols = [
        k.alias("Loan_ID"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
        _null_when(k % 47 == 0, F.when(ck % 5 == 0, "Female").otherwise("Male")).alias("Gender"),
        _null_when(k % 199 == 0, F.when(F.col("c_nationkey") % 3 == 0, "No").otherwise("Yes")).alias("Married"),
        _null_when(k % 41 == 0,
                   F.when(ck % 10 < 6, "0").when(ck % 10 == 6, "1").when(ck % 10 < 9, "2").otherwise("3+")
                   ).alias("Dependents"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Not Graduate").otherwise("Graduate").alias("Education"),
        _null_when(k % 19 == 0, F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("No")
                   ).alias("Self_Employed"),
        F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("ApplicantIncome"),
        F.when(ck % 2 == 0, F.lit(0.0)).otherwise(F.abs("c_acctbal") / F.lit(2.0)).alias("CoapplicantIncome"),
        _null_when(k % 28 == 0, F.floor(F.col("o_totalprice") / F.lit(1000.0)) * F.lit(1.0)).alias("LoanAmount"),
        _null_when(k % 44 == 0, F.when(k % 8 == 1, F.lit(180.0)).when(k % 50 == 3, F.lit(120.0))
                   .otherwise(F.lit(360.0))).alias("Loan_Amount_Term"),
        _null_when(k % 12 == 0, F.when((F.col("o_orderstatus") == "O") & (k % 2 == 1), F.lit(0.0))
                   .otherwise(F.lit(1.0))).alias("Credit_History"),
        F.when(F.col("n_regionkey") % 3 == 0, "Rural").when(F.col("n_regionkey") % 3 == 1, "Semiurban")
         .otherwise("Urban").alias("Property_Area"),
    ]
    if with_status:
        cols.append(F.when(F.col("o_orderstatus") == "O", "N").otherwise("Y").alias("Loan_Status"))
    return j.select(*cols)
