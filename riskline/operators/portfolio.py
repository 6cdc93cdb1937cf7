"""Portfolio figures over decisions or the decision log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _field(df: DataFrame, name: str, struct: str = "outputs"):
    """A decision field, whether the frame is flat (decisions) or a log (struct column)."""
    return F.col(f"{struct}.{name}") if struct in df.columns else F.col(name)


def portfolio_kpis(df: DataFrame, by: Sequence = ()) -> DataFrame:
    """Applications, approval rate %, mean default probability %, fraud flags.
    One partial aggregation; an empty log gives one row of nulls (count 0)."""
    aggs = [
        F.count(F.lit(1)).alias("total_applications"),
        (F.avg(_field(df, "approved").cast("double")) * F.lit(100.0)).alias("approval_rate_pct"),
        (F.avg(_field(df, "default_probability")) * F.lit(100.0)).alias("avg_default_pct"),
        F.count_if(_field(df, "fraud_detected")).alias("fraud_flags"),
    ]
    return df.groupBy(*by).agg(*aggs)


# --- L3 / L4 ------------------------------------------------------------------------
def busiest_user(log: DataFrame) -> DataFrame:
    """One row: the user with the most logged decisions (ties → smallest id).  A
    partial count per user, then a global ``min_by`` (no sort of all users)."""
    c = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.min_by("user_id", F.struct(-F.col("n"), F.col("user_id"))).alias("user_id"))


def user_history(log: DataFrame, user) -> DataFrame:
    """L3: one user's decisions, newest first (ties by id).  ``user`` is a value or a
    frame of at most one row with ``user_id``, whose value is looked up first: the
    filter is a literal that reaches the scan of the log, whose files are sorted by
    user (row groups of other users are skipped); the sort is a distributed range sort."""
    if isinstance(user, DataFrame):
        from riskline.operators.ranking import one_row
        user = one_row(user.select("user_id")).get("user_id")
    mine = log.where(F.col("user_id") == (F.lit(None).cast("string") if user is None else F.lit(str(user))))
    return mine.orderBy(F.desc("timestamp"), "id")


def all_history(log: DataFrame) -> DataFrame:
    """L4: the whole log, newest first (ties by id)."""
    return log.orderBy(F.desc("timestamp"), "id")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Concatenate row sets by column name (missing columns → null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --- R9 / R10 / R12 ------------------------------------------------------------------
def _int_thousands(c):
    """``f"{int(x):,}"``: truncate toward zero, comma thousands separators."""
    return F.format_number(c.cast("long"), 0)


def history_view(log: DataFrame) -> DataFrame:
    """The display row of each logged decision."""
    i, o = (lambda n: F.col(f"inputs.{n}")), (lambda n: F.col(f"outputs.{n}"))
    return log.select(
        "id", "user_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"),
        _int_thousands(i("ApplicantIncome")).alias("applicant_income"),
        _int_thousands(i("CoapplicantIncome")).alias("coapplicant_income"),
        _int_thousands(i("ApplicantIncome") + i("CoapplicantIncome")).alias("household_income"),
        _int_thousands(i("LoanAmount") * F.lit(1000.0)).alias("loan_requested"),
        i("Loan_Amount_Term").cast("long").alias("term_months"),
        F.format_string("%.1f%%", F.bround(o("risk_score"), 1)).alias("risk_score"),
        o("risk_level").alias("risk_level"),
        F.when(o("approved"), "Approved").otherwise("Rejected").alias("decision"),
        F.when(o("fraud_detected"), "Alert").otherwise("Passed").alias("fraud_check"))


def runs_view(runs: DataFrame) -> DataFrame:
    """The display row of each training run."""
    m = lambda n: F.col(f"metrics.{n}")
    return runs.select(
        F.col("run_name").alias("run"),
        F.regexp_replace(F.substring("timestamp", 1, 16), "T", " ").alias("date"),
        F.format_string("%.1f%%", F.bround(m("approval_accuracy") * 100.0, 1)).alias("approval_accuracy"),
        F.format_string("%.3f", F.bround(m("default_auc"), 3)).alias("default_auc"),
        F.format_string("%.2f%%", F.bround(m("interest_rate_rmse"), 2)).alias("interest_rmse"),
        F.when(m("segmentation_silhouette").isNotNull(),
               F.format_string("%.3f", F.bround(m("segmentation_silhouette"), 3))).alias("silhouette"),
        F.col("parameters.rf_estimators").alias("estimators"))


def segment_points(log: DataFrame) -> DataFrame:
    """(income, loan amount, display segment) of every logged application."""
    from riskline.functions.rules import segment_display
    return log.select("id", (F.col("inputs.ApplicantIncome") + F.col("inputs.CoapplicantIncome")).alias("income"),
                      F.col("inputs.LoanAmount").alias("loan_amount"),
                      segment_display(F.col("outputs.segment_name")).alias("cluster"))


# --- R8 ---------------------------------------------------------------------------------
def newest_decisions(log: DataFrame) -> DataFrame:
    """The newest decision per user (ties by id): one partial ``max_by`` per user,
    so even a user with a third of all rows is reduced map-side."""
    return log.groupBy("user_id").agg(
        F.max_by(F.struct("inputs", "outputs"), F.struct("timestamp", "id")).alias("_last")).select(
        "user_id", F.col("_last.inputs").alias("inputs"), F.col("_last.outputs").alias("outputs"))


ANSWER_INPUTS = ("Credit_History", "LoanAmount")
ANSWER_OUTPUTS = ("approved", "risk_score", "recommended_loan_amount", "predicted_interest_rate", "recommendations")


def answer_messages(messages: DataFrame, log: DataFrame, user: str = "user_id", text: str = "text") -> DataFrame:
    """Rule answers to users' messages from their newest decision.

    Intents, first match wins, on the lower-cased text: why + (reject | denied |
    approve); interest | rate; recommend | how to | improve; else a status
    summary.  A user without a decision gets the defaults (score 50, limit 100,
    rate 10.5, good credit, not approved)."""
    from riskline.functions import rules as R
    # the fields an answer needs, and nothing else, go through the aggregation and the join
    def only(struct: str, names: Sequence[str]):
        return F.when(F.col(struct).isNotNull(), F.struct(*[F.col(f"{struct}.{n}").alias(n) for n in names])).alias(struct)
    last = newest_decisions(log.select("id", "user_id", "timestamp", only("inputs", ANSWER_INPUTS), only("outputs", ANSWER_OUTPUTS)))
    j = messages.join(last, messages[user].cast("string") == last["user_id"], "left").drop(last["user_id"])
    o, i = (lambda n: F.col(f"outputs.{n}")), (lambda n: F.col(f"inputs.{n}"))
    approved = F.coalesce(o("approved"), F.lit(False))
    score = F.coalesce(o("risk_score"), F.lit(50.0))
    rec = F.coalesce(o("recommended_loan_amount"), F.lit(100.0))
    rate = F.coalesce(o("predicted_interest_rate"), F.lit(10.5))
    credit = F.coalesce(i("Credit_History"), F.lit(1.0))
    amount = F.coalesce(i("LoanAmount"), F.lit(0.0))
    recs = F.when(F.col("outputs").isNull(), F.array(F.lit(R.ANSWER_NO_RECOMMENDATIONS))).otherwise(o("recommendations"))
    score0 = F.format_string("%.0f", F.bround(score, 0))
    rate1 = F.format_string("%.1f", F.bround(rate, 1))
    reasons = F.array_compact(F.array(F.when(credit == 0.0, F.lit(R.REASON_CREDIT)),
                                      F.when(amount > rec, F.lit(R.REASON_AMOUNT))))
    reasons_text = F.when(F.size(reasons) > 0, F.array_join(reasons, " and ")).otherwise(F.lit(R.REASON_DEFAULT))
    m = F.lower(F.col(text))
    why = m.contains("why") & (m.contains("reject") | m.contains("denied") | m.contains("approve"))
    rate_q = m.contains("interest") | m.contains("rate")
    improve = m.contains("recommend") | m.contains("how to") | m.contains("improve")
    answer = (F.when(why & approved, F.format_string(R.ANSWER_APPROVED, score0, rate1))
               .when(why, F.format_string(R.ANSWER_REJECTED, score0, reasons_text, R.thousands(rec * 1000.0)))
               .when(rate_q, F.format_string(R.ANSWER_RATE, rate1, score0))
               .when(improve, F.concat(F.lit(R.ANSWER_IMPROVE),
                                       F.array_join(F.transform(recs, lambda r: F.concat(F.lit("- "), r)), "\n")))
               .otherwise(F.format_string(R.ANSWER_STATUS, F.when(approved, "Approved").otherwise("Rejected"),
                                          score0, R.thousands(rec * 1000.0), rate1)))
    intent = (F.when(why, "why").when(rate_q, "rate").when(improve, "improve").otherwise("status"))
    return j.select(*messages.columns, intent.alias("intent"), answer.alias("answer"))
