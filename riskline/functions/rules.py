"""Decision rules as Catalyst expressions (R1–R7, R11, T14, T16) and the
deterministic scorecard used where a fitted model is not wanted (oracle checks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskline.functions.encode import dependents_to_int
from riskline.functions.features import clip
from riskline.schema import FEATURES

# ---------------------------------------------------------------------------
# The reference's advice texts, in its order.
# ---------------------------------------------------------------------------
ADVICE_CREDIT = ("Improve credit rating above 700: Pay off existing credit card debt and clear "
                 "outstanding bills on time.")
ADVICE_REDUCE = ("Reduce loan request: Decrease your loan amount by ₹{diff} to bring it under your "
                 "safe limit of ₹{limit}.")
ADVICE_INCOME = ("Increase annual income: Adding an extra ₹{needed} to your yearly earnings will "
                 "improve approval probability.")
ADVICE_COAPPLICANT = ("Apply with a co-applicant: Adding a family member with active salary and clean "
                      "credit history will lower the application risk.")
ADVICE_TERM = ("Extend loan term: Extending the loan term (e.g., to 360 months) will decrease monthly "
               "EMI capacity constraints.")
ADVICE_PRAISE = "Maintain credit excellence: Continue paying bills on time to enjoy premium interest rates."

RISK_LOW, RISK_MEDIUM, RISK_HIGH = "Low Risk", "Medium Risk", "High Risk"
SEGMENT_HIGH_RISK = "High Risk / Subprime Customer"
SEGMENT_REGULAR = "Regular Customer"
SEGMENT_PREMIUM = "Premium Customer"
DISPLAY_PREMIUM = "Premium Customers"
DISPLAY_HIGH_RISK = "High Risk / Subprime"
DISPLAY_REGULAR = "Regular Customers"
# Rule answers of the support chat (R8); %s slots are filled in order.
REASON_CREDIT = "a poor credit history record (0.0)"
REASON_AMOUNT = "requesting a loan amount higher than recommended based on your monthly income capacity"
REASON_DEFAULT = "a elevated risk profile"
ANSWER_APPROVED = ("Your loan was approved because you have a healthy credit risk profile (Risk Score: %s/100) "
                   "and your credit history record is clean. We have offered a premium interest rate of %s%%. "
                   "To keep this status, continue maintaining low credit card balances.")
ANSWER_REJECTED = ("Your loan application was flagged as high risk (Risk Score: %s/100) and was rejected "
                   "primarily because of %s.\n\n"
                   "To improve your chances:\n"
                   "1. Clear any outstanding balances to build up credit history.\n"
                   "2. Apply for a lower loan amount (close to ₹%s).\n"
                   "3. Secure a co-applicant to lower the overall default risk.")
ANSWER_RATE = ("Your dynamically calculated interest rate is %s%%. This rate is directly tied to your "
               "risk score of %s/100. Lowering your overall risk score by improving your credit history "
               "will qualify you for lower rates (starting at 6.5%%).")
ANSWER_IMPROVE = "Here are the top actions you can take to improve your approval chances:\n"
ANSWER_NO_RECOMMENDATIONS = "No specific recommendations at this time."
ANSWER_STATUS = ("Thank you for contacting customer support. Regarding your application: "
                 "Status: %s, Risk Score: %s/100, Recommended Loan Amount: ₹%s, Interest Rate: %s%%.\n"
                 "Please let me know if you would like tips on improving your score or understanding your "
                 "interest rate.")
# ---------------------------------------------------------------------------


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _true(cond: Column) -> Column:
    """A null comparison counts as false (the reference's Python comparisons)."""
    return F.coalesce(cond, F.lit(False))


def thousands(c) -> Column:
    """``f"{round(x):,}"``: half-even to an integer, comma thousands separators."""
    return F.format_number(F.bround(_col(c), 0), 0)


# --- R1 ---------------------------------------------------------------------
def fraud_score(raw_anomaly) -> Column:
    """Map an isolation-forest raw score (−1…0, lower = stranger) to 0…1."""
    return clip((F.lit(-0.45) - _col(raw_anomaly)) / F.lit(0.13), 0.0, 1.0)


def fraud_detected(score) -> Column:
    return _col(score) > F.lit(0.65)


# --- R2 / R3 / R4 -------------------------------------------------------------
def risk_score(default_probability, credit="Credit_History", fraud="fraud_detected") -> Column:
    """R2: 100·PD, at least 85 on poor credit, at least 90 on fraud, clipped to 0…100."""
    s = _col(default_probability) * F.lit(100.0)
    s = F.when(_true(_col(credit) == 0.0), F.greatest(s, F.lit(85.0))).otherwise(s)
    s = F.when(_true(_col(fraud)), F.greatest(s, F.lit(90.0))).otherwise(s)
    return clip(s, 0.0, 100.0)


def risk_level(score) -> Column:
    """< 30 Low, ≤ 65 Medium, else High."""
    s = _col(score)
    return F.when(s < 30, F.lit(RISK_LOW)).when(s <= 65, F.lit(RISK_MEDIUM)).when(
        s.isNotNull(), F.lit(RISK_HIGH))


def approved(model_prediction, fraud="fraud_detected", score="risk_score") -> Column:
    """Model says 1, no fraud, and score strictly below 65 (a score of 65 is Medium yet refused)."""
    return _true(_col(model_prediction) == 1) & ~_true(_col(fraud)) & _true(_col(score) < 65.0)


def round_one_decimal(x) -> Column:
    """A double rounded to one decimal by its exact binary value, ties to even (Python's ``round(x, 1)``).

    10x = 8x + 2x, both exact; the rounding error of the sum (two-sum) tells which side of a
    tie the exact product lies on."""
    eight, two = _col(x) * F.lit(8.0), _col(x) * F.lit(2.0)
    s = eight + two
    b = s - eight
    error = (eight - (s - b)) + (two - b)
    tie = (s - F.floor(s)) == 0.5
    up, down = F.ceil(s).cast("double"), F.floor(s).cast("double")
    return F.when(tie & (error > 0), up).when(tie & (error < 0), down).otherwise(F.rint(s)) / F.lit(10.0)


# --- R5 -----------------------------------------------------------------------
def recommended_loan(applicant="ApplicantIncome", coapplicant="CoapplicantIncome",
                     term="Loan_Amount_Term", credit="Credit_History", dependents="Dependents",
                     income_periods: float = 12.0) -> Column:
    """Safe amount (thousands): income/periods · ratio · term / 1000, one decimal.

    ratio = 0.40 on good credit else 0.15, minus min(0.05·dependents, 0.15), at least 0.10.
    ``dependents`` names the raw text (``3+`` → 3, unparseable → 0) or is a number column.
    """
    total = _col(applicant) + _col(coapplicant)
    monthly = total / F.lit(float(income_periods))
    ratio = F.when(_true(_col(credit) == 1.0), F.lit(0.40)).otherwise(F.lit(0.15))
    deps = dependents_to_int(dependents, 0) if isinstance(dependents, str) else dependents
    ratio = ratio - F.least(F.lit(0.05) * deps, F.lit(0.15))
    ratio = F.greatest(F.lit(0.10), ratio)
    return round_one_decimal((monthly * ratio * _col(term)) / F.lit(1000.0))


# --- R6 -----------------------------------------------------------------------
def interest_rate(predicted, level="risk_level") -> Column:
    """Low caps at 9, Medium floors at 9, High floors at 14; clip 6.5…18; two decimals."""
    p, lv = _col(predicted), _col(level)
    adj = (F.when(lv == RISK_LOW, F.least(p, F.lit(9.0)))
            .when(lv == RISK_MEDIUM, F.greatest(p, F.lit(9.0)))
            .otherwise(F.greatest(p, F.lit(14.0))))
    return F.rint(clip(adj, 6.5, 18.0) * F.lit(100.0)) / F.lit(100.0)  # NumPy: scale, nearest even, unscale


# --- R7 -----------------------------------------------------------------------
def recommendations(credit="Credit_History", amount="LoanAmount", applicant="ApplicantIncome",
                    coapplicant="CoapplicantIncome", term="Loan_Amount_Term",
                    score="risk_score", recommended="recommended_loan_amount") -> Column:
    """The ordered advice list (array<string>)."""
    cr, amt, sc, rec = _col(credit), _col(amount), _col(score), _col(recommended)
    total = _col(applicant) + _col(coapplicant)
    reduce_txt = F.format_string(
        ADVICE_REDUCE.replace("{diff}", "%s").replace("{limit}", "%s"),
        thousands((amt - rec) * F.lit(1000.0)), thousands(rec * F.lit(1000.0)))
    needed = (amt * F.lit(1000.0)) / F.lit(0.40) / F.lit(12.0) - total
    income_txt = F.format_string(ADVICE_INCOME.replace("{needed}", "%s"), thousands(needed))
    items = [
        F.when(_true(cr == 0.0), F.lit(ADVICE_CREDIT)),
        F.when(_true(amt > rec), reduce_txt),
        F.when(_true(amt / (total + F.lit(1.0)) > 0.03) & _true(needed > 0), income_txt),
        F.when(_true(_col(coapplicant) == 0.0) & _true(sc > 40), F.lit(ADVICE_COAPPLICANT)),
        F.when(_true(_col(term) < 360) & _true(sc > 30), F.lit(ADVICE_TERM)),
    ]
    advice = F.array_compact(F.array(*items))
    return F.when((F.size(advice) == 0) & _true(sc < 30), F.array(F.lit(ADVICE_PRAISE))).otherwise(advice)


# --- R11 ----------------------------------------------------------------------
def gauge_values(score="risk_score", rate="predicted_interest_rate",
                 recommended="recommended_loan_amount", amount="LoanAmount") -> list[Column]:
    """Gauge readings — limit share %, rate·5, and the band of the risk gauge
    (0–30 / 30–70 / 70–100, other bounds than the risk levels)."""
    s = _col(score)
    return [
        F.least(_col(recommended) / (_col(amount) + F.lit(1.0)) * F.lit(100.0), F.lit(100.0)).alias("limit_share"),
        (_col(rate) * F.lit(5.0)).alias("rate_gauge"),
        F.when(s < 30, F.lit("0-30")).when(s < 70, F.lit("30-70")).when(s.isNotNull(), F.lit("70-100"))
         .alias("risk_band"),
    ]


# --- T14 ----------------------------------------------------------------------
def segment_display(name) -> Column:
    """Segment name → plural display group."""
    n = _col(name)
    return (F.when(n.contains("Premium"), F.lit(DISPLAY_PREMIUM))
             .when(n.contains("High Risk") | n.contains("Subprime"), F.lit(DISPLAY_HIGH_RISK))
             .otherwise(F.lit(DISPLAY_REGULAR)))


# --- T16 ----------------------------------------------------------------------
def rule_attributions(credit="Credit_History", applicant="ApplicantIncome", amount="LoanAmount",
                      coapplicant="CoapplicantIncome", recommended="recommended_loan_amount",
                      features: list[str] = FEATURES) -> Column:
    """Fallback explanation map feature → contribution (all 0 but five rules)."""
    total = _col(applicant) + _col(coapplicant)
    rules = {
        "Credit_History": F.when(_true(_col(credit) == 1.0), F.lit(0.45)).otherwise(F.lit(-0.55)),
        "ApplicantIncome": F.when(_true(_col(applicant) > 4000), F.lit(0.15)).otherwise(F.lit(-0.10)),
        "LoanAmount": F.when(_true(_col(amount) > _col(recommended)), F.lit(-0.15)).otherwise(F.lit(0.10)),
        "Debt_to_Income": F.when(_true(_col(amount) / (total + F.lit(1.0)) > 0.03), F.lit(-0.20))
                           .otherwise(F.lit(0.05)),
        "CoapplicantIncome": F.when(_true(_col(coapplicant) > 0), F.lit(0.10)).otherwise(F.lit(0.0)),
    }
    kv = []
    for f in features:
        kv += [F.lit(f), rules.get(f, F.lit(0.0))]
    return F.create_map(*kv)


# --- scorecard stand-ins ------------------------------------------------------
def scorecard_default_probability(credit="Credit_History", dti="Debt_to_Income",
                                  self_employed="Self_Employed", education="Education") -> Column:
    """A fixed, explainable PD (not a fitted model) so rule queries can be checked
    value by value against SQL.  Inputs are the encoded v2 features."""
    pd_ = (F.lit(0.08) + F.lit(0.55) * (F.lit(1.0) - _col(credit))
           + F.lit(0.25) * F.least(_col(dti) * F.lit(200.0), F.lit(1.0))
           + F.lit(0.05) * _col(self_employed) - F.lit(0.04) * _col(education))
    return clip(pd_, 0.01, 0.99)


def scorecard_anomaly(total="TotalIncome", amount="LoanAmount") -> Column:
    """A fixed stand-in for the isolation-forest raw score (−1…0, lower = stranger)."""
    far = F.least(F.abs(F.log1p(_col(total)) - F.lit(8.5)) / F.lit(3.0), F.lit(1.0))
    return F.lit(-0.35) - F.lit(0.25) * far - F.lit(0.1) * F.least(_col(amount) / F.lit(500.0), F.lit(1.0))


def scorecard_interest(credit="Credit_History", amount="LoanAmount", total="TotalIncome") -> Column:
    """Stand-in for the interest regressor: the noiseless interest label."""
    from riskline.functions.features import interest_label
    return interest_label(credit, amount, total, noise_sd=0.0)
