"""Validate applications against the request constraints and form domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Form domains of the reference's request screen.
DOMAINS = {
    "Gender": ["Male", "Female", "Unknown"],
    "Married": ["Yes", "No", "Unknown"],
    "Dependents": ["0", "1", "2", "3+"],
    "Education": ["Graduate", "Not Graduate"],
    "Self_Employed": ["Yes", "No"],
    "Property_Area": ["Urban", "Semiurban", "Rural"],
}
# Lower bounds of the numeric inputs (income ≥ 0, amount ≥ 1, term ≥ 12).
MINIMA = {"ApplicantIncome": 0.0, "CoapplicantIncome": 0.0, "LoanAmount": 1.0, "Loan_Amount_Term": 12.0}
REQUIRED = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "ApplicantIncome",
            "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History", "Property_Area"]


def rejection_reasons(df: DataFrame):
    """array<string> of reasons, empty when the row is valid."""
    items = []
    for c in REQUIRED:
        items.append(F.when(F.col(c).isNull(), F.lit(f"{c} is missing")))
    for c, vals in DOMAINS.items():
        items.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*vals), F.lit(f"{c} is not one of {', '.join(vals)}")))
    for c, lo in MINIMA.items():
        items.append(F.when(F.col(c) < lo, F.lit(f"{c} is below {lo:g}")))
    items.append(F.when(F.col("Credit_History").isNotNull() & ~F.col("Credit_History").isin(0.0, 1.0),
                        F.lit("Credit_History is not 0 or 1")))
    return F.array_compact(F.array(*items))


def validate_applications(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected-with-reasons) frames; one projection, no shuffle."""
    tagged = df.withColumn("reasons", rejection_reasons(df))
    return (tagged.where(F.size("reasons") == 0).drop("reasons"),
            tagged.where(F.size("reasons") > 0))
