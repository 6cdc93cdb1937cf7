"""Fixed schemas: raw application, decision, prediction log, run log."""

from pyspark.sql import types as T

# Raw application (one loan request).  Numbers are doubles on purpose: the
# reference's nullable integer columns silently become floats.
APPLICATION_FIELDS = [
    ("Loan_ID", T.StringType()),
    ("Gender", T.StringType()),
    ("Married", T.StringType()),
    ("Dependents", T.StringType()),
    ("Education", T.StringType()),
    ("Self_Employed", T.StringType()),
    ("ApplicantIncome", T.DoubleType()),
    ("CoapplicantIncome", T.DoubleType()),
    ("LoanAmount", T.DoubleType()),
    ("Loan_Amount_Term", T.DoubleType()),
    ("Credit_History", T.DoubleType()),
    ("Property_Area", T.StringType()),
]
APPLICATION = T.StructType([T.StructField(n, t, True) for n, t in APPLICATION_FIELDS])
TRAINING_APPLICATION = T.StructType(APPLICATION.fields + [T.StructField("Loan_Status", T.StringType(), True)])

INPUT_COLUMNS = [n for n, _ in APPLICATION_FIELDS if n != "Loan_ID"]
CATEGORICAL = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "Property_Area"]
NUMERIC = ["ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History"]

# The 14 model features of the production pipeline, in their fixed order.
FEATURES = [
    "Gender", "Married", "Dependents", "Education", "Self_Employed",
    "ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term",
    "Credit_History", "Property_Area", "TotalIncome", "LoanAmount_log", "Debt_to_Income",
]

DECISION = T.StructType([
    T.StructField("approved", T.BooleanType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("default_probability", T.DoubleType()),
    T.StructField("fraud_score", T.DoubleType()),
    T.StructField("fraud_detected", T.BooleanType()),
    T.StructField("recommended_loan_amount", T.DoubleType()),
    T.StructField("predicted_interest_rate", T.DoubleType()),
    T.StructField("recommendations", T.ArrayType(T.StringType())),
    T.StructField("shap_values", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("segment_cluster", T.IntegerType()),
    T.StructField("segment_name", T.StringType()),
])

LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("inputs", T.StructType([f for f in APPLICATION.fields if f.name != "Loan_ID"])),
    T.StructField("outputs", DECISION),
])

RUN = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("parameters", T.StructType([
        T.StructField("rf_estimators", T.IntegerType()),
        T.StructField("kmeans_clusters", T.IntegerType()),
        T.StructField("fraud_contamination", T.DoubleType()),
    ])),
    T.StructField("metrics", T.StructType([
        T.StructField("approval_accuracy", T.DoubleType()),
        T.StructField("default_auc", T.DoubleType()),
        T.StructField("interest_rate_rmse", T.DoubleType()),
        T.StructField("segmentation_silhouette", T.DoubleType()),
    ])),
])
