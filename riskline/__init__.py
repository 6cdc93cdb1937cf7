"""riskline — Spark-native credit-risk analytics.

Operators take DataFrames plus column names and return DataFrames (or fitted
Spark ML models).  Sub-packages:

* ``sources``   — readers, writers, validation, the loan view over the driver tables
* ``functions`` — Column expressions (encoders, features, normalisers, decision rules)
* ``operators`` — DataFrame operators (imputation, profiles, evaluation, models, attributions)
* ``plans``     — the query registry and its DuckDB oracle statements
* ``streaming`` — Structured Streaming scoring and KPI queries
"""

__version__ = "0.1.0"
