"""DuckDB statements equal to the registered Spark queries (same names, same columns).

Statements are assembled from shared CTE blocks: the loan view, the v2 features,
the scorecard decisions.  Double columns are rounded to 6 digits in the final
projection, like ``finish`` on the Spark side.
"""

from __future__ import annotations

from riskline.functions import rules as R

ORACLE: dict[str, str] = {}

# Python's float() grammar (see riskline.functions.encode.to_numeric)
_NUM_RE = (r"^[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"
           r"|^[+-]?(nan|inf|infinity)$")


def num(x: str) -> str:
    return (f"CASE WHEN regexp_matches(lower(trim(CAST({x} AS VARCHAR))), '{_NUM_RE}') "
            f"THEN TRY_CAST(replace(trim(CAST({x} AS VARCHAR)), '_', '') AS DOUBLE) END")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r6(x: str, alias: str | None = None) -> str:
    return f"round({x}, 6) AS {alias or x}"


LOANS = """loans AS (
SELECT o_orderkey AS "Loan_ID", o_custkey AS user_id, o_orderdate AS ts,
 CASE WHEN o_orderkey % 47 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'Female' ELSE 'Male' END AS "Gender",
 CASE WHEN o_orderkey % 199 = 0 THEN NULL WHEN c_nationkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS "Married",
 CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN c_custkey % 10 < 6 THEN '0' WHEN c_custkey % 10 = 6 THEN '1'
      WHEN c_custkey % 10 < 9 THEN '2' ELSE '3+' END AS "Dependents",
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Not Graduate' ELSE 'Graduate' END AS "Education",
 CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'No' END AS "Self_Employed",
 CASE WHEN c_acctbal < 0 THEN 0.0E0 ELSE c_acctbal END AS "ApplicantIncome",
 CASE WHEN c_custkey % 2 = 0 THEN 0.0E0 ELSE abs(c_acctbal) / 2.0E0 END AS "CoapplicantIncome",
 CASE WHEN o_orderkey % 28 = 0 THEN NULL ELSE floor(o_totalprice / 1000.0E0) * 1.0E0 END AS "LoanAmount",
 CASE WHEN o_orderkey % 44 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN 180.0E0 WHEN o_orderkey % 50 = 3 THEN 120.0E0
      ELSE 360.0E0 END AS "Loan_Amount_Term",
 CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 1 THEN 0.0E0 ELSE 1.0E0 END AS "Credit_History",
 CASE n_regionkey % 3 WHEN 0 THEN 'Rural' WHEN 1 THEN 'Semiurban' ELSE 'Urban' END AS "Property_Area",
 CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE 'Y' END AS "Loan_Status"
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

RAW_COLS = ['"Gender"', '"Married"', '"Dependents"', '"Education"', '"Self_Employed"', '"ApplicantIncome"',
            '"CoapplicantIncome"', '"LoanAmount"', '"Loan_Amount_Term"', '"Credit_History"', '"Property_Area"']


def mode_sub(src: str, col: str, tie: str = "smallest", key: str = '"Loan_ID"') -> str:
    if tie == "first":
        return (f"(SELECT v FROM (SELECT CAST({col} AS VARCHAR) AS v, count(*) AS n, min({key}) AS f FROM {src} "
                f"WHERE {col} IS NOT NULL GROUP BY 1) ORDER BY n DESC, f, v LIMIT 1)")
    return (f"(SELECT v FROM (SELECT CAST({col} AS VARCHAR) AS v, count(*) AS n FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)")


def case_map(col: str, mapping: dict, cast: str | None = None) -> str:
    arms = " ".join(f"WHEN {col} = {q(k)} THEN {v}" for k, v in mapping.items())
    expr = f"CASE {arms} END"
    return f"CAST({expr} AS {cast})" if cast else expr


GENDER2 = {"Male": 1, "Female": 0, "Unknown": 1}
MARRIED2 = {"Yes": 1, "No": 0, "Unknown": 0}
EDU2 = {"Graduate": 1, "Not Graduate": 0, "Unknown": 0}
SELF2 = {"Yes": 1, "No": 0, "Unknown": 0}
AREA2 = {"Rural": 0, "Semiurban": 1, "Urban": 2, "Unknown": 1}
V1 = {'"Gender"': {"Male": 1, "Female": 0}, '"Married"': {"Yes": 1, "No": 0},
      '"Education"': {"Graduate": 1, "Not Graduate": 0}, '"Self_Employed"': {"Yes": 1, "No": 0},
      '"Property_Area"': {"Rural": 0, "Semiurban": 1, "Urban": 2}}
V2 = {'"Gender"': GENDER2, '"Married"': MARRIED2, '"Education"': EDU2, '"Self_Employed"': SELF2,
      '"Property_Area"': AREA2}


def _v2_blocks() -> str:
    dep = f"""CASE WHEN "Dependents" IN ('3+', '3 +') THEN 3.0E0 ELSE coalesce({num('"Dependents"')}, 0.0E0) END"""
    fills = []
    for c in ['"Gender"', '"Married"', '"Education"', '"Self_Employed"', '"Property_Area"']:
        fills.append(f"coalesce({c}, {mode_sub('v2raw', c)}, 'Unknown') AS {c}")
    for c in ['"ApplicantIncome"', '"CoapplicantIncome"', '"LoanAmount"', '"Loan_Amount_Term"', '"Credit_History"']:
        fills.append(f"coalesce({c}, (SELECT coalesce(median({c}), 0.0E0) FROM v2raw)) AS {c}")
    enc = [f'{case_map(c, m, "DOUBLE")} AS {c}' for c, m in V2.items()]
    return f"""v2raw AS (SELECT "Loan_ID", user_id, ts, coalesce(loans."Dependents", '0') AS dep_text, "Gender", "Married",
  {dep} AS "Dependents", "Education",
  "Self_Employed", "ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History",
  "Property_Area", "Loan_Status" FROM loans),
v2fill AS (SELECT "Loan_ID", user_id, ts, dep_text, "Dependents", "Loan_Status", {", ".join(fills)} FROM v2raw),
v2 AS (SELECT "Loan_ID", {enc[0]}, {enc[1]}, "Dependents", {enc[2]}, {enc[3]},
  "ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History", {enc[4]},
  "ApplicantIncome" + "CoapplicantIncome" AS "TotalIncome",
  ln(1 + "LoanAmount") AS "LoanAmount_log",
  ("LoanAmount" * 1000.0E0) / (("ApplicantIncome" + "CoapplicantIncome") *
     CASE WHEN "Loan_Amount_Term" = 0 THEN 360.0E0 ELSE "Loan_Amount_Term" END + 1.0E0) AS "Debt_to_Income",
  CASE WHEN "Loan_Status" = 'Y' THEN 1 WHEN "Loan_Status" = 'N' THEN 0 END AS "Loan_Status_encoded",
  1 - CASE WHEN "Loan_Status" = 'Y' THEN 1 WHEN "Loan_Status" = 'N' THEN 0 END AS "Default",
  least(greatest(8.0E0 + 5.0E0 * (1.0E0 - "Credit_History") + 4.0E0 * ("LoanAmount" /
     (("ApplicantIncome" + "CoapplicantIncome") / 10.0E0 + 1.0E0)), 6.5E0), 18.0E0) AS "Interest_Rate",
  user_id, ts
 FROM v2fill)"""


V2_BLOCKS = _v2_blocks()
FEATURE_COLS = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "ApplicantIncome",
                "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History", "Property_Area",
                "TotalIncome", "LoanAmount_log", "Debt_to_Income"]


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def _advice_sql() -> str:
    reduce_t = R.ADVICE_REDUCE.split("{diff}")
    red_a, rest = reduce_t[0], reduce_t[1]
    red_b, red_c = rest.split("{limit}")
    inc_a, inc_b = R.ADVICE_INCOME.split("{needed}")
    total = '("ApplicantIncome" + "CoapplicantIncome")'
    needed = f'(("LoanAmount" * 1000.0E0) / 0.40E0 / 12.0E0 - {total})'
    items = [
        f"""CASE WHEN coalesce("Credit_History" = 0.0E0, false) THEN {q(R.ADVICE_CREDIT)} END""",
        f"""CASE WHEN coalesce("LoanAmount" > recommended_loan_amount, false) THEN {q(red_a)} ||
             {thousands('("LoanAmount" - recommended_loan_amount) * 1000.0E0')} || {q(red_b)} ||
             {thousands('recommended_loan_amount * 1000.0E0')} || {q(red_c)} END""",
        f"""CASE WHEN coalesce("LoanAmount" / ({total} + 1.0E0) > 0.03E0, false) AND coalesce({needed} > 0, false)
             THEN {q(inc_a)} || {thousands(needed)} || {q(inc_b)} END""",
        f"""CASE WHEN coalesce("CoapplicantIncome" = 0.0E0, false) AND coalesce(risk_score > 40, false)
             THEN {q(R.ADVICE_COAPPLICANT)} END""",
        f"""CASE WHEN coalesce("Loan_Amount_Term" < 360, false) AND coalesce(risk_score > 30, false)
             THEN {q(R.ADVICE_TERM)} END""",
    ]
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def _decision_blocks() -> str:
    total = '("ApplicantIncome" + "CoapplicantIncome")'
    attr_rules = {
        "Credit_History": """CASE WHEN coalesce("Credit_History" = 1.0E0, false) THEN 0.45E0 ELSE -0.55E0 END""",
        "ApplicantIncome": """CASE WHEN coalesce("ApplicantIncome" > 4000, false) THEN 0.15E0 ELSE -0.10E0 END""",
        "LoanAmount": """CASE WHEN coalesce("LoanAmount" > recommended_loan_amount, false) THEN -0.15E0 ELSE 0.10E0 END""",
        "Debt_to_Income": f"""CASE WHEN coalesce("LoanAmount" / ({total} + 1.0E0) > 0.03E0, false) THEN -0.20E0 ELSE 0.05E0 END""",
        "CoapplicantIncome": """CASE WHEN coalesce("CoapplicantIncome" > 0, false) THEN 0.10E0 ELSE 0.0E0 END""",
    }
    attr_keys = "[" + ", ".join(q(f) for f in FEATURE_COLS) + "]"
    attr_vals = "[" + ", ".join(attr_rules.get(f, "0.0E0") for f in FEATURE_COLS) + "]"
    return f"""cent0 AS (SELECT avg("TotalIncome") AS m1, stddev_pop("TotalIncome") AS s1, avg("LoanAmount") AS m2,
  stddev_pop("LoanAmount") AS s2, avg("Credit_History") AS m3, stddev_pop("Credit_History") AS s3 FROM v2),
cent AS (SELECT CAST("Property_Area" AS INTEGER) AS cluster,
  avg(("TotalIncome" - m1) / CASE WHEN s1 = 0 THEN 1.0E0 ELSE s1 END) AS income_center,
  avg(("LoanAmount" - m2) / CASE WHEN s2 = 0 THEN 1.0E0 ELSE s2 END) AS amount_center,
  avg(("Credit_History" - m3) / CASE WHEN s3 = 0 THEN 1.0E0 ELSE s3 END) AS credit_center
  FROM v2, cent0 GROUP BY 1),
hr AS (SELECT cluster AS hr FROM cent ORDER BY credit_center, cluster LIMIT 1),
pair AS (SELECT min(cluster) AS a, max(cluster) AS b, arg_min(income_center, cluster) AS inc_a,
  arg_max(income_center, cluster) AS inc_b FROM cent, hr WHERE cluster <> hr.hr),
segnames AS (SELECT cluster, CASE WHEN cluster = hr THEN {q(R.SEGMENT_HIGH_RISK)}
  WHEN cluster = CASE WHEN inc_a > inc_b THEN a ELSE b END THEN {q(R.SEGMENT_PREMIUM)}
  ELSE {q(R.SEGMENT_REGULAR)} END AS segment_name FROM cent, hr, pair),
sc AS (SELECT v2.*, CAST("Property_Area" AS INTEGER) AS segment_cluster,
  least(greatest(0.08E0 + 0.55E0 * (1.0E0 - "Credit_History") + 0.25E0 * least("Debt_to_Income" * 200.0E0, 1.0E0)
     + 0.05E0 * "Self_Employed" - 0.04E0 * "Education", 0.01E0), 0.99E0) AS default_probability,
  -0.35E0 - 0.25E0 * least(abs(ln(1 + "TotalIncome") - 8.5E0) / 3.0E0, 1.0E0)
     - 0.1E0 * least("LoanAmount" / 500.0E0, 1.0E0) AS raw_anomaly,
  "Interest_Rate" AS interest_pred
  FROM v2),
d1 AS (SELECT *, least(greatest((-0.45E0 - raw_anomaly) / 0.13E0, 0.0E0), 1.0E0) AS fraud_score FROM sc),
d2 AS (SELECT *, fraud_score > 0.65E0 AS fraud_detected,
  CASE WHEN coalesce("Credit_History" = 0.0E0, false) THEN greatest(default_probability * 100.0E0, 85.0E0)
       ELSE default_probability * 100.0E0 END AS s_a FROM d1),
d3 AS (SELECT *, least(greatest(CASE WHEN coalesce(fraud_detected, false) THEN greatest(s_a, 90.0E0) ELSE s_a END,
  0.0E0), 100.0E0) AS risk_score FROM d2),
d4 AS (SELECT *, CASE WHEN risk_score < 30 THEN 'Low Risk' WHEN risk_score <= 65 THEN 'Medium Risk'
  WHEN risk_score IS NOT NULL THEN 'High Risk' END AS risk_level,
  coalesce(CAST((1.0E0 - default_probability) >= 0.5E0 AS INTEGER) = 1, false) AND NOT coalesce(fraud_detected, false)
    AND coalesce(risk_score < 65.0E0, false) AS approved,
  CAST(printf('%.1f', ((({total}) / 12.0E0) * greatest(0.10E0, CASE WHEN coalesce("Credit_History" = 1.0E0, false)
     THEN 0.40E0 ELSE 0.15E0 END - least(0.05E0 * coalesce(CAST(floor("Dependents") AS INTEGER), 0), 0.15E0))
     * "Loan_Amount_Term") / 1000.0E0) AS DOUBLE) AS recommended_loan_amount
  FROM d3),
d5 AS (SELECT *, round_even(100.0E0 * least(greatest(CASE WHEN risk_level = 'Low Risk' THEN least(interest_pred, 9.0E0)
  WHEN risk_level = 'Medium Risk' THEN greatest(interest_pred, 9.0E0) ELSE greatest(interest_pred, 14.0E0) END,
  6.5E0), 18.0E0), 0) / 100.0E0 AS predicted_interest_rate, {_advice_sql()} AS adv0 FROM d4),
dec AS (SELECT d5.*, CASE WHEN len(adv0) = 0 AND coalesce(risk_score < 30, false) THEN [{q(R.ADVICE_PRAISE)}]
  ELSE adv0 END AS recommendations, {attr_keys} AS attr_keys, {attr_vals} AS attr_vals, segnames.segment_name
  FROM d5 LEFT JOIN segnames ON d5.segment_cluster = segnames.cluster)"""


DEC_BLOCKS = _decision_blocks()
WITH_V2 = f"WITH {LOANS},\n{V2_BLOCKS}\n"
WITH_DEC = f"WITH {LOANS},\n{V2_BLOCKS},\n{DEC_BLOCKS}\n"


def oracle(name: str, sql: str):
    ORACLE[name] = sql.strip()


# --- sources, cleaning, encoding ---------------------------------------------
oracle("loans", f"WITH {LOANS} SELECT * FROM loans")

_v1_fill = []
for c in ['"Gender"', '"Married"', '"Dependents"', '"Self_Employed"']:
    _v1_fill.append(f"coalesce({c}, {mode_sub('loans', c, 'first')}) AS {c}")
for c in ['"LoanAmount"', '"Loan_Amount_Term"', '"Credit_History"']:
    _v1_fill.append(f"coalesce({c}, (SELECT median({c}) FROM loans)) AS {c}")


def _pass(c, m):
    return f"coalesce({case_map(c, m, 'VARCHAR')}, CAST({c} AS VARCHAR))"


oracle("clean_v1", f"""WITH {LOANS},
f AS (SELECT "Loan_ID", "Education", "ApplicantIncome", "CoapplicantIncome", "Property_Area", "Loan_Status",
  {", ".join(_v1_fill)} FROM loans)
SELECT "Loan_ID", {_pass('"Gender"', V1['"Gender"'])} AS "Gender", {_pass('"Married"', V1['"Married"'])} AS "Married",
  "Dependents", {_pass('"Education"', V1['"Education"'])} AS "Education",
  {_pass('"Self_Employed"', V1['"Self_Employed"'])} AS "Self_Employed",
  round("ApplicantIncome", 6) AS "ApplicantIncome", round("CoapplicantIncome", 6) AS "CoapplicantIncome",
  round("LoanAmount", 6) AS "LoanAmount", round("Loan_Amount_Term", 6) AS "Loan_Amount_Term",
  round("Credit_History", 6) AS "Credit_History", {_pass('"Property_Area"', V1['"Property_Area"'])} AS "Property_Area",
  round("ApplicantIncome" + "CoapplicantIncome", 6) AS "TotalIncome",
  round(CASE WHEN "LoanAmount" <= 0 THEN 0.0E0 ELSE ln("LoanAmount") END, 6) AS "LoanAmount_log",
  {_pass('"Loan_Status"', {"Y": 1, "N": 0})} AS "Loan_Status"
FROM f""")

_V1_NUM = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "ApplicantIncome", "CoapplicantIncome", "LoanAmount",
           "Loan_Amount_Term", "Credit_History", "Property_Area", "TotalIncome", "LoanAmount_log"]
_V1_HASH = "('0x' || substring(md5(CAST(\"Loan_ID\" AS VARCHAR) || ':42'), 1, 13))::BIGINT"
_V1_CELLS = ", ".join(num(f'"{c}"') + f' AS "{c}"' for c in _V1_NUM)
_V1_MEDIANS = ", ".join(f'median("{c}") AS m{i}' for i, c in enumerate(_V1_NUM))
_V1_FILLED = ", ".join(f'round(coalesce("{c}", m{i}, 0.0E0), 6) AS "{c}"' for i, c in enumerate(_V1_NUM))
oracle("clean_fit_transform", f"""WITH cleaned AS ({ORACLE["clean_v1"]}),
cells AS (SELECT "Loan_ID", CASE WHEN {_V1_HASH} < {int(0.2 * 16 ** 13)} THEN 'test' ELSE 'train' END AS split, {_V1_CELLS} FROM cleaned),
med AS (SELECT {_V1_MEDIANS} FROM cells WHERE split = 'train')
SELECT "Loan_ID", split, {_V1_FILLED} FROM cells, med""")

_V2_OUT = ", ".join(f'round("{c}", 6) AS "{c}"' for c in FEATURE_COLS)
oracle("clean_v2", WITH_V2 + f"""SELECT "Loan_ID", {_V2_OUT}, "Loan_Status_encoded", "Default",
  round("Interest_Rate", 6) AS "Interest_Rate" FROM v2""")

oracle("encode_strict", f"WITH {LOANS} SELECT \"Loan_ID\", " + ", ".join(
    f"{case_map(c, m)} AS {c}" for c, m in V2.items()) + " FROM loans")

oracle("encode_passthrough", f"WITH {LOANS} SELECT \"Loan_ID\", " + ", ".join(
    f"{_pass(c, m)} AS {c}" for c, m in V1.items()) + f""", {_pass('"Loan_Status"', {"Y": 1, "N": 0})} AS "Loan_Status"
 FROM loans""")

_defaults = {'"Gender"': 1, '"Married"': 0, '"Education"': 0, '"Self_Employed"': 0, '"Property_Area"': 1}
oracle("encode_default", f"WITH {LOANS} SELECT \"Loan_ID\", " + ", ".join(
    f"coalesce({case_map(c, V2[c])}, {dv}) AS {c}" for c, dv in _defaults.items()) + """,
 CASE WHEN "Dependents" IN ('3+') THEN 3 ELSE coalesce(CASE WHEN regexp_matches(trim("Dependents"), '^[+-]?\\d(_?\\d)*$')
   THEN TRY_CAST(replace(trim("Dependents"), '_', '') AS INTEGER) END, 0) END AS "Dependents"
 FROM loans""")


def _validate_sql() -> str:
    from riskline.sources.validate import DOMAINS, MINIMA, REQUIRED
    items = [f"""CASE WHEN "{c}" IS NULL THEN {q(c + ' is missing')} END""" for c in REQUIRED]
    for c, vals in DOMAINS.items():
        lst = ", ".join(q(v) for v in vals)
        items.append(f"""CASE WHEN "{c}" IS NOT NULL AND "{c}" NOT IN ({lst}) THEN {q(f"{c} is not one of {', '.join(vals)}")} END""")
    for c, lo in MINIMA.items():
        items.append(f"""CASE WHEN "{c}" < {lo!r}E0 THEN {q(f"{c} is below {lo:g}")} END""")
    items.append("""CASE WHEN "Credit_History" IS NOT NULL AND "Credit_History" NOT IN (0.0E0, 1.0E0)
      THEN 'Credit_History is not 0 or 1' END""")
    arr = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    return f"""WITH {LOANS}, r AS (SELECT "Loan_ID", {arr} AS reasons FROM loans)
SELECT "Loan_ID", len(reasons) = 0 AS valid, array_to_string(reasons, '; ') AS reasons FROM r"""


oracle("validate", _validate_sql())

oracle("interest_label", WITH_V2 + """SELECT "Loan_ID", round("Credit_History", 6) AS "Credit_History",
 round("LoanAmount", 6) AS "LoanAmount", round("TotalIncome", 6) AS "TotalIncome",
 round("Interest_Rate", 6) AS "Interest_Rate" FROM v2""")

# --- decision rules -----------------------------------------------------------
oracle("fraud_rules", WITH_DEC + """SELECT "Loan_ID", round(raw_anomaly, 6) AS raw_anomaly,
 round(fraud_score, 6) AS fraud_score, fraud_detected FROM dec""")
oracle("risk_score", WITH_DEC + """SELECT "Loan_ID", round(default_probability, 6) AS default_probability,
 round(risk_score, 6) AS risk_score, risk_level FROM dec""")
oracle("approve", WITH_DEC + """SELECT "Loan_ID", round(risk_score, 6) AS risk_score, fraud_detected, approved FROM dec""")
oracle("recommended_loan", WITH_DEC + """SELECT "Loan_ID", round(recommended_loan_amount, 6) AS recommended_loan_amount FROM dec""")
oracle("interest_rate", WITH_DEC + """SELECT "Loan_ID", risk_level, round(predicted_interest_rate, 6) AS predicted_interest_rate FROM dec""")
oracle("recommendations", WITH_DEC + """SELECT "Loan_ID", CAST(len(recommendations) AS INTEGER) AS n_recommendations,
 array_to_string(recommendations, ' | ') AS recommendations FROM dec""")
oracle("gauges", WITH_DEC + """SELECT "Loan_ID",
 round(least(recommended_loan_amount / ("LoanAmount" + 1.0E0) * 100.0E0, 100.0E0), 6) AS limit_share,
 round(predicted_interest_rate * 5.0E0, 6) AS rate_gauge,
 CASE WHEN risk_score < 30 THEN '0-30' WHEN risk_score < 70 THEN '30-70' WHEN risk_score IS NOT NULL THEN '70-100' END AS risk_band
 FROM dec""")
oracle("segment_names", WITH_DEC + """SELECT cent.cluster, round(income_center, 6) AS income_center,
 round(amount_center, 6) AS amount_center, round(credit_center, 6) AS credit_center, segment_name
 FROM cent JOIN segnames ON cent.cluster = segnames.cluster""")
oracle("rule_attributions", WITH_DEC + """SELECT "Loan_ID", array_to_string(list_transform(range(1, len(attr_keys) + 1),
 lambda i: attr_keys[i] || '=' || CAST(attr_vals[i] AS VARCHAR)), ';') AS attributions FROM dec""")
oracle("top_contributions", WITH_DEC + """, e AS (SELECT "Loan_ID", unnest(range(1, len(attr_keys) + 1)) AS i, attr_keys, attr_vals FROM dec),
t AS (SELECT "Loan_ID", i, attr_keys[i] AS k, attr_vals[i] AS v,
  row_number() OVER (PARTITION BY "Loan_ID" ORDER BY abs(attr_vals[i]) DESC, i) AS rn FROM e)
SELECT "Loan_ID", string_agg(k || '=' || CAST(v AS VARCHAR), ';' ORDER BY rn) AS top6 FROM t WHERE rn <= 6 GROUP BY "Loan_ID"
""")
oracle("global_importance", WITH_DEC + """, e AS (SELECT unnest(attr_keys) AS feature, unnest(attr_vals) AS value FROM dec)
SELECT feature, round(avg(abs(value)), 6) AS mean_abs FROM e GROUP BY feature""")

_KPI = """count(*) AS total_applications, round(avg(CAST(approved AS DOUBLE)) * 100.0E0, 6) AS approval_rate_pct,
 round(avg(default_probability) * 100.0E0, 6) AS avg_default_pct,
 CAST(count_if(fraud_detected) AS BIGINT) AS fraud_flags"""
oracle("kpis", WITH_DEC + f"SELECT {_KPI} FROM dec")
oracle("kpis_by_area", WITH_DEC + f"""SELECT CAST("Property_Area" AS INTEGER) AS area, {_KPI} FROM dec GROUP BY 1""")


# --- profiles -------------------------------------------------------------------
_CAT = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "Property_Area"]
_ALL_LOAN = ["Loan_ID", "user_id", "ts", "Gender", "Married", "Dependents", "Education", "Self_Employed",
             "ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term", "Credit_History",
             "Property_Area", "Loan_Status"]


def _long(src: str, cols, cast: str = "VARCHAR", key: str | None = None) -> str:
    k = f', "{key}" AS k' if key else ""
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST("{c}" AS {cast}) AS value{k} FROM {src}"""
                              for c in cols)


def shorten_sql(x: str, width: int = 120, ph: str = "...") -> str:
    s = f"regexp_replace(trim({x}), '\\s+', ' ', 'g')"
    room = width - len(ph)
    head = f"regexp_extract(substring({s}, 1, {room + 1}), '^(.*\\S)\\s', 1)"
    return (f"CASE WHEN length({s}) <= {width} THEN {s} ELSE (CASE WHEN {head} = '' THEN substring({s}, 1, {room}) "
            f"ELSE {head} END) || '{ph}' END")


oracle("value_counts", f"""WITH {LOANS}, l AS ({_long('loans', _CAT)})
SELECT "column", coalesce(value, 'NA') AS value, count(*) AS "count" FROM l GROUP BY ALL""")

oracle("missing_table", f"WITH {LOANS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE "{c}" IS NULL) AS missing FROM loans""" for c in _ALL_LOAN))

oracle("missing_mask", f"WITH {LOANS} SELECT \"Loan_ID\", " + ", ".join(
    f'CAST("{c}" IS NULL AS INTEGER) AS "{c}"' for c in _ALL_LOAN if c != "Loan_ID") + " FROM loans")

oracle("sample_uniques", f"""WITH {LOANS}, l AS ({_long('loans', _CAT, key='Loan_ID')}),
dd AS (SELECT "column", value, min(k) AS first_seen FROM l WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY first_seen, value) AS rn FROM dd),
j AS (SELECT "column", string_agg(value, ', ' ORDER BY first_seen, value) AS t FROM r WHERE rn <= 6 GROUP BY 1)
SELECT "column", {shorten_sql('t')} AS sample_uniques FROM j""")

_HIST = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "ApplicantIncome", "CoapplicantIncome",
         "LoanAmount", "Loan_Amount_Term", "Credit_History", "Property_Area", "TotalIncome", "LoanAmount_log",
         "Debt_to_Income"]
oracle("histogram20", WITH_V2 + f""", l AS ({_long('v2', _HIST, 'DOUBLE')}),
l2 AS (SELECT * FROM l WHERE value IS NOT NULL AND NOT isnan(value)),
rng AS (SELECT "column", CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
  CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM l2 GROUP BY 1),
c AS (SELECT l2."column", least(CAST(floor((value - lo) * (20.0E0 / (hi - lo))) AS INTEGER), 19) AS bin, count(*) AS n
  FROM l2 JOIN rng ON l2."column" = rng."column" GROUP BY ALL),
g AS (SELECT "column", lo, hi, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM rng)
SELECT g."column", g.bin, round(lo + bin * ((hi - lo) / 20.0E0), 6) AS lower,
  round(lo + (bin + 1) * ((hi - lo) / 20.0E0), 6) AS upper, coalesce(n, 0) AS "count"
FROM g LEFT JOIN c USING ("column", bin)""")

_BOX = ["ApplicantIncome", "CoapplicantIncome", "LoanAmount", "TotalIncome"]
oracle("box_stats", f"""WITH cv1 AS ({ORACLE['clean_v1']}), l AS ({_long('cv1', _BOX, 'DOUBLE')}),
l2 AS (SELECT * FROM l WHERE value IS NOT NULL AND NOT isnan(value)),
qq AS (SELECT "column", count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM l2 GROUP BY 1),
w AS (SELECT qq.*, q3 - q1 AS iqr,
  least(q1, (SELECT min(value) FROM l2 WHERE l2."column" = qq."column" AND value >= q1 - 1.5 * (q3 - q1))) AS whisker_low,
  greatest(q3, (SELECT max(value) FROM l2 WHERE l2."column" = qq."column" AND value <= q3 + 1.5 * (q3 - q1))) AS whisker_high
  FROM qq)
SELECT "column", n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(iqr, 6) AS iqr, round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high,
  CAST((SELECT count(*) FROM l2 WHERE l2."column" = w."column" AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)))
       AS BIGINT) AS outliers
FROM w""")


def _corr_sql() -> str:
    cols = FEATURE_COLS
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = ", ".join(f'corr("{a}", "{b}") AS c{i}' for i, (a, b) in enumerate(pairs))
    sel = []
    for i, (a, b) in enumerate(pairs):
        sel.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(CASE WHEN isnan(c{i}) THEN NULL ELSE c{i} END, 6) AS corr FROM cc")
        if a != b:
            sel.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, round(CASE WHEN isnan(c{i}) THEN NULL ELSE c{i} END, 6) AS corr FROM cc")
    return WITH_V2 + f", cc AS (SELECT {aggs} FROM v2)\n" + "\nUNION ALL ".join(sel)


oracle("correlation", _corr_sql())

oracle("preview", f"""SELECT "Loan_ID", "ApplicantIncome", "CoapplicantIncome", "TotalIncome", "LoanAmount",
 "LoanAmount_log" FROM ({ORACLE['clean_v1']}) t ORDER BY "Loan_ID" LIMIT 10""")


# --- evaluation -----------------------------------------------------------------
EVAL_BLOCKS = """, mo AS (SELECT "Loan_ID", "Loan_Status_encoded" AS label, 1.0E0 - default_probability AS good,
  "Credit_History", "Married" FROM sc),
mp AS (SELECT "Loan_ID", label, good, floor(good * 100.0E0) / 100.0E0 AS lr_prob,
  floor(least(greatest(good * 0.9E0 + 0.1E0 * "Married", 0.0E0), 1.0E0) * 100.0E0) / 100.0E0 AS rf_prob,
  "Credit_History" FROM mo),
ev AS (
 SELECT "Loan_ID", 'naive_bayes' AS model, label, CASE WHEN good >= 0.6E0 THEN 1 ELSE 0 END AS prediction,
   CAST(NULL AS DOUBLE) AS probability FROM mp
 UNION ALL SELECT "Loan_ID", 'decision_tree', label, CASE WHEN "Credit_History" = 1.0E0 THEN 1 ELSE 0 END, NULL FROM mp
 UNION ALL SELECT "Loan_ID", 'logistic', label, CASE WHEN lr_prob >= 0.5E0 THEN 1 ELSE 0 END, lr_prob FROM mp
 UNION ALL SELECT "Loan_ID", 'random_forest', label, CASE WHEN rf_prob >= 0.5E0 THEN 1 ELSE 0 END,
   CASE WHEN "Loan_ID" % 97 <> 0 THEN rf_prob END FROM mp),
cm AS (SELECT model, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) AS "rows" FROM ev GROUP BY model),
met AS (SELECT *, coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0) AS accuracy,
  coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
  coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM cm),
st AS (SELECT model, CASE WHEN probability IS NULL THEN 0.0E0 ELSE probability END AS score, count(*) FILTER (WHERE label = 1) AS pos,
  count(*) FILTER (WHERE label = 0) AS neg FROM ev WHERE model IN ('logistic', 'random_forest') GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS cum_pos,
  sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS cum_neg,
  sum(pos) OVER (PARTITION BY model) AS "P", sum(neg) OVER (PARTITION BY model) AS "N" FROM st),
auc AS (SELECT model, CAST(CASE WHEN "P" > 0 THEN 1 ELSE 0 END + CASE WHEN "N" > 0 THEN 1 ELSE 0 END AS INTEGER) AS classes,
  CASE WHEN "P" > 0 AND "N" > 0 THEN sum(neg * (cum_pos - pos + 0.5 * pos)) / (CAST("P" AS DOUBLE) * "N") END AS auc,
  CASE WHEN NOT ("P" > 0 AND "N" > 0) THEN 'only one class present in the labels' END AS reason
  FROM cu GROUP BY model, "P", "N")
"""
WITH_EVAL = WITH_DEC + EVAL_BLOCKS

oracle("align_key", WITH_EVAL + """SELECT "Loan_ID", CASE WHEN label = 1 THEN 'Y' ELSE 'N' END AS "Loan_Status",
 prediction, round(coalesce(probability, 0.0), 6) AS probability FROM ev WHERE model = 'logistic'""")
oracle("align_position", WITH_EVAL + """SELECT row_number() OVER (ORDER BY "Loan_ID") - 1 AS row_index, "Loan_ID",
 CASE WHEN label = 1 THEN 'Y' ELSE 'N' END AS "Loan_Status", prediction AS "RF_Predicted" FROM ev WHERE model = 'random_forest'""")
oracle("compare_predictions", WITH_EVAL + """SELECT "Loan_ID",
 max(prediction) FILTER (WHERE model = 'naive_bayes') AS naive_bayes_pred,
 max(prediction) FILTER (WHERE model = 'decision_tree') AS decision_tree_pred,
 max(prediction) FILTER (WHERE model = 'logistic') AS logistic_pred,
 max(prediction) FILTER (WHERE model = 'random_forest') AS random_forest_pred,
 CAST(max(label) AS INTEGER) AS "Actual_bin" FROM ev GROUP BY "Loan_ID\"""")
oracle("confusion", WITH_EVAL + "SELECT model, tn, fp, fn, tp FROM cm")
oracle("metrics_summary", WITH_EVAL + """SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
 round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM met""")
oracle("roc_auc", WITH_EVAL + "SELECT model, classes, round(auc, 6) AS auc, reason FROM auc")
oracle("roc_curve", WITH_EVAL + """SELECT model, CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM auc
 WHERE classes = 2 UNION ALL SELECT model, round(score, 6), round(cum_neg / CAST("N" AS DOUBLE), 6),
 round(cum_pos / CAST("P" AS DOUBLE), 6) FROM cu WHERE "P" > 0 AND "N" > 0""")
oracle("model_report", WITH_EVAL + """SELECT met.model, "rows", tn, fp, fn, tp, round(accuracy, 6) AS accuracy,
 round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, round(auc.auc, 6) AS auc,
 coalesce(reason, '') AS auc_note, CASE WHEN "rows" <> (SELECT count(*) FROM v2)
   THEN format('length mismatch: {} rows vs {} expected', "rows", (SELECT count(*) FROM v2)) END AS error,
 'MAE / MSE / RMSE not applicable to classification' AS regression_note
 FROM met LEFT JOIN auc ON met.model = auc.model""")
oracle("rmse", WITH_DEC + """SELECT risk_level, round(sqrt(avg((predicted_interest_rate - "Interest_Rate") *
 (predicted_interest_rate - "Interest_Rate"))), 6) AS rmse, count(*) AS n FROM dec GROUP BY risk_level""")
oracle("label_agreement", """WITH lab AS (SELECT quality AS label, 1 - toxic AS prediction FROM labels),
cm AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM lab)
SELECT tn, fp, fn, tp, round(coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0), 6) AS accuracy,
 round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
 round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
 round(coalesce(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support FROM cm""")



def _detect_sql() -> str:
    """The columns by their fixed names, and by all rows' values where names tell nothing (c0: key, c1: prediction, c2: score)."""
    tokens = "('Y', 'N', 'YES', 'NO', 'TRUE', 'FALSE', '1', '0', '1.0', '0.0', 'T', 'F')"
    tables = [("naive_bayes", "'Loan_Status_Predicted'", "NULL", "CASE WHEN good >= 0.6E0 THEN 'Y' ELSE 'N' END", None),
              ("decision_tree", "'DT_Predicted'", "NULL", """CASE WHEN "Credit_History" = 1.0E0 THEN '1' ELSE '0' END""", None),
              ("logistic", "'Logistic_Predicted'", "'Logistic_Prob'", "CASE WHEN lr_prob >= 0.5E0 THEN 'Y' ELSE 'N' END", "lr_prob"),
              ("random_forest", "'RF_Predicted'", "'RF_Prob'", "CASE WHEN rf_prob >= 0.5E0 THEN 'Y' ELSE 'N' END",
               """CASE WHEN "Loan_ID" % 97 <> 0 THEN rf_prob END""")]
    parts = []
    for m, pred, prob, c1, c2 in tables:
        cells = [('"Loan_ID"', "c0"), (c1, "c1")] + ([(c2, "c2")] if c2 else [])
        found = "CASE " + " ".join(f"WHEN count({c}) > 0 AND bool_and(upper(trim(CAST({c} AS VARCHAR))) IN {tokens}) THEN '{c}'" for _, c in cells) + " END"
        score = "CASE WHEN bool_and(c2 BETWEEN 0 AND 1) THEN 'c2' END" if c2 else "NULL"
        parts.append(f"SELECT '{m}' AS model, {pred} AS prediction_column, CAST({prob} AS VARCHAR) AS probability_column")
        parts.append(f"""SELECT '{m}_unnamed', {found}, {score} FROM (SELECT {", ".join(f"{x} AS {c}" for x, c in cells)} FROM mp)""")
    return WITH_EVAL + " UNION ALL ".join(parts)


oracle("detect_columns", _detect_sql())

# --- decision log and portfolio --------------------------------------------------------
LOG_BLOCKS = """, inp AS (SELECT "Loan_ID" AS k, "ApplicantIncome" AS i_app, "CoapplicantIncome" AS i_coapp,
  "LoanAmount" AS i_amount, "Loan_Amount_Term" AS i_term, "Credit_History" AS i_credit, dep_text FROM v2fill),
lg AS (SELECT CAST("Loan_ID" AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS uid, ts AS "timestamp", inp.*,
  approved, risk_score, risk_level, default_probability, fraud_detected, recommended_loan_amount,
  predicted_interest_rate, recommendations, segment_name FROM dec JOIN inp ON dec."Loan_ID" = inp.k)
"""
WITH_LOG = WITH_DEC + LOG_BLOCKS
_TS = """strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp\""""

oracle("decision_log", WITH_LOG + f"""SELECT id, uid AS user_id, {_TS}, CAST(CAST(date_trunc('month', "timestamp") AS DATE) AS VARCHAR) AS month,
 approved, round(risk_score, 6) AS risk_score, risk_level, segment_name,
 CAST(len(recommendations) AS INTEGER) AS n_recommendations, dep_text AS dependents_text FROM lg""")
oracle("log_kpis", WITH_LOG + f"SELECT {_KPI} FROM lg")
oracle("user_history", WITH_LOG + f"""SELECT id, uid AS user_id, {_TS}, round(risk_score, 6) AS risk_score, approved
 FROM lg WHERE uid = (SELECT uid FROM (SELECT uid, count(*) AS n FROM lg GROUP BY uid) ORDER BY n DESC, uid LIMIT 1)""")
oracle("all_history", WITH_LOG + f"""SELECT id, uid AS user_id, {_TS}, risk_level, approved FROM lg""")


def _it(x: str) -> str:
    return f"format('{{:,}}', CAST(trunc({x}) AS BIGINT))"


oracle("history_view", WITH_LOG + f"""SELECT id, uid AS user_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS time,
 {_it('i_app')} AS applicant_income, {_it('i_coapp')} AS coapplicant_income,
 {_it('i_app + i_coapp')} AS household_income, {_it('i_amount * 1000.0E0')} AS loan_requested,
 CAST(trunc(i_term) AS BIGINT) AS term_months, printf('%.1f%%', round_even(risk_score, 1)) AS risk_score, risk_level,
 CASE WHEN approved THEN 'Approved' ELSE 'Rejected' END AS decision,
 CASE WHEN fraud_detected THEN 'Alert' ELSE 'Passed' END AS fraud_check FROM lg""")

_DISPLAY = f"""CASE WHEN contains(segment_name, 'Premium') THEN {q(R.DISPLAY_PREMIUM)}
 WHEN contains(segment_name, 'High Risk') OR contains(segment_name, 'Subprime') THEN {q(R.DISPLAY_HIGH_RISK)}
 ELSE {q(R.DISPLAY_REGULAR)} END"""
oracle("segment_points", WITH_LOG + f""", pts AS (SELECT id, i_app + i_coapp AS income, i_amount AS loan_amount,
 {_DISPLAY} AS cluster FROM lg)
SELECT id, round(income, 6) AS income, round(loan_amount, 6) AS loan_amount, cluster, 'application' AS kind FROM pts
UNION ALL SELECT NULL, round(avg(income), 6), round(avg(loan_amount), 6), cluster, 'centre' FROM pts GROUP BY cluster""")


def _answers_sql() -> str:
    score0 = "printf('%.0f', round_even(score, 0))"
    rate1 = "printf('%.1f', round_even(rate, 1))"
    recs = f"CASE WHEN has_dec THEN recommendations ELSE [{q(R.ANSWER_NO_RECOMMENDATIONS)}] END"
    reasons = (f"list_filter([CASE WHEN credit = 0.0 THEN {q(R.REASON_CREDIT)} END, "
               f"CASE WHEN amount > rec THEN {q(R.REASON_AMOUNT)} END], lambda x: x IS NOT NULL)")
    why = "(contains(m, 'why') AND (contains(m, 'reject') OR contains(m, 'denied') OR contains(m, 'approve')))"
    rate_q = "(contains(m, 'interest') OR contains(m, 'rate'))"
    improve = "(contains(m, 'recommend') OR contains(m, 'how to') OR contains(m, 'improve'))"
    return WITH_LOG + f""", lastd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid
   ORDER BY "timestamp" DESC, id DESC) AS rn FROM lg) WHERE rn = 1),
msg AS (SELECT CAST(conv_id AS VARCHAR) AS user_id, turn, text FROM conversations WHERE role = 'user'),
j AS (SELECT msg.user_id, turn, lower(text) AS m, lastd.id IS NOT NULL AS has_dec,
  coalesce(approved, false) AS appr, coalesce(risk_score, 50.0) AS score,
  coalesce(recommended_loan_amount, 100.0) AS rec, coalesce(predicted_interest_rate, 10.5) AS rate,
  coalesce(i_credit, 1.0) AS credit, coalesce(i_amount, 0.0) AS amount, recommendations
  FROM msg LEFT JOIN lastd ON msg.user_id = lastd.uid),
j2 AS (SELECT *, {reasons} AS reasons FROM j)
SELECT user_id, turn,
 CASE WHEN {why} THEN 'why' WHEN {rate_q} THEN 'rate' WHEN {improve} THEN 'improve' ELSE 'status' END AS intent,
 CASE WHEN {why} AND appr THEN printf({q(R.ANSWER_APPROVED)}, {score0}, {rate1})
  WHEN {why} THEN printf({q(R.ANSWER_REJECTED)}, {score0},
     CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ' and ') ELSE {q(R.REASON_DEFAULT)} END,
     {thousands('rec * 1000.0')})
  WHEN {rate_q} THEN printf({q(R.ANSWER_RATE)}, {rate1}, {score0})
  WHEN {improve} THEN {q(R.ANSWER_IMPROVE)} || array_to_string(list_transform({recs}, lambda r: '- ' || r), chr(10))
  ELSE printf({q(R.ANSWER_STATUS)}, CASE WHEN appr THEN 'Approved' ELSE 'Rejected' END, {score0},
     {thousands('rec * 1000.0')}, {rate1}) END AS answer
FROM j2"""


oracle("answers", _answers_sql())


# --- splits, scaling, models ------------------------------------------------------------
def _hash_sql(key: str, seed: int) -> str:
    return f"('0x' || substring(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 13))::BIGINT"


oracle("stratified_split", WITH_V2 + f""", r AS (SELECT "Loan_ID", "Loan_Status_encoded" AS label,
  row_number() OVER (PARTITION BY "Loan_Status_encoded" ORDER BY {_hash_sql('"Loan_ID"', 42)}, "Loan_ID") AS rk
  FROM v2),
c AS (SELECT label, count(*) AS nk FROM r GROUP BY label),
t AS (SELECT sum(nk) AS n, ceil(0.2 * sum(nk)) AS ntest FROM c),
a AS (SELECT label, floor(nk * ntest / n) AS base, nk * ntest / n - floor(nk * ntest / n) AS rem, ntest FROM c, t),
b AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
   <= ntest - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM a)
SELECT "Loan_ID", r.label, CASE WHEN rk <= k THEN 'test' ELSE 'train' END AS split FROM r JOIN b ON r.label = b.label""")

oracle("random_split", WITH_V2 + f"""SELECT "Loan_ID", CASE WHEN {_hash_sql('"Loan_ID"', 42)} < {int(0.2 * 16 ** 13)}
 THEN 'test' ELSE 'train' END AS split FROM v2""")

oracle("standardize", WITH_V2 + """, s AS (SELECT avg("TotalIncome") m1, stddev_pop("TotalIncome") s1, avg("LoanAmount") m2,
 stddev_pop("LoanAmount") s2, avg("Credit_History") m3, stddev_pop("Credit_History") s3 FROM v2)
SELECT "Loan_ID", round(("TotalIncome" - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END, 6) AS "TotalIncome_z",
 round(("LoanAmount" - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END, 6) AS "LoanAmount_z",
 round(("Credit_History" - m3) / CASE WHEN s3 = 0 THEN 1.0 ELSE s3 END, 6) AS "Credit_History_z" FROM v2, s""")


def _nb_sql() -> str:
    cols = FEATURE_COLS
    moments = ", ".join(f'avg("{c}") AS m{i}, var_pop("{c}") AS v{i}' for i, c in enumerate(cols))
    eps = "1e-9 * greatest(" + ", ".join(f'var_pop("{c}")' for c in cols) + ")"
    ll = " + ".join(f'(-0.5 * ln(2 * pi() * (v{i} + e)) - ("{c}" - m{i}) * ("{c}" - m{i}) / (2 * (v{i} + e)))'
                    for i, c in enumerate(cols))
    return WITH_V2 + f""", lab AS (SELECT * FROM v2 WHERE "Loan_Status_encoded" IS NOT NULL),
st AS (SELECT "Loan_Status_encoded" AS cls, count(*) AS nc, {moments} FROM lab GROUP BY 1),
ep AS (SELECT {eps} AS e, count(*) AS n FROM lab),
sc AS (SELECT "Loan_ID", cls, ln(nc / n) + {ll} AS ll FROM lab, st, ep)
SELECT "Loan_ID", CAST(arg_max(cls, ll) AS INTEGER) AS prediction FROM sc GROUP BY "Loan_ID\""""


oracle("gaussian_nb", _nb_sql())


# --- streaming (equal to the batch statements) ----------------------------------------
oracle("score_stream", WITH_DEC + """SELECT "Loan_ID", round(default_probability, 6) AS default_probability,
 round(risk_score, 6) AS risk_score, risk_level, approved, round(recommended_loan_amount, 6) AS recommended_loan_amount,
 round(predicted_interest_rate, 6) AS predicted_interest_rate, segment_name,
 array_to_string(recommendations, ' | ') AS recommendations, CAST(len(attr_keys) AS INTEGER) AS n_attributions FROM dec""")
oracle("request_features", f"""WITH {LOANS}, rq AS (SELECT "Loan_ID", "Gender", "Education", "Self_Employed",
 CASE WHEN "Loan_ID" % 11 = 0 THEN 'Coast' ELSE "Property_Area" END AS area,
 CASE WHEN "Loan_ID" % 23 = 0 THEN 'Unknown' ELSE "Married" END AS married,
 CASE WHEN "Loan_ID" % 13 = 0 THEN '3 +' WHEN "Loan_ID" % 29 = 0 THEN ' 2 ' ELSE "Dependents" END AS dep,
 coalesce(CASE WHEN "Loan_ID" % 17 = 0 THEN 0.0E0 WHEN "Loan_ID" % 31 = 0 THEN -12.0E0 ELSE "Loan_Amount_Term" END, 0.0E0) AS term,
 coalesce("LoanAmount", 0.0E0) AS amount, coalesce("Credit_History", 0.0E0) AS credit, "ApplicantIncome" AS a, "CoapplicantIncome" AS c
 FROM loans)
SELECT "Loan_ID", CASE "Gender" WHEN 'Female' THEN 0.0E0 ELSE 1.0E0 END AS "Gender",
 CASE married WHEN 'Yes' THEN 1.0E0 ELSE 0.0E0 END AS "Married",
 CASE dep WHEN '3+' THEN 3.0E0 WHEN '1' THEN 1.0E0 WHEN '2' THEN 2.0E0 WHEN ' 2 ' THEN 2.0E0 ELSE 0.0E0 END AS "Dependents",
 CASE "Education" WHEN 'Graduate' THEN 1.0E0 ELSE 0.0E0 END AS "Education",
 CASE "Self_Employed" WHEN 'Yes' THEN 1.0E0 ELSE 0.0E0 END AS "Self_Employed",
 round(a, 6) AS "ApplicantIncome", round(c, 6) AS "CoapplicantIncome", round(amount, 6) AS "LoanAmount",
 round(term, 6) AS "Loan_Amount_Term", round(credit, 6) AS "Credit_History",
 CASE area WHEN 'Rural' THEN 0.0E0 WHEN 'Urban' THEN 2.0E0 ELSE 1.0E0 END AS "Property_Area",
 round(a + c, 6) AS "TotalIncome", round(ln(1 + amount), 6) AS "LoanAmount_log",
 round(amount * 1000 / ((a + c) * CASE WHEN term <= 0 THEN 360 ELSE term END + 1), 6) AS "Debt_to_Income" FROM rq""")
oracle("kpi_stream", ORACLE["kpis_by_area"])
oracle("kpi_stream_windowed", WITH_DEC + f""", w AS (SELECT *, time_bucket(INTERVAL 30 DAY, CAST(ts AS TIMESTAMP),
  TIMESTAMP '1970-01-01') AS ws FROM dec)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
 {_KPI} FROM w GROUP BY ws HAVING ws + INTERVAL 30 DAY <= (SELECT max(ts) FROM dec) - INTERVAL 60 DAY""")
