"""Categorical encoders (P1–P4), Dependents parsing (P5), numeric parsing (P6),
binary normalisation (P15), Y/N labels (P16) and the probability threshold (P17)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Category codes used by the reference (must stay as they are).
# ---------------------------------------------------------------------------
GENDER = {"Male": 1, "Female": 0}
MARRIED = {"Yes": 1, "No": 0}
EDUCATION = {"Graduate": 1, "Not Graduate": 0}
SELF_EMPLOYED = {"Yes": 1, "No": 0}
PROPERTY_AREA = {"Rural": 0, "Semiurban": 1, "Urban": 2}
LOAN_STATUS = {"Y": 1, "N": 0}

V1_MAPS = {
    "Gender": GENDER,
    "Married": MARRIED,
    "Education": EDUCATION,
    "Self_Employed": SELF_EMPLOYED,
    "Property_Area": PROPERTY_AREA,
}
# Production maps also know the form's "Unknown" choice.
V2_MAPS = {
    "Gender": {**GENDER, "Unknown": 1},
    "Married": {**MARRIED, "Unknown": 0},
    "Education": {**EDUCATION, "Unknown": 0},
    "Self_Employed": {**SELF_EMPLOYED, "Unknown": 0},
    "Property_Area": {**PROPERTY_AREA, "Unknown": 1},
}
# Codes for values a scoring request may carry that no map knows.
REQUEST_DEFAULTS = {"Gender": 1, "Married": 0, "Education": 0, "Self_Employed": 0, "Property_Area": 1}
# Token sets of the prediction normalisers.
TRUE_TOKENS = ("Y", "YES", "T", "TRUE")
FALSE_TOKENS = ("N", "NO", "F", "FALSE")
TRUTH_TOKENS = ("Y", "1", "YES", "TRUE")
# ---------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(c: Column, mapping: Mapping[str, int]) -> Column:
    """CASE c WHEN k1 THEN v1 ... END (null for any other value, null for null)."""
    out = None
    for k, v in mapping.items():
        out = (F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v)))
    return out


def encode_strict(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Known value → code, anything else → null."""
    return _lookup(_col(c), mapping)


def encode_passthrough(c: str | Column, mapping: Mapping[str, int]) -> Column:
    """Known value → code (as text), any other value kept as it is."""
    c = _col(c)
    return F.coalesce(_lookup(c, mapping).cast("string"), c.cast("string"))


def encode_default(c: str | Column, mapping: Mapping[str, int], default: int) -> Column:
    """Known value → code, anything else (null included) → ``default``."""
    return F.coalesce(_lookup(_col(c), mapping), F.lit(default))


def strip(c: Column) -> Column:
    """White space of any kind taken off both ends (``str.strip``)."""
    return F.regexp_replace(c, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


# A text Python's float() accepts (underscores between digits, nan/inf words).
_NUMERIC_RE = (r"^[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"
               r"|^[+-]?(nan|inf|infinity)$")


def to_numeric(c: str | Column) -> Column:
    """Text → double, unparseable → null (Python rules: ``1_0`` is 10, ``1d`` is not a number)."""
    t = _col(c).cast("string")
    s = strip(t)
    ok = F.lower(s).rlike(_NUMERIC_RE)
    parsed = F.when(ok, F.regexp_replace(s, "_", "").try_cast("double"))
    # texts of digits and points alone need no pattern: the cast follows the same rules for them
    return F.when(F.translate(t, "0123456789.", "") == "", t.try_cast("double")).otherwise(parsed)


def dependents_to_number(c: str | Column, default: float | None = 0.0,
                         plus_forms: tuple[str, ...] = ("3+", "3 +")) -> Column:
    """P5: ``3+`` (and ``3 +``) → 3, else numeric parse, else ``default``."""
    c = _col(c)
    parsed = to_numeric(c)
    if default is not None:
        parsed = F.coalesce(parsed, F.lit(float(default)))
    return F.when(c.isin(*plus_forms), F.lit(3.0)).otherwise(parsed)


def dependents_to_int(c: str | Column, default: int = 0, plus_forms: tuple[str, ...] = ("3+",)) -> Column:
    """P5 (request form): ``3+`` → 3, else Python ``int()`` of the text, else ``default``."""
    c = _col(c)
    s = strip(c.cast("string"))
    as_int = F.when(s.rlike(r"^[+-]?\d(_?\d)*$"), F.regexp_replace(s, "_", "").try_cast("int"))
    return F.when(c.isin(*plus_forms), F.lit(3)).otherwise(F.coalesce(as_int, F.lit(default)))


def normalize_binary(c: str | Column, mode: str = "zero") -> Column:
    """One normaliser for predictions and truth labels.

    ``upper(strip(text))``: Y/YES/T/TRUE → 1, N/NO/F/FALSE → 0, a number ≥ 0.5 → 1 else 0.

    * ``null``  – null or unparseable → null
    * ``zero``  – null or unparseable → 0
    * ``truth`` – 1 only for Y, 1, YES, TRUE; everything else 0
    """
    t = _col(c).cast("string")
    s = F.upper(strip(t))
    # tokens as they are written need no pattern
    if mode == "truth":
        plain = F.when(t.isin(*TRUTH_TOKENS), F.lit(1)).when(t.isin(*FALSE_TOKENS, "0"), F.lit(0))
        return plain.otherwise(F.when(s.isin(*TRUTH_TOKENS), F.lit(1)).otherwise(F.lit(0)))
    plain = F.when(t.isin(*TRUE_TOKENS, "1"), F.lit(1)).when(t.isin(*FALSE_TOKENS, "0"), F.lit(0))
    num = to_numeric(s)
    by_number = F.when(F.isnan(num), F.lit(0)).when(num >= 0.5, F.lit(1)).when(num.isNotNull(), F.lit(0))
    out = (F.when(s.isin(*TRUE_TOKENS), F.lit(1))
            .when(s.isin(*FALSE_TOKENS), F.lit(0))
            .otherwise(by_number))
    if mode == "null":
        return plain.otherwise(out)
    if mode == "zero":
        return plain.otherwise(F.coalesce(out, F.lit(0)))
    raise ValueError(f"unknown mode {mode!r}")


def label_yn(c: str | Column) -> Column:
    """1 → 'Y', anything else → 'N'."""
    return F.when(_col(c) == 1, F.lit("Y")).otherwise(F.lit("N"))


def threshold(prob: str | Column, cut: float = 0.5) -> Column:
    """Probability ≥ cut → 1 (inclusive), else 0."""
    return (_col(prob) >= F.lit(cut)).cast("int")
