"""Derived features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def total_income(applicant="ApplicantIncome", coapplicant="CoapplicantIncome") -> Column:
    """P7."""
    return _col(applicant) + _col(coapplicant)


def log_guarded(c) -> Column:
    """0 for values ≤ 0, natural log otherwise (v1 ``LoanAmount_log``)."""
    c = _col(c)
    return F.when(c <= 0, F.lit(0.0)).otherwise(F.ln(c))


def log1p(c) -> Column:
    """ln(1 + x) (v2 ``LoanAmount_log``)."""
    return F.log1p(_col(c))


def debt_to_income(amount="LoanAmount", total="TotalIncome", term="Loan_Amount_Term",
                   nonpositive_term: bool = True) -> Column:
    """P10: ``amount·1000 / (income·term' + 1)``, term' = 360 for a term ≤ 0
    (request path) or only for a term of exactly 0 (training path)."""
    t = _col(term)
    bad = (t <= 0) if nonpositive_term else (t == 0)
    t2 = F.when(bad, F.lit(360.0)).otherwise(t)
    return (_col(amount) * F.lit(1000.0)) / (_col(total) * t2 + F.lit(1.0))


def default_label(approved) -> Column:
    """1 − approved."""
    return F.lit(1) - _col(approved)


def clip(c, lo: float, hi: float) -> Column:
    """Bound a value to [lo, hi]."""
    return F.least(F.greatest(_col(c), F.lit(lo)), F.lit(hi))


def gaussian_noise(key, seed: int = 42, sd: float = 0.2) -> Column:
    """N(0, sd) drawn from the row key by Box–Muller over two 64-bit hashes, so the
    value does not depend on partitioning or task order."""
    def uniform(salt):
        h = F.xxhash64(_col(key).cast("string"), F.lit(seed), F.lit(salt))
        return (F.pmod(h, F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.lit(sd) * F.sqrt(F.lit(-2.0) * F.ln(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(2))


def interest_label(credit="Credit_History", amount="LoanAmount", total="TotalIncome",
                   key="Loan_ID", seed: int = 42, noise_sd: float = 0.2) -> Column:
    """clip(8 + 5(1−credit) + 4·amount/(income/10 + 1) + noise, 6.5, 18)."""
    base = (F.lit(8.0) + F.lit(5.0) * (F.lit(1.0) - _col(credit))
            + F.lit(4.0) * (_col(amount) / (_col(total) / F.lit(10.0) + F.lit(1.0))))
    if noise_sd:
        base = base + gaussian_noise(key, seed, noise_sd)
    return clip(base, 6.5, 18.0)
