"""Readers, writers and the loan view over the driver tables."""

from riskline.sources.loans import loan_view, read_table  # noqa: F401
