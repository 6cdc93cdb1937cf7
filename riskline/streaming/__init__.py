"""Structured Streaming: scoring an application stream (ST1) and portfolio KPIs (ST2)."""

from riskline.streaming.scoring import (application_stream, kpi_stream, score_stream,  # noqa: F401
                                        windowed_kpi_stream)
