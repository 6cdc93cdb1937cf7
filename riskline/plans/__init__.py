"""Query registry (Spark) and the matching DuckDB oracle statements."""
