"""Registered queries: one Spark plan and (where SQL can express it) one DuckDB oracle per operator."""
