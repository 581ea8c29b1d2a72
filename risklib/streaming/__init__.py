"""Structured Streaming operators (STR1-STR7) and alert helpers."""
