from risklib.sources.tables import (TABLES, read_table, scored, scored_models, tx_events,
                                    tx_lines, tx_orders)
from risklib.sources.files import read_transactions_csv, read_upload_csv, validate_schema
from risklib.sources.generator import generate_transactions

__all__ = ["TABLES", "read_table", "tx_events", "tx_orders", "tx_lines", "scored",
           "scored_models", "read_transactions_csv", "read_upload_csv", "validate_schema",
           "generate_transactions"]
