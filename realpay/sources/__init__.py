"""Sources: the given Parquet tables, CSV with NA tokens, derived fixtures."""

from realpay.sources.csv import DEFAULT_NA_TOKENS, read_table, tokens_to_null
from realpay.sources.tables import TABLES, load_table, register_tables

__all__ = [
    "DEFAULT_NA_TOKENS",
    "TABLES",
    "load_table",
    "read_table",
    "register_tables",
    "tokens_to_null",
]
