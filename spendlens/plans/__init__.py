"""Registered queries: each operator bound to the driver's tables, plus its DuckDB oracle."""
