"""Registered queries over the shared tables, each with its DuckDB counterpart where SQL can say it."""
