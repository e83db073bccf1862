"""Registered queries, their derived inputs and their DuckDB statements."""
