"""Registered query plans and their DuckDB oracles."""
