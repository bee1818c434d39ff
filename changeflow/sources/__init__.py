"""Readers."""

from changeflow.sources.catalog import indexes_frame, schemas_frame, tables_frame
from changeflow.sources.jdbc import key_bounds, scan_jdbc, scan_jdbc_auto, scan_jdbc_strings, string_cuts, write_jdbc
from changeflow.sources.tables import scan_documents, scan_table, series, table_path

__all__ = [
    "scan_table",
    "scan_documents",
    "series",
    "table_path",
    "scan_jdbc",
    "scan_jdbc_auto",
    "scan_jdbc_strings",
    "string_cuts",
    "key_bounds",
    "write_jdbc",
    "tables_frame",
    "indexes_frame",
    "schemas_frame",
]
