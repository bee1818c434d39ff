"""Batch readers: captured tables, document files, row series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from changeflow.schemas import TABLES


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def scan_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-1: read one captured table whole.

    A declared schema avoids inference; Parquet keeps column pruning and
    predicate pushdown, so later ``select``/``filter`` reach the scan.
    """
    schema = schema or TABLES.get(name)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


def scan_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-4: a document collection stored as JSON lines, read with a nested schema.

    The schema is always declared (collections carry no validator, so inference
    would drift between files); fields missing in a document come back NULL.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def series(spark: SparkSession, lo: int, hi: int, name: str = "n") -> DataFrame:
    """SRC-6: ``generate_series(lo, hi)`` inclusive, as a splittable range."""
    return spark.range(lo, hi + 1).withColumnRenamed("id", name)
