"""Table writers: append, create-if-absent, reset, all-or-nothing multi-table loads."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK-1: ``INSERT ... SELECT``: add the rows as new files."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def create_if_absent(df: DataFrame, path: str) -> None:
    """SNK-2: ``CREATE TABLE IF NOT EXISTS``: an existing table is left alone."""
    df.write.mode("ignore").parquet(path)


def reset(df: DataFrame, path: str) -> None:
    """SNK-3: drop, recreate and reload (one overwrite)."""
    df.write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: list[str], buckets: int, path: str | None = None) -> None:
    """Store a keyed table bucketed and sorted on its key.

    Later joins and groupings on the key with the same bucket count read it
    without a shuffle (capture, upsert and apply all join on the key).
    """
    w = df.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)


# ---------------------------------------------------------------------------
# MUT-7: several tables replaced together, all or nothing.
# Layout: <root>/v=<version>/<table>/ data, and <root>/_commits/<version> markers.
# A version is visible only once its marker exists; the marker is written
# after every table of the version is complete, so readers see all or none.
# ---------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def read_text(spark: SparkSession, path: str) -> str | None:
    """Small metadata file through the cluster's file system (None if absent)."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small metadata file (written whole, then closed)."""
    fs, p, jvm = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    fs, p, jvm = _fs(spark, f"{root}/_commits")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())


def current_version(spark: SparkSession, root: str) -> int | None:
    versions = committed_versions(spark, root)
    return versions[-1] if versions else None


def load_all(spark: SparkSession, root: str, frames: dict[str, DataFrame], version: int | None = None) -> int:
    """Write every frame under a new version, then publish it with one marker.

    A failure before the marker leaves the previous version current; a
    re-run with the same ``version`` overwrites the unpublished attempt.
    """
    if version is None:
        version = int(time.time() * 1000)
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/v={version}/{name}")
    fs, marker, jvm = _fs(spark, f"{root}/_commits/{version}")
    out = fs.create(marker, True)
    out.close()
    return version


def read_current(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """Read one table of the newest published version (resolved once per call)."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no published version under {root}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/v={version}/{name}")
