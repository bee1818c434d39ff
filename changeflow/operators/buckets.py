"""Keyed tables stored by key bucket, rewritten only where a batch lands.

Layout: ``<path>/_run=<run>/_bucket=<b>`` folders with
``_bucket = pmod(xxhash64(key...), B)``, and numbered manifests that name the
run holding each bucket. A mutation batch is tagged with the same bucket
function; only the buckets it touches (at most B values, collected) are read,
merged with the batch and written under a new run. The new manifest is written
aside and renamed into place as the last step: readers see the whole table
before the batch or after it, and a bucket whose rows are all deleted is simply
not in the manifest any more. Folders of earlier runs stay until removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.operators.mutate import apply_changes, upsert
from changeflow.sinks.tables import read_text, write_text

BUCKET = "_bucket"


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(buckets)).cast("int")


def _writers(spark: SparkSession, buckets: int, writers_per_bucket: int | None) -> int:
    """Tasks per bucket: by default the table's buckets share ``spark.sql.shuffle.partitions``."""
    if writers_per_bucket is not None:
        return writers_per_bucket
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)


def _spread(df: DataFrame, key: list[str], groups: int, writers: int) -> DataFrame:
    """Distribute rows so each bucket present is written by ``writers`` tasks.

    Repartitioning by the bucket alone would hand a whole bucket to one task.
    A second hash of the key (murmur3, independent of the bucket's xxhash64)
    picks the task within the bucket, so a bucket folder gets a bounded number
    of files and no task writes more than its share. ``groups`` is the number
    of buckets with data (all of them when a table is created, the touched
    ones when a batch rewrites some), which sets the number of tasks.
    """
    sub = F.pmod(F.hash(*[F.col(k) for k in key]), F.lit(writers))
    return df.repartition(max(1, groups * writers), F.col(BUCKET), sub)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest: the run of each bucket, and the schema."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{path}/_manifests") if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        raise FileNotFoundError(f"no bucketed table at {path}")
    return max(numbers), json.loads(read_text(spark, f"{path}/_manifests/{max(numbers)}.json"))


def _publish(spark: SparkSession, path: str, number: int, runs: dict[str, str], schema: T.StructType) -> None:
    aside = f"{path}/_manifests/.{uuid.uuid4().hex}"
    write_text(spark, aside, json.dumps({"runs": runs, "schema": schema.jsonValue()}))
    fs, src = _folder(spark, aside)
    _, dst = _folder(spark, f"{path}/_manifests/{number}.json")
    if not fs.rename(src, dst):
        raise RuntimeError(f"manifest {number} of {path} was published by another writer")


def _write_run(df: DataFrame, path: str, key: list[str], buckets: int, groups: int, writers: int) -> dict[str, str]:
    """Write ``df`` under a new run; the buckets that have rows, with the run's name."""
    run = f"run{uuid.uuid4().hex}"
    tagged = df.withColumn(BUCKET, bucket_of(key, buckets))
    _spread(tagged, key, groups, writers).write.partitionBy(BUCKET).parquet(f"{path}/_run={run}")
    found = _names(df.sparkSession, f"{path}/_run={run}")
    return {n.split("=", 1)[1]: run for n in found if n.startswith(f"{BUCKET}=")}


def write_buckets(df: DataFrame, path: str, key: list[str], buckets: int,
                  writers_per_bucket: int | None = None) -> None:
    """Create (or replace) a keyed table in bucket layout.

    Choose ``buckets`` so one bucket is a few GiB: a batch then rewrites only
    the few buckets its keys fall in.
    """
    spark = df.sparkSession
    runs = _write_run(df, path, key, buckets, buckets, _writers(spark, buckets, writers_per_bucket))
    number = _manifest(spark, path)[0] + 1 if _names(spark, f"{path}/_manifests") else 0
    _publish(spark, path, number, runs, df.schema)


def read_buckets(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The table's rows (with ``_bucket``), or those of some buckets; other buckets are not listed or read."""
    _, manifest = _manifest(spark, path)
    schema = T.StructType.fromJson(manifest["schema"])
    runs = {b: run for b, run in manifest["runs"].items() if only is None or int(b) in only}
    if not runs:
        return spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
    paths = [f"{path}/_run={run}/{BUCKET}={b}" for b, run in runs.items()]
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).option("basePath", path).parquet(*paths)
    return df.drop("_run")


def _touched(batch: DataFrame) -> list[int]:
    """The distinct buckets of a batch: at most B small integers reach the driver."""
    return sorted(r[0] for r in batch.select(BUCKET).distinct().collect())


def _replace(spark: SparkSession, merged: DataFrame, path: str, key: list[str], buckets: int, touched: list[int]) -> None:
    number, manifest = _manifest(spark, path)
    new = _write_run(merged, path, key, buckets, len(touched), _writers(spark, buckets, None))
    kept = {b: run for b, run in manifest["runs"].items() if int(b) not in set(touched)}
    _publish(spark, path, number + 1, kept | new, merged.schema)


def upsert_buckets(spark: SparkSession, path: str, src: DataFrame, key: list[str], set_cols: list[str],
                   buckets: int, defaults: dict[str, Column] | None = None,
                   touch: dict[str, Column] | None = None) -> list[int]:
    """MUT-1 against a bucket-laid-out table; returns the buckets rewritten."""
    batch = src.withColumn(BUCKET, bucket_of(key, buckets))
    touched = _touched(batch)
    if not touched:
        return []
    target = read_buckets(spark, path, touched).drop(BUCKET)
    merged = upsert(target, batch.drop(BUCKET), key, set_cols, defaults=defaults, touch=touch)
    _replace(spark, merged, path, key, buckets, touched)
    return touched


def apply_buckets(spark: SparkSession, path: str, events: DataFrame, key: list[str], buckets: int) -> list[int]:
    """DER-1 against a bucket-laid-out table; returns the buckets rewritten."""
    ev = events.withColumn(BUCKET, bucket_of([f"key.{k}" for k in key], buckets))
    touched = _touched(ev)
    if not touched:
        return []
    target = read_buckets(spark, path, touched).drop(BUCKET)
    merged = apply_changes(target, ev.drop(BUCKET), key, keep_markers="_deleted" in target.columns)
    _replace(spark, merged, path, key, buckets, touched)
    return touched
