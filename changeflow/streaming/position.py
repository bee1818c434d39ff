"""CAP-11: a feed that starts with a snapshot, goes on from its position, and starts anew when the position is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.sinks.tables import _fs
from changeflow.streaming.changes import run_available


def run_feed(snapshot_events: DataFrame, log: DataFrame, root: str) -> DataFrame:
    """Deliver below ``root`` what is due, and return all that was delivered there.

    Without a position (the stream checkpoint below ``root``) the feed begins:
    ``snapshot_events``, ``r`` events at the position they were read at, are
    written first, then the events of the stream ``log`` behind that position.
    With one it goes on where it stopped: the snapshot is not read again, and the
    position of the snapshot that was written decides, not that of a later one.
    To drop the position, use another ``root``: the consumer gets the rows as
    they stand and every later event once. A run that ends between the snapshot
    and the first events writes the snapshot again, in place.
    """
    spark = log.sparkSession
    fs, position, _ = _fs(spark, f"{root}/_position/offsets")
    if not fs.exists(position):
        snapshot_events.write.mode("overwrite").parquet(f"{root}/snapshot")
    written = spark.read.schema(snapshot_events.schema).parquet(f"{root}/snapshot")
    at = written.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("seq")).first()["seq"]
    run_available(log.filter(F.col("seq") > at), f"{root}/log", f"{root}/_position")
    fs, delivered, _ = _fs(spark, f"{root}/log")
    return written.unionByName(spark.read.schema(log.schema).parquet(f"{root}/log")) if fs.exists(delivered) else written
