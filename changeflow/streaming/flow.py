"""CAP-14 as a stream: source -> include list -> transforms -> topic -> string records -> sink.

The same steps as the batch ``change_feed``; the sink is Kafka when its jar is
present (``fmt="kafka"`` with ``kafka.bootstrap.servers``) or files otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.operators.transform import Transform, chain, include_tables, per_key_order, route
from changeflow.sinks.records import to_kafka_string
from changeflow.streaming.changes import FLUSH_INTERVAL


KAFKA_PROVIDER = "org.apache.spark.sql.kafka010.KafkaSourceProvider"


def kafka_available(spark) -> bool:
    """Whether the Kafka connector is on the classpath (it is not bundled with Spark)."""
    try:
        spark._jvm.java.lang.Class.forName(KAFKA_PROVIDER, False, spark._jvm.Thread.currentThread()
                                           .getContextClassLoader())
        return True
    except Exception:
        return False


def read_kafka_changes(spark, servers: str, topics: list[str], schema) -> DataFrame:
    """SRC-5 from Kafka: string records whose JSON value is a change event of ``schema``."""
    if not kafka_available(spark):
        raise RuntimeError("the Kafka connector (spark-sql-kafka) is not on the classpath")
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load())
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def flow_records(events: DataFrame, include: list[str], transforms: list[Transform], prefix: str,
                 value: Column, ordered: bool = False) -> DataFrame:
    """The record frame of a flow; identical for a batch or a streaming input.

    With ``ordered`` the events of each key are grouped into one task in
    ascending ``seq`` before serialization (a batch-only step; streams apply
    it per micro-batch, see ``start_flow``).
    """
    ev = chain(include_tables(events, include), transforms)
    if ordered:
        ev = per_key_order(ev)
    return to_kafka_string(route(ev, prefix), F.col("topic"), F.col("key"), value)


def start_flow(events: DataFrame, include: list[str], transforms: list[Transform], prefix: str, value: Column,
               checkpoint: str, out_path: str | None = None, fmt: str = "parquet",
               options: dict | None = None, available_now: bool = True, ordered: bool = False):
    """Start the flow; ``checkpoint`` is its durable position (a new one restarts it).

    ``ordered`` delivers each key's events of a micro-batch from one task in
    ``seq`` order (what a keyed log needs); it runs in ``foreachBatch``, and file
    output goes to ``out_path/batch_id=<n>`` so a replayed batch replaces its own
    folder.
    """
    if fmt == "kafka" and not kafka_available(events.sparkSession):
        raise RuntimeError("the Kafka connector (spark-sql-kafka) is not on the classpath; "
                           "use a file sink (fmt='parquet' or 'json') or add the connector")
    if ordered:
        def deliver(batch: DataFrame, batch_id: int) -> None:
            recs = flow_records(batch, include, transforms, prefix, value, ordered=True)
            if fmt == "kafka":
                recs.write.format("kafka").options(**(options or {})).save()
            else:
                recs.write.mode("overwrite").format(fmt).save(f"{out_path}/batch_id={batch_id}")

        w = events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=FLUSH_INTERVAL)
        return w.start()
    records = flow_records(events, include, transforms, prefix, value)
    w = records.writeStream.format(fmt).option("checkpointLocation", checkpoint).options(**(options or {}))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=FLUSH_INTERVAL)
    return w.start(out_path) if out_path else w.start()
