"""changeflow: change-data operators expressed as Spark DataFrame plans.

Layout
------
sources/     readers: parquet tables, document files, JDBC, catalog frames, series
sinks/       writers: append / ignore / overwrite tables, Kafka-shaped records, HTTP
functions/   column helpers: reproducible hash draws, null-safe comparisons, name parts
operators/   seeds, checks, mutations, capture, transforms, joins, aggregates, nesting
streaming/   Structured Streaming change feeds, replay in foreachBatch, dedup
plans/       the registered query plans and their DuckDB oracles
"""

from changeflow.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
