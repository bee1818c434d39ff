"""Structured Streaming forms of the change operators."""

from changeflow.streaming.changes import (
    apply_stream,
    compact,
    dedup_stream,
    events_as_changes,
    log_batches,
    read_changes,
    read_table,
    run_available,
    stream_events_to_files,
    table_stream,
)
from changeflow.streaming.flow import flow_records, kafka_available, read_kafka_changes, start_flow

__all__ = [name for name in dir() if not name.startswith("_")]
