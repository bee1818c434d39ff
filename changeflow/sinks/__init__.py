"""Writers."""

from changeflow.sinks.records import avro_name, avro_safe_names, connect_schema, json_with_schema, to_kafka_string
from changeflow.sinks.tables import (
    append,
    committed_versions,
    create_if_absent,
    current_version,
    load_all,
    read_current,
    reset,
    write_bucketed,
)

__all__ = [name for name in dir() if not name.startswith("_")]
