"""Operators: each is a plain ``DataFrame -> DataFrame`` function over built-in expressions."""

from changeflow.operators.aggregates import counters, exists_flags, first_by, max_or_one, row_counts, set_delta
from changeflow.operators.buckets import apply_buckets, read_buckets, upsert_buckets, write_buckets
from changeflow.operators.capture import (
    capture,
    capture_candidates,
    capture_list_asof,
    capture_list_filter,
    handoff,
    net_changes,
    net_changes_intervals,
    replace_capture_list,
    require_ordered,
    snapshot,
)
from changeflow.operators.cascade import Reference, delete_cascading, deleted_keys
from changeflow.operators.checks import (
    fill_defaults,
    foreign_key,
    foreign_key_batch,
    foreign_keys,
    max_length,
    not_null,
    referenced,
    required,
    unique,
)
from changeflow.operators.digests import capture_by_digest, changed_ranges, range_digests
from changeflow.operators.joins import absent_in, exists_in, lookup
from changeflow.operators.maintain import aggregate_rows, fold_changes
from changeflow.operators.mutate import (
    apply_changes,
    assign_ids,
    cascade_delete,
    delete_keys,
    doc_upsert,
    find_or_create,
    insert_if_absent,
    next_id,
    number_within,
    upsert,
)
from changeflow.operators.signals import chunked_snapshot, snapshot_requests, windowed_snapshot
from changeflow.operators.nesting import doc_summary, nest, reconcile_documents, reconcile_totals, unnest
from changeflow.operators.transform import (
    chain,
    event_key,
    from_mixed,
    include_databases,
    include_schemas,
    include_tables,
    parse_json_array,
    parse_json_object,
    per_key_order,
    route,
    strict_lookup,
    to_mixed,
    tombstones,
    transform_if,
    unwrap,
)

__all__ = [name for name in dir() if not name.startswith("_")]
