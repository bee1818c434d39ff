"""CAP-13: ad-hoc snapshots requested through a signal collection.

A signal row is (id, type, data); ``data`` is JSON text naming the
collections to snapshot. Delivery is at least once, so signals are
deduplicated by ``id`` before use. Requested snapshots are read in key
chunks, as in DBLog (Andreakis & Papapanagiotou, arXiv:2010.12597): rows of a
chunk whose key also has a log event inside the chunk's own watermark window are
dropped, because the log already carries a newer state of that row
(``windowed_snapshot``; ``chunked_snapshot`` is the simple form with one window
for all chunks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.operators.capture import snapshot
from changeflow.session import broadcast_if_bounded

# Fixed values of the signal protocol.
EXECUTE_SNAPSHOT = "execute-snapshot"
SIGNAL_DATA_DDL = "`data-collections` array<string>, type string"


def snapshot_requests(signals: DataFrame, capture_list: DataFrame, column: str = "table") -> DataFrame:
    """Tables to re-snapshot: (signal id, table, snapshot_type), capture list only.

    Signals are few; they are deduplicated by id, parsed without inference and
    semi-joined with the (broadcast when provably small) capture list.
    """
    s = signals.dropDuplicates(["id"]).filter(F.col("type") == F.lit(EXECUTE_SNAPSHOT))
    parsed = F.from_json(F.col("data"), SIGNAL_DATA_DDL)
    req = s.select(
        F.col("id").alias("signal_id"),
        F.explode(parsed["data-collections"]).alias(column),
        parsed["type"].alias("snapshot_type"),
    )
    allowed = broadcast_if_bounded(capture_list.select(column).distinct())
    return req.join(allowed, column, "left_semi")


def chunked_snapshot(df: DataFrame, table: str, key: list[str], seq: int, chunk_size: int,
                     window_events: DataFrame | None = None) -> DataFrame:
    """``r`` events of ``df`` tagged with their key chunk ``floor(key / chunk_size)``.

    ``window_events`` are the log events seen while the whole table was read,
    one window for all chunks; their keys are removed (left anti join on the
    key struct), so replaying snapshot and log never regresses a row.
    """
    ev = snapshot(df, table, key, seq).withColumn(
        "chunk", F.floor(F.col(f"key.{key[0]}") / F.lit(chunk_size)).cast("bigint")
    )
    if window_events is None:
        return ev
    seen = window_events.filter(F.col("table") == F.lit(table)).select("key").distinct()
    return ev.join(seen, "key", "left_anti")


def key_chunk(key: Column, chunk_size: int) -> Column:
    """The chunk of an integer key: ``chunk_size`` consecutive keys each, in whole-number arithmetic."""
    k = key.cast("bigint")
    return F.call_function("div", k - F.pmod(k, F.lit(chunk_size)), F.lit(chunk_size))


def windowed_snapshot(df: DataFrame, table: str, key: list[str], chunk_size: int, requests: DataFrame, windows: DataFrame, log: DataFrame) -> DataFrame:
    """``r`` events of ``df`` for every signal that asks for ``table``, each chunk with its own watermarks.

    ``requests`` come from ``snapshot_requests``; ``windows`` (signal_id, table,
    chunk, low, high) hold the log positions before and after each chunk was
    read for a signal; windows of signals that nobody sent, and chunks without a
    window, give nothing. A row is dropped if ``log`` has an event of its key
    with low < seq <= high of its chunk and signal; the others stand at position
    ``high``, so that with the log replayed no row regresses. Log events meet the
    windows in one equi-join on the chunk with the interval as its condition, and
    are reduced to distinct (signal, key) before they meet the rows.
    """
    asked = broadcast_if_bounded(requests.filter(F.col("table") == table).select("signal_id").distinct())
    own = windows.filter(F.col("table") == table).join(asked, "signal_id", "left_semi")
    own = broadcast_if_bounded(own.select("signal_id", F.col("chunk").alias("_chunk"), "low", "high"))
    rows = snapshot(df, table, key, 0).drop("seq").withColumn("chunk", key_chunk(F.col(f"key.{key[0]}"), chunk_size))
    rows = rows.join(own, F.col("chunk") == F.col("_chunk")).select("signal_id", "chunk", "table", "op", "key", "before", "after", "commit_ts", F.col("high").alias("seq"))
    seen = log.filter(F.col("table") == table).select("key", "seq", key_chunk(F.col(f"key.{key[0]}"), chunk_size).alias("chunk"))
    inside = (F.col("chunk") == F.col("_chunk")) & (F.col("seq") > F.col("low")) & (F.col("seq") <= F.col("high"))
    return rows.join(seen.join(own, inside).select("signal_id", "key").distinct(), ["signal_id", "key"], "left_anti")
