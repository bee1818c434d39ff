"""DER-4 with bounded state: what was seen of a numbered source is kept as ranges, not as ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "starts array<bigint>, ends array<bigint>"


def merge_ranges(starts: np.ndarray, ends: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ascending ranges (ends included) with the numbers ``new`` put in; ranges that touch become one."""
    a, b = np.r_[starts, new], np.r_[ends, new]
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.r_[True, a[1:] > b[:-1] + 1] if len(a) else np.empty(0, bool)
    at = np.flatnonzero(first)
    return a[at], b[np.r_[at[1:] - 1, len(b) - 1]] if len(at) else b


def unseen(starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of ``numbers`` lie in no range and are the first of their value."""
    at = np.searchsorted(starts, numbers, "right") - 1
    held = (at >= 0) & (numbers <= ends[at]) if len(starts) else np.zeros(len(numbers), bool)
    first = np.zeros(len(numbers), bool)
    first[np.unique(numbers, return_index=True)[1]] = True
    return ~held & first


def dedup_numbered(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """DER-4: each (key, seq) of ``stream`` once, however late or often it is delivered.

    ``key`` names a numbered source (a partition of a log, a shard) and ``seq``
    counts its events without large holes. The state of a key is the list of
    ranges of numbers seen: one range while nothing is missing, one more a gap,
    so it grows with keys and gaps and not with events, and no watermark drops a
    late first delivery. Of repeated deliveries the first to arrive comes out.
    Rows with a NULL seq cannot be numbered and fail the batch.
    """

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        starts, ends = (np.array(x, np.int64) for x in held)
        for frame in frames:
            if frame[seq].isna().any():
                raise ValueError(f"NULL {seq}")
            numbers = frame[seq].to_numpy(np.int64)
            fresh = unseen(starts, ends, numbers)
            starts, ends = merge_ranges(starts, ends, numbers[fresh])
            yield frame[fresh]
        state.update((starts.tolist(), ends.tolist()))

    return stream.groupBy(key).applyInPandasWithState(run, stream.schema, STATE, "append", GroupStateTimeout.NoTimeout)
