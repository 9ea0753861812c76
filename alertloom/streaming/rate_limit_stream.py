"""Sliding-window rate limit on a request stream, one state per client."""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "client string, request_id bigint, request_ts timestamp, accepted boolean, remaining bigint, reset_at timestamp"
STATE = "accepted_us array<bigint>"

# Rows of a client that are sorted in memory at once, and rows read at once of each sorted run.
RUN_ROWS = 1 << 19
BLOCK_ROWS = 4096
_ROW_BYTES = 4 * 8


def _time_order(run_rows: int, block_rows: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]]:
    """Sorts the rows of a client; as closures, so that workers need nothing of this module."""

    def numbers(batch: pd.DataFrame) -> np.ndarray:
        """Per row: whether it has no time, its time in microseconds, whether it has no id, its id."""
        times, ids = batch["request_ts"], batch["request_id"]
        us = times.astype("datetime64[us]").astype("int64")
        return np.column_stack([times.isna(), us, ids.isna(), ids.fillna(0).astype("int64")])

    def in_order(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        return rows[np.lexsort(rows.T[::-1])]

    def blocks(size: int, read: Callable[[int, int], np.ndarray]) -> Iterator[np.ndarray]:
        for start in range(0, size, block_rows):
            yield read(start, min(size, start + block_rows))

    def merged(runs: list[Iterator[np.ndarray]]) -> Iterator[np.ndarray]:
        """All rows of sorted runs in order, a block of each run at a time."""
        heads = [(next(run), run) for run in runs]
        while heads:
            # What is still to come of a run is not before the last row of its block.
            end = min(tuple(block[-1]) for block, _ in heads)
            ends = [bisect_right(block, end, key=tuple) for block, _ in heads]
            yield in_order([block[:n] for (block, _), n in zip(heads, ends)])
            left = [(block[n:] if n < len(block) else next(run, None), run) for (block, run), n in zip(heads, ends)]
            heads = [(block, run) for block, run in left if block is not None]

    def in_time_order(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """The ``numbers`` of all batches by time and id, those without one last, in blocks.

        Memory does not grow with a client's rows: beyond ``run_rows`` sorted runs go to a
        temporary file, which has no name, and are merged from there.
        """
        held, count, file, runs = [], 0, None, []

        def stored(first: int) -> Callable[[int, int], np.ndarray]:
            def read(start: int, end: int) -> np.ndarray:
                data = os.pread(file.fileno(), (end - start) * _ROW_BYTES, (first + start) * _ROW_BYTES)
                return np.frombuffer(data, dtype=np.int64).reshape(-1, 4)

            return read

        try:
            for batch in batches:
                held.append(numbers(batch))
                count += len(batch)
                if count >= run_rows:
                    # A folder that Spark gives its executors for such files, where there is one.
                    file = file or tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
                    runs.append(blocks(count, stored(file.tell() // _ROW_BYTES)))
                    file.write(in_order(held).data)
                    held, count = [], 0
            if file:
                file.flush()
            if count:
                rest, held = in_order(held), []
                runs.append(blocks(len(rest), lambda start, end: rest[start:end]))
            yield from runs[0] if len(runs) == 1 else merged(runs)
        finally:
            if file:
                file.close()

    return in_time_order


def rate_limit(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Decide requests in arrival order of the batches, in time order within one.

    Input: ``client``, ``request_id``, ``request_ts``.  The state of a client is
    its accepted times within the window, at most ``limit`` of them, in order.  A
    request that is older than accepted ones of batches before (a late file) is
    decided like one that comes now: later accepted times count against it too.
    Rows of a client are sorted and decided in bounded memory, however many a batch has.
    """
    window_us = window_seconds * 1_000_000
    in_time_order = _time_order(RUN_ROWS, BLOCK_ROWS)

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for block in in_time_order(batches):
            _, us, no_id, ids = block.T
            accepted, remaining, reset = [], [], []
            for now in us.tolist():
                del times[: bisect_right(times, now - window_us)]
                ok = len(times) < limit
                if ok:
                    insort(times, now)
                accepted.append(ok)
                remaining.append(max(0, limit - len(times)))
                reset.append(times[0] + window_us if times else now)
            yield pd.DataFrame(
                {
                    "client": key[0],
                    "request_id": pd.arrays.IntegerArray(ids.copy(), no_id.astype(bool)),
                    "request_ts": us.astype("datetime64[us]"),
                    "accepted": accepted,
                    "remaining": remaining,
                    "reset_at": pd.to_datetime(pd.Series(reset, dtype="int64"), unit="us").to_numpy(),
                }
            )
        state.update((times,))

    return requests.groupBy("client").applyInPandasWithState(
        decide, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
