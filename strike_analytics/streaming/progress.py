"""The progress log while frames arrive: the lines of ``ingest_progress``, live.

One state for each connection: its counts so far, and the frames that may
still be overtaken. A frame is counted when the watermark has passed the time
it was received: frames of a connection are numbered as they are received, so
none that is still to come goes before it. Every ``every``-th frame counted
gives a line. When the watermark has passed a connection's last frame by
``idle``, what is held is counted, the closing line follows (unless the last
frame had a line) and the state goes.

So the lines are those of the batch log however the arrival was shuffled
within ``delay``. Frames later than that are dropped, as with any watermark; a
connection that goes on after ``idle`` begins a new log.

Scale: a state holds three numbers and the frames of the last ``delay``;
connections are dealt over the tasks. One connection is one task's work, as
its order demands: what one socket can send.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numeric import pct
from ..functions.timeutil import epoch_micros

_LINES = "session_id long, sample_no long, processed long, stored long"
_STATE = "processed long, stored long, sample_no long, last long, held binary"
_UNNUMBERED = np.iinfo(np.int64).min


def _milliseconds(interval: _dt.timedelta) -> int:
    return int(interval / _dt.timedelta(milliseconds=1))


def progress_line_stream(outcome_rows: DataFrame, every: int = 10, delay: _dt.timedelta = _dt.timedelta(minutes=1),
                         idle: _dt.timedelta = _dt.timedelta(minutes=10)) -> DataFrame:
    """Lines (session_id, sample_no, processed, stored, failed, success_rate) of
    a stream of outcomes (session_id, sample_no, received_at, decoded), in append mode."""
    idle_ms = _milliseconds(idle)

    def count(frames: np.ndarray, processed: int, stored: int, sample: int) -> tuple[list[tuple], int, int, int]:
        """``frames``: rows of sample number, time and whether decoded."""
        order = np.lexsort((frames[:, 2], frames[:, 0]))
        total = stored + np.cumsum(frames[order, 2])
        rank = processed + np.arange(1, len(frames) + 1)
        lines = [(int(frames[order[i], 0]), int(rank[i]), int(total[i])) for i in np.flatnonzero(rank % every == 0)]
        return lines, processed + len(frames), int(total[-1]), max(sample, int(frames[order[-1], 0]))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        processed, stored, sample, last, held = state.get if state.exists else (0, 0, _UNNUMBERED, 0, b"")
        parts = [np.frombuffer(held, np.int64).reshape(-1, 3)]
        ended = state.hasTimedOut
        if not ended:
            for b in batches:
                parts.append(np.stack([b["sample_no"].fillna(_UNNUMBERED).astype(np.int64), b["received"].astype(np.int64),
                                       b["decoded"].astype(np.int64)], axis=1))
        frames = np.concatenate(parts)
        if len(frames):
            last = max(last, int(frames[:, 1].max()))
        now = state.getCurrentWatermarkMs() * 1000
        ready = np.ones(len(frames), bool) if ended else frames[:, 1] < now
        lines: list[tuple] = []
        if ready.any():
            lines, processed, stored, sample = count(frames[ready], processed, stored, sample)
        if ended:
            if processed % every:
                lines.append((sample, processed, stored))
            state.remove()
        else:
            state.update((processed, stored, sample, last, frames[~ready].tobytes()))
            state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"session_id": pd.array([key[0]] * len(lines), "Int64"),
                            "sample_no": pd.array([None if n == _UNNUMBERED else n for n, _, _ in lines], "Int64"),
                            "processed": [p for _, p, _ in lines], "stored": [s for _, _, s in lines]})

    rows = outcome_rows.select("session_id", "sample_no", epoch_micros(F.col("received_at")).alias("received"), "decoded")
    rows = rows.withColumn("at", F.timestamp_micros("received")).withWatermark("at", f"{_milliseconds(delay)} milliseconds")
    lines = rows.groupBy("session_id").applyInPandasWithState(run, _LINES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return lines.select("session_id", "sample_no", "processed", "stored", (F.col("processed") - F.col("stored")).alias("failed"),
                        pct(F.col("stored"), F.col("processed"), 1).alias("success_rate"))
