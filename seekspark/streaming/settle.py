"""Write settling: a path is passed on when no further event of it came for a while, and then once, with its last event.

`settled` goes by the time of the events (session windows behind a watermark): replaying a log gives the same each time.
`held_back` goes by the clock, for a live stream: its timers fire also when nothing else happens. Both keep one row for
each path that has not settled, and deal paths out by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seekspark.schemas import struct

SETTLED = struct("seq:bigint path:string event:string")
_LAST = struct("seq:bigint event:string")


def settled(events: DataFrame, quiet: str, late: str) -> DataFrame:
    """Stream of (ts, seq, path, event) -> (path, event, seq, n_events): the last event of every run of events less than
    `quiet` apart, when events `late` later than its end have come."""
    runs = events.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet))
    last = runs.agg(F.max_by("event", "seq").alias("event"), F.max("seq").alias("seq"), F.count("*").alias("n_events"))
    return last.select("path", "event", "seq", "n_events")


def held_back(events: DataFrame, quiet_ms: int) -> DataFrame:
    """Stream of (seq, path, event) -> the same, each path once it has been quiet for `quiet_ms`."""

    def hold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seq, event = state.get
            state.remove()
            yield pd.DataFrame([(seq, key[0], event)], columns=SETTLED.names)
            return
        seq, event = state.get if state.exists else (None, None)
        for frame in frames:
            newest = frame.loc[frame["seq"].idxmax()]
            if seq is None or newest["seq"] >= seq:
                seq, event = int(newest["seq"]), newest["event"]
        state.update((seq, event))
        state.setTimeoutDuration(quiet_ms)

    return events.groupBy("path").applyInPandasWithState(hold, SETTLED, _LAST, "append", GroupStateTimeout.ProcessingTimeTimeout)
