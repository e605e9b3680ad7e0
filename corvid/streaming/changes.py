"""Change streams: file events to micro-batches, and event-time figures."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvid.operators import incremental

#: What a watcher's event means for a path.
EVENT_KINDS = {"create": "added", "modify": "modified", "remove": "deleted", "rename_from": "deleted", "rename_to": "added"}


def as_changes(events: DataFrame, kind: str = "event", path: str = "path", order: str = "seq") -> DataFrame:
    """path, change, seq of watcher events; unknown events and null paths are left out."""
    pairs = [F.lit(x) for kv in EVENT_KINDS.items() for x in kv]
    return events.select(F.col(path).alias("path"), F.try_element_at(F.create_map(*pairs), F.col(kind)).alias("change"), F.col(order).alias("seq")).where("change is not null and path is not null")


def coalesced(changes: DataFrame) -> DataFrame:
    """The last change of each path of a batch."""
    return incremental.last_change(changes, "seq")


class Debounced:
    """Runs something once calls have been quiet for a while; calls during a run lead to one more run after it."""

    def __init__(self, run: Callable[[], None], quiet: float = 4.0):
        self._run, self._quiet = run, quiet
        self._lock, self._timer, self._running, self._again = threading.Lock(), None, False, False

    def __call__(self) -> None:
        with self._lock:
            if self._running:
                self._again = True
                return
            if self._timer:
                self._timer.cancel()
            self._timer = threading.Timer(self._quiet, self._fire)
            self._timer.daemon = True
            self._timer.start()

    def _fire(self) -> None:
        with self._lock:
            self._timer, self._running = None, True
        try:
            self._run()
        finally:
            with self._lock:
                self._running, again, self._again = False, self._again, False
            if again:
                self()


def maintain(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, debounce: str = "3 seconds", once: bool = False) -> StreamingQuery:
    """Call ``apply`` with each micro-batch of coalesced changes.  The trigger's interval gathers bursts; the checkpoint has what was done."""
    writer = changes.writeStream.foreachBatch(lambda df, n: apply(coalesced(df), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, late: str, *aggs: Column) -> DataFrame:
    """Aggregates by event-time window; rows later than ``late`` are left out when streaming."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width).alias("w"), *keys).agg(*aggs).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str, *aggs: Column) -> DataFrame:
    """Aggregates by session: events of a key with less than ``gap`` between them."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(*keys, F.session_window("_ts", gap).alias("w")).agg(*aggs).withColumns({"session_start": F.col("w.start"), "session_end": F.col("w.end")}).drop("w")
