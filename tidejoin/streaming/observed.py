"""Counts from a stream's own run: what each batch has read, by `observe`, and what its operators hold, by the query's progress, without another look at the data."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

NAME = "observed"


class Progress(StreamingQueryListener):
    """Keeps the progress of one query, by batch: a batch that is tried again replaces itself."""

    def __init__(self) -> None:
        self.batches: dict[int, dict] = {}
        self.ended = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        own = json.loads(event.progress.json)
        self.batches[own["batchId"]] = own

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended = True


def run(stream: DataFrame, start: Callable, *counts: Column) -> list[dict]:
    """Runs a stream to the end of what it has, through the sink that `start` gives its writer, with the counts observed on the way; a row for each batch: batch, the counts by name, read (input rows), and state_rows, state_bytes, late_rows over all operators with state."""
    spark: SparkSession = stream.sparkSession
    heard = Progress()
    spark.streams.addListener(heard)
    try:
        query = start(stream.observe(NAME, *counts).writeStream.trigger(availableNow=True))
        query.awaitTermination()
        # Events come after the query's end, in order.
        until = time.monotonic() + 60
        while not heard.ended and time.monotonic() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(heard)
    out = []
    for number, own in sorted(heard.batches.items()):
        state = own.get("stateOperators", [])
        total = lambda name: sum(x.get(name, 0) for x in state)  # noqa: E731, B023
        out.append({"batch": number, **own.get("observedMetrics", {}).get(NAME, {}), "read": sum(s["numInputRows"] for s in own["sources"]), "state_rows": total("numRowsTotal"), "state_bytes": total("memoryUsedBytes"), "late_rows": total("numRowsDroppedByWatermark")})
    return out
