"""Graph state kept by a stream: the spans of activity of each node, under a watermark.

Each node's state is its open spans: first and last time, number of edges. An event within ``idle`` of a span joins it, spans
that meet become one, so the order of events inside the allowed lateness does not matter. Once the watermark is past a span's
last time by ``idle`` no event can reach it any more: it leaves the state and is written out, once. A node without open spans
has no state. Events older than the watermark are dropped by Spark before they get here and counted in the stream's progress.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Spans = list[tuple[int, int, int]]


def merged(spans: Spans, times: np.ndarray, idle: int) -> Spans:
    """Open spans with more events, in microseconds; what is less than ``idle`` apart is one span."""
    out: Spans = []
    for first, last, n in sorted([*spans, *((int(t), int(t), 1) for t in times)]):
        if out and first - out[-1][1] < idle:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def _activity(idle: int):
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spans: Spans = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                spans = merged(spans, pdf["us"].to_numpy(), idle)
        mark = state.getCurrentWatermarkMs() * 1000
        over = [s for s in spans if s[1] + idle <= mark]
        spans = spans[len(over) :]
        if spans:
            state.update(tuple(map(list, zip(*spans, strict=True))))
            state.setTimeoutTimestamp(max((spans[0][1] + idle) // 1000, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        if over:
            yield pd.DataFrame({"node": [key[0]] * len(over), "first_us": [s[0] for s in over], "last_us": [s[1] for s in over], "degree": [s[2] for s in over]})

    return run


def node_activity(events: DataFrame, node: str = "user_id", idle_seconds: int = 3_600, late: str = "1 hour") -> DataFrame:
    """(node, first_seen, last_seen, degree) of each closed span of a stream with the event time ts. Rows with a null
    node or time are left out. Append mode."""
    kind = events.schema[node].dataType.simpleString()
    rows = events.withWatermark("ts", late).where(F.col(node).isNotNull() & F.col("ts").isNotNull()).select(F.col(node).alias("node"), "ts", F.unix_micros("ts").alias("us"))
    out = rows.groupBy("node").applyInPandasWithState(
        _activity(idle_seconds * 1_000_000), f"node {kind}, first_us long, last_us long, degree long", "firsts array<long>, lasts array<long>, degrees array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select("node", F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"), "degree")
