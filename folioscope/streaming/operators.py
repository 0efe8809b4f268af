"""Streaming twins of the order-dependent operators, over Structured Streaming.

Windows use watermarks; what needs a fold per key keeps its state with ``applyInPandasWithState``, bounded by time-outs.  All
take an unbounded DataFrame with an event-time column ``ts`` and give one; none starts a query.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runlog import OpenCalls
from ..operators.scheduling import FIRST_OUTPUT_S, IDLE_S, RATE_WINDOW, TOKEN_TTL_S, TOTAL_S

LATENESS = "2 minutes"


def rate_windows(requests: DataFrame, limit: int, lateness: str = LATENESS) -> DataFrame:
    """Requests of each client and minute, and how many were over the limit."""
    t = requests.withWatermark("ts", lateness).groupBy("client", F.window("ts", RATE_WINDOW).alias("w")).agg(F.count("*").alias("requests"))
    return t.select("client", F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("refused"))


def idle_sessions(chunks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Islands of live chunks of a call with no gap over the idle limit."""
    live = chunks.where(F.col("kind") != "keepalive").withWatermark("ts", lateness)
    t = live.groupBy("call_id", F.session_window("ts", f"{IDLE_S} seconds").alias("w")).agg(F.count("*").alias("chunks"), F.sum("text_length").alias("text_length"))
    return t.select("call_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "chunks", "text_length")


def _in_flight(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    calls = OpenCalls([tuple(x) for x in json.loads(state.get[0])] if state.exists else None)
    rows = pd.concat(list(batches)).sort_values("line")
    for kind, own, ts, line in rows[["type", "key", "ts", "line"]].itertuples(index=False):
        calls.see(kind, own, str(ts), int(line))
    state.update((json.dumps(calls.starts),))
    oldest = min(calls.starts, key=lambda x: (x[1], x[2]), default=None)
    yield pd.DataFrame([(key[0], len(calls.starts), oldest[0] if oldest else None)], columns=["session_id", "open_calls", "oldest_key"])


def in_flight(log: DataFrame) -> DataFrame:
    """After each batch, the open calls of each session that had events in it."""
    key = F.concat_ws("|", *(F.coalesce(c, F.lit("?")) for c in ("agent", "model", "capability")))
    calls = log.where(F.col("type").isin("model_call_start", "model_call")).select("session_id", "line", "ts", "type", key.alias("key"))
    kind = dict(calls.dtypes)["session_id"]
    return calls.groupBy("session_id").applyInPandasWithState(
        _in_flight, f"session_id {kind}, open_calls long, oldest_key string", "open string", "update", GroupStateTimeout.NoTimeout
    )


class Stall:
    """What is known of one call: when it began and last spoke, and whether text has come (seconds)."""

    def __init__(self, began: float, last: float, text: bool, told: bool):
        self.began, self.last, self.text, self.told = began, last, text, told

    def limit(self) -> tuple[float, str]:
        """When the call stalls if nothing more comes, and how."""
        at, kind = (self.last + IDLE_S, "idle") if self.text else (self.last + FIRST_OUTPUT_S, "first_output")
        return (at, kind) if at <= self.began + TOTAL_S else (self.began + TOTAL_S, "total")

    def see(self, at: float, length: int) -> str | None:
        due, kind = self.limit()
        found = kind if at > due and not self.told else None
        self.told |= found is not None
        self.last, self.text = at, self.text or length > 0
        return found


def _stalls(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    found = []
    call = Stall(*state.get) if state.exists else None
    if state.hasTimedOut:
        if call and not call.told:
            found.append((key[0], call.limit()[1]))
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for ts, length in rows[["ts", "text_length"]].itertuples(index=False):
            at = ts.timestamp()
            call = call or Stall(at, at, False, False)
            kind = call.see(at, int(length))
            if kind:
                found.append((key[0], kind))
        state.update((call.began, call.last, call.text, call.told))
        state.setTimeoutTimestamp(max(int(call.limit()[0] * 1000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(found, columns=["call_id", "kind"])


def stalls(chunks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The first stall of each call; event-time timers tell of calls that fall silent for good."""
    live = chunks.where(F.col("kind") != "keepalive").withWatermark("ts", lateness).select("call_id", "seq", "ts", "text_length")
    kind = dict(live.dtypes)["call_id"]
    return live.groupBy("call_id").applyInPandasWithState(
        _stalls, f"call_id {kind}, kind string", "began double, last double, text boolean, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def _cache(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    made = state.get[0] if state.exists else None
    out = []
    for request, ts in pd.concat(list(batches)).sort_values(["ts", "request_id"])[["request_id", "ts"]].itertuples(index=False):
        at = ts.timestamp()
        hit = made is not None and at - made < TOKEN_TTL_S
        made = made if hit else at
        out.append((key[0], request, hit))
    state.update((made,))
    state.setTimeoutTimestamp(max(int((made + TOKEN_TTL_S) * 1000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["client", "request_id", "hit"])


def token_cache(lookups: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Whether each lookup hits; entries live for their TTL from when they were made and are then forgotten."""
    timed = lookups.withWatermark("ts", lateness).select("client", "request_id", "ts")
    kind = dict(timed.dtypes)
    return timed.groupBy("client").applyInPandasWithState(
        _cache, f"client {kind['client']}, request_id {kind['request_id']}, hit boolean", "made double", "append", GroupStateTimeout.EventTimeTimeout
    )
