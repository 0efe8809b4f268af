"""Queues, rate limits, byte budgets, caches and stalls over recorded events.

What is a matter of windows is native.  Where a decision feeds back into the next (queues, refusals, caches), one key's events
are replayed in order in Python, a batch at a time; keys are independent.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RATE_WINDOW, RATE_SECONDS = "60 seconds", 60
FIRST_OUTPUT_S, IDLE_S, TOTAL_S = 120, 60, 900
TOKEN_TTL_S, TOKEN_SLOTS = 300, 10_000
ALLOWED_MOVES = (
    ("queued", "running"),
    ("running", "ready_for_review"),
    ("running", "failed"),
    ("queued", "failed"),
    ("ready_for_review", "queued"),
    ("ready_for_review", "closed"),
    ("failed", "queued"),
)


def rate_windows(requests: DataFrame, limit: int) -> DataFrame:
    """Per client and calendar minute: requests, and how many were over the limit."""
    t = requests.groupBy("client", F.window("ts", RATE_WINDOW).alias("w")).agg(F.count("*").alias("requests"))
    return t.select("client", F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("refused"))


def refusals(requests: DataFrame, limit: int) -> DataFrame:
    """Requests over the limit of their minute, with the seconds after which to try again."""
    w = F.window("ts", RATE_WINDOW)
    order = Window.partitionBy("client", "start").orderBy("ts", "request_id")
    own = requests.withColumn("w", w).select("*", F.col("w.start").alias("start"), F.col("w.end").alias("end")).drop("w")
    ranked = own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") > limit)
    left = F.ceil((F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)
    return ranked.select("request_id", "client", "ts", F.greatest(F.lit(1), left).cast("int").alias("retry_after_s"))


def byte_charge(declared: Column, ceiling: int) -> Column:
    """What a request counts for: its declared size, at most the ceiling; the ceiling where none above zero is declared."""
    return F.when(declared > 0, F.least(declared, F.lit(ceiling))).otherwise(F.lit(ceiling))


def occupancy(requests: DataFrame, ceiling: int, keys: tuple[str, ...] = ("client",)) -> DataFrame:
    """Bytes in flight after each start and end of a request: a running sum of charges and releases."""
    charge = byte_charge(F.col("declared_bytes"), ceiling)
    steps = F.array(
        F.struct(F.col("ts").alias("at"), charge.alias("delta")), F.struct((F.col("ts") + F.make_dt_interval(secs=F.col("hold_s"))).alias("at"), (-charge).alias("delta"))
    )
    rows = requests.select(*keys, "request_id", F.explode(steps).alias("s")).select(*keys, "request_id", "s.at", "s.delta")
    order = Window.partitionBy(*keys).orderBy("at", "delta", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("in_flight", F.sum("delta").over(order))


def metered(chunks: DataFrame, ceiling: int, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Where an undeclared body is cut: the first chunk that takes its running size over the ceiling."""
    order = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sized = chunks.withColumn("size", F.sum("bytes").over(order))
    return sized.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.min(F.when(F.col("size") > ceiling, F.col("seq"))).alias("cut_at"))


def replayed(rows: DataFrame, keys: list[str], order: list[str], given: list[str], fresh: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """What a function with a state of its own makes of each key's rows, in order; null is a key like any other.

    Keys are dealt out and sorted within their partitions, and rows come to Python in batches: whatever the size of a key, a
    task holds one batch and one state.
    """
    made = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, decide = None, None
        for batch in batches:
            out = []
            for key, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != here:
                    here, decide = key, fresh()
                out.append(decide(*values))
            columns = zip(*out, strict=True) if out else [()] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    keyed = rows.select(F.to_json(F.struct(*keys)).alias("_key"), *given, *(F.col(c).alias(f"_by_{c}") for c in order))
    dealt = keyed.repartition("_key").sortWithinPartitions("_key", *(f"_by_{c}" for c in order))
    return dealt.select("_key", *given).mapInArrow(run, schema)


def _in_seconds(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def queue_waits(jobs: DataFrame, limit: int) -> DataFrame:
    """(queue, job_id, started_s, waited_s) under first come, first served with ``limit`` slots (one at least).

    Jobs are (queue, job_id, submit_s, run_s).
    """
    slots = max(1, limit)

    def fresh() -> Callable[..., tuple]:
        busy: list[float] = []

        def start(queue, job, submit: float, run: float) -> tuple:
            at = submit if len(busy) < slots else max(submit, heapq.heappop(busy))
            heapq.heappush(busy, at + run)
            return queue, job, at, at - submit

        return start

    kind = dict(jobs.dtypes)
    schema = f"queue {kind['queue']}, job_id {kind['job_id']}, started_s double, waited_s double"
    return replayed(jobs, ["queue"], ["submit_s", "job_id"], ["queue", "job_id", "submit_s", "run_s"], fresh, schema)


def admitted(requests: DataFrame, ceiling: int, budget: int, gate: str | None = None) -> DataFrame:
    """(client, request_id, admitted): a request is refused while others are in flight and it would exceed the budget.

    A deployment has one counter for all its clients; ``gate`` is the column that tells deployments apart, none for requests
    of one.  Each decision depends on those before it, so the requests of a deployment are replayed in one task.
    """

    def fresh() -> Callable[..., tuple]:
        flying: list[tuple[float, int]] = []
        total = 0

        def admit(client, request, at: float, charge: int, hold: float) -> tuple:
            nonlocal total
            while flying and flying[0][0] <= at:
                total -= heapq.heappop(flying)[1]
            good = not flying or total + charge <= budget
            if good:
                heapq.heappush(flying, (at + hold, charge))
                total += charge
            return client, request, good

        return admit

    timed = _in_seconds(requests).withColumn("charge", byte_charge(F.col("declared_bytes"), ceiling).cast("long"))
    timed = timed.withColumn("_gate", F.col(gate) if gate else F.lit(0))
    return replayed(timed, ["_gate"], ["at_s", "request_id"], ["client", "request_id", "at_s", "charge", "hold_s"], fresh, "client long, request_id long, admitted boolean")


def rate_decisions(requests: DataFrame, limit: int) -> DataFrame:
    """(client, request_id, window_start_s, nth, refused, retry_after_s) where a window begins with a client's first request.

    It lasts a minute; the first request after its end begins the next one.  Of the requests of a window those after the
    first ``limit`` are refused, with the whole seconds to its end, one at least.  A silence of a minute ends any window, so
    a client's requests are replayed from one such silence to the next, each run by itself.
    """

    def fresh() -> Callable[..., tuple]:
        began, seen = None, 0

        def count(client, request, at: float) -> tuple:
            nonlocal began, seen
            if began is None or at - began >= RATE_SECONDS:
                began, seen = at, 0
            seen += 1
            over = seen > limit
            return client, request, began, seen, over, max(1, math.ceil(began + RATE_SECONDS - at)) if over else None

        return count

    order = Window.partitionBy("client").orderBy("at_s", "request_id")
    gap = F.col("at_s") - F.lag("at_s").over(order) >= RATE_SECONDS
    runs = _in_seconds(requests).withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    schema = "client long, request_id long, window_start_s double, nth long, refused boolean, retry_after_s long"
    return replayed(runs, ["client", "_run"], ["at_s", "request_id"], ["client", "request_id", "at_s"], fresh, schema)


def _cache(ttl_s: float, slots: int) -> Callable[[], Callable[..., tuple]]:
    """Caches of client to moment of expiry.  All entries live equally long, so the oldest is the next to expire."""

    def fresh() -> Callable[..., tuple]:
        entries: dict = {}

        def look_up(client, request, at: float) -> tuple:
            hit = client in entries and entries[client] > at
            if not hit:
                while entries and (len(entries) >= slots or next(iter(entries.values())) <= at):
                    del entries[next(iter(entries))]
                entries[client] = at + ttl_s
            return client, request, hit

        return look_up

    return fresh


def token_cache(lookups: DataFrame, ttl_s: int = TOKEN_TTL_S, slots: int | None = None, gate: str | None = None) -> DataFrame:
    """(client, request_id, hit): an entry lives for its TTL from when it was made; a hit does not renew it.

    With ``slots`` a deployment (told apart by the column ``gate``, if given) holds at most so many entries: where one more is
    made, expired entries go, then the oldest.  Only a deployment of more clients than slots can be short of room; its
    lookups are replayed together, those of all others client by client.
    """
    timed = _in_seconds(lookups).withColumn("_gate", F.col(gate) if gate else F.lit(0))
    keys = ["_gate", "client"]
    if slots is not None:
        clients = timed.select("_gate", "client").distinct().groupBy("_gate").agg((F.count("*") > slots).alias("_short"))
        timed = timed.withColumnRenamed("_gate", "_g").join(clients, F.col("_g").eqNullSafe(F.col("_gate")))
        timed = timed.withColumn("_alone", F.when(~F.col("_short"), F.col("client"))).drop("_gate").withColumnRenamed("_g", "_gate")
        keys = ["_gate", "_short", "_alone"]
    schema = "client long, request_id long, hit boolean"
    return replayed(timed, keys, ["at_s", "request_id"], ["client", "request_id", "at_s"], _cache(ttl_s, max(1, slots) if slots is not None else TOKEN_SLOTS), schema)


def stalls(chunks: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """(call_id, seq, kind) of the first stall of each recorded call.

    A stall is found at the chunk after it.  ``watched``, (call_id, ts), tells until when calls that never ended were watched: silence up to
    then is a stall as well, without a seq.

    Chunks are (call_id, seq, ts, kind, text_length); the first one's moment stands for the request.  Keepalives count for
    nothing.  A gap is measured against the idle limit once text has come, else against that of first output.
    """
    live = chunks.where(F.col("kind") != "keepalive").select("call_id", "seq", "ts", "text_length", F.lit(False).alias("silence"))
    if watched is not None:
        ends = watched.select("call_id", F.lit(None).cast("long").alias("seq"), "ts", F.lit(0).alias("text_length"), F.lit(True).alias("silence"))
        live = live.unionByName(ends)
    order = Window.partitionBy("call_id").orderBy("ts", "silence", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = live.withColumn("text_so_far", F.sum("text_length").over(upto)).withColumn("began", F.min("ts").over(upto))
    seen = seen.withColumn("before", F.lag("ts").over(order)).withColumn("had_text", F.coalesce(F.lag("text_so_far").over(order) > 0, F.lit(False)))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap, total = (micros("ts") - micros("before")) / 1e6, (micros("ts") - micros("began")) / 1e6
    kind = F.when(F.col("had_text") & (gap > IDLE_S), F.lit("idle")).when(~F.col("had_text") & (gap > FIRST_OUTPUT_S), F.lit("first_output")).when(total > TOTAL_S, F.lit("total"))
    found = seen.withColumn("stall", kind).where(F.col("stall").isNotNull())
    place = F.struct("ts", "silence", "seq")
    return found.groupBy("call_id").agg(F.min_by("seq", place).alias("seq"), F.min_by("stall", place).alias("kind"))


def sse_events(reads: DataFrame) -> DataFrame:
    """(call_id, pos, data) of the data lines in a recorded stream, put together across reads, up to ``[DONE]``."""
    whole = reads.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    lines = whole.select("call_id", F.posexplode(F.split(text, "\r?\n")).alias("pos", "line")).where(F.col("line").startswith("data:"))
    data = lines.select("call_id", "pos", F.trim(F.substring("line", 6, 1 << 30)).alias("data"))
    ends = data.where(F.col("data") == "[DONE]").groupBy("call_id").agg(F.min("pos").alias("end"))
    return data.join(ends, "call_id", "left").where(F.col("end").isNull() | (F.col("pos") < F.col("end"))).drop("end")


def call_usage(events: DataFrame, fields: tuple[str, ...] = ("input_tokens", "output_tokens")) -> DataFrame:
    """Usage of each call: of each attempt the latest value of a field, summed over attempts; absent stays absent."""
    last = events.groupBy("call_id", "attempt").agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields))
    return last.groupBy("call_id").agg(*(F.sum(f).alias(f) for f in fields))


def illegal_moves(transitions: DataFrame) -> DataFrame:
    """Transitions (session_id, seq, status) that the state machine does not allow."""
    order = Window.partitionBy("session_id").orderBy("seq")
    moved = transitions.withColumn("before", F.lag("status").over(order)).where(F.col("before").isNotNull())
    allowed = moved.sparkSession.createDataFrame(list(ALLOWED_MOVES), "before string, status string")
    return moved.join(F.broadcast(allowed), ["before", "status"], "left_anti").select("session_id", "seq", "before", "status")


def bounded_map(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, limit: int, order: str) -> DataFrame:
    """A function over rows with at most ``limit`` tasks at a time; results come back in order; one failure fails all."""
    return rows.repartition(max(1, limit)).mapInPandas(run, schema).orderBy(order)
