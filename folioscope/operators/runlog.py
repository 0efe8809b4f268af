"""Run-log analytics: from JSON lines or a table of events to a run's health.

Events carry (session_id, line, ts, type, …); ``line`` is their order in the log.  Aggregates are native; only the exact
matching of starts and ends, whose fallback depends on all events before, is folded in Python, one session at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LOG_EVENT

USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
SLOWEST = 5


def parse_lines(logs: DataFrame, text: str = "value", keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Whole logs as events in order; blank lines and lines that are no JSON object are left out."""
    lines = logs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    schema = T.StructType([*LOG_EVENT.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.withColumn("e", F.from_json("raw", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where(F.col("e._corrupt").isNull() & F.col("e").isNotNull())
    return good.select(*keys, "line", *(f"e.{n}" for n in schema.names if n != "_corrupt"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every log under a path, by file; a log is one row, as a run's log is small and its order matters."""
    raw = spark.read.text(path, wholetext=True).withColumn("session_id", F.input_file_name())
    return parse_lines(raw)


def millis(start: Column, end: Column) -> Column:
    """Milliseconds from one moment to another; 0 if either is missing or the order is reversed."""
    gap = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), F.coalesce(gap, F.lit(0).cast("long")))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def model_calls(log: DataFrame) -> DataFrame:
    """Per session: calls, failed ones, total, mean and longest duration, and how far calls overlapped."""
    call = F.col("type") == "model_call"
    ms = F.when(call, F.coalesce("duration_ms", F.lit(0)))
    t = log.groupBy("session_id").agg(
        F.count(F.when(call, 1)).alias("calls"),
        F.count(F.when(call & (F.col("ok") == F.lit(False)), 1)).alias("failed"),
        F.coalesce(F.sum(ms), F.lit(0)).alias("total_ms"),
        F.coalesce(F.max(ms), F.lit(0)).alias("max_ms"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    elapsed = millis(F.col("first"), F.col("last"))
    n = F.nullif(F.col("calls"), F.lit(0)).cast("double")
    factor = round_half_up(F.col("total_ms") / F.nullif(elapsed, F.lit(0)).cast("double") * 100) / 100
    return t.select(
        "session_id",
        "calls",
        "failed",
        "total_ms",
        F.coalesce(round_half_up(F.col("total_ms") / n), F.lit(0)).alias("avg_ms"),
        "max_ms",
        F.coalesce(factor, F.lit(0.0)).alias("concurrency_factor"),
    )


def by_agent(log: DataFrame) -> DataFrame:
    """Calls, durations and tokens of each agent of a session; a call without an agent counts under ``?``."""
    calls = log.where(F.col("type") == "model_call")
    ms = F.coalesce("duration_ms", F.lit(0))
    return calls.groupBy("session_id", F.coalesce("agent", F.lit("?")).alias("agent")).agg(
        F.count("*").alias("calls"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"), *(F.sum(F.coalesce(u, F.lit(0))).alias(u) for u in USAGE)
    )


def token_totals(log: DataFrame) -> DataFrame:
    """Token sums per session, and how many calls reported any (failed ones too)."""
    calls = log.where(F.col("type") == "model_call")
    return calls.groupBy("session_id").agg(
        *(F.sum(F.coalesce(u, F.lit(0))).alias(u) for u in USAGE), F.count(F.coalesce(*USAGE)).alias("calls_reported")
    )


def run_bounds(log: DataFrame) -> DataFrame:
    """First and last moment of each log by its order, and its first terminal event."""
    terminal = F.col("type").isin("run_complete", "run_failed")
    at = F.when(terminal, F.col("line"))
    return log.groupBy("session_id").agg(
        F.min_by("ts", "line").alias("started_at"),
        F.max_by("ts", "line").alias("last_at"),
        F.min_by("ts", at).alias("terminal_at"),
        F.min_by("type", at).alias("terminal_type"),
    )


def end_reference(status: Column, terminal_at: Column, last_at: Column, now: Column) -> Column:
    """Now for a running or queued session; else its terminal event, its last event, or now."""
    return F.when(status.isin("running", "queued"), now).otherwise(F.coalesce(terminal_at, last_at, now))


def phase_durations(log: DataFrame, status: Column, now: Column) -> DataFrame:
    """How long each phase took: until the next phase event, the last one until the end; a repeated phase counts its last time."""
    ends = run_bounds(log).select("session_id", end_reference(status, F.col("terminal_at"), F.col("last_at"), now).alias("end_ref"))
    phases = log.where((F.col("type") == "phase") & (F.col("phase") != ""))
    order = Window.partitionBy("session_id").orderBy("line")
    timed = phases.withColumn("until", F.lead("ts").over(order)).join(ends, "session_id")
    ms = millis(F.col("ts"), F.coalesce("until", "end_ref"))
    return timed.groupBy("session_id", "phase").agg(F.max_by(ms, "line").alias("duration_ms"))


def slowest_calls(log: DataFrame, n: int = SLOWEST) -> DataFrame:
    """The longest calls of each session; ties keep the log's order."""
    ms = F.coalesce("duration_ms", F.lit(0))
    order = Window.partitionBy("session_id").orderBy(F.desc(ms), "line")
    calls = log.where(F.col("type") == "model_call").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return calls.select("session_id", "rank", "agent", "model", ms.alias("duration_ms"), F.coalesce("ok", F.lit(True)).alias("ok"), "line")


def run_errors(log: DataFrame) -> DataFrame:
    """Failed events and failed runs with their message."""
    bad = (F.col("type") == "run_failed") | (F.col("ok") == F.lit(False))
    return log.where(bad).select("session_id", "line", "ts", "type", F.coalesce("error", F.lit("unknown")).alias("message"))


def _call_key() -> Column:
    return F.concat_ws("|", *(F.coalesce(c, F.lit("?")) for c in ("agent", "model", "capability")))


def in_flight(log: DataFrame) -> DataFrame:
    """Open calls, where each end has a start of its own key: the k-th end of a key closes its k-th start."""
    calls = log.where(F.col("type").isin("model_call_start", "model_call")).withColumn("key", _call_key())
    start = F.col("type") == "model_call_start"
    ends = calls.groupBy("session_id", "key").agg(F.count(F.when(~start, 1)).alias("ended"))
    order = Window.partitionBy("session_id", "key").orderBy("line")
    starts = calls.where(start).withColumn("nth", F.row_number().over(order)).join(ends, ["session_id", "key"])
    opened = starts.where(F.col("nth") > F.col("ended"))
    return opened.groupBy("session_id").agg(F.count("*").alias("open_calls"), F.min("ts").alias("oldest_at"), F.min_by("key", F.struct("ts", "line")).alias("oldest_key"))


class OpenCalls:
    """Open calls of one session, closed as the reference's fold closes them."""

    def __init__(self, starts: list[tuple[str, object, int]] | None = None):
        self.starts = starts or []

    def see(self, kind: str, key: str, ts: object, line: int) -> None:
        if kind == "model_call_start":
            self.starts.append((key, ts, line))
        elif kind == "model_call":
            for i, (own, _, _) in enumerate(self.starts):
                if own == key:
                    del self.starts[i]
                    return
            del self.starts[:1]  # no start of this key: the oldest open one of any


def _fold(batch: pd.DataFrame) -> pd.DataFrame:
    calls = OpenCalls()
    for kind, key, ts, line in batch.sort_values("line")[["type", "key", "ts", "line"]].itertuples(index=False):
        calls.see(kind, key, ts, line)
    session = batch["session_id"].iloc[0]
    rows = [(session, key, ts, line) for key, ts, line in sorted(calls.starts, key=lambda x: (x[1], x[2]))]
    return pd.DataFrame(rows, columns=["session_id", "key", "ts", "line"])


def in_flight_exact(log: DataFrame) -> DataFrame:
    """Every open call of every session, exactly: an end without a start of its key closes the oldest open call."""
    calls = log.where(F.col("type").isin("model_call_start", "model_call")).select("session_id", "line", "ts", "type", _call_key().alias("key"))
    kind = dict(calls.dtypes)
    return calls.groupBy("session_id").applyInPandas(_fold, f"session_id {kind['session_id']}, key string, ts {kind['ts']}, line long")
