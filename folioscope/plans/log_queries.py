"""Queries over run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import runlog
from .registry import Tables, query
from .store_queries import NOW_SQL, now


def status() -> Column:
    return F.when(F.col("session_id") % 3 == 0, F.lit("running")).otherwise(F.lit("ready_for_review"))


@query(
    "q_model_calls",
    """
SELECT session_id, calls, failed, total_ms, CAST(coalesce(floor(total_ms / nullif(calls, 0)::DOUBLE + 0.5), 0) AS BIGINT) AS avg_ms, max_ms,
       coalesce(floor(total_ms / nullif(elapsed, 0)::DOUBLE * 100 + 0.5) / 100, 0.0) AS concurrency_factor
FROM (SELECT session_id, count(*) FILTER (type = 'model_call') AS calls, count(*) FILTER (type = 'model_call' AND ok = false) AS failed,
        CAST(coalesce(sum(coalesce(duration_ms, 0)) FILTER (type = 'model_call'), 0) AS BIGINT) AS total_ms,
        coalesce(max(coalesce(duration_ms, 0)) FILTER (type = 'model_call'), 0) AS max_ms, greatest(0, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) AS elapsed
      FROM v_run_log GROUP BY session_id)""",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return runlog.model_calls(t["v_run_log"])


_SUMS = ", ".join(f"CAST(sum(coalesce({u}, 0)) AS BIGINT) AS {u}" for u in runlog.USAGE)


@query(
    "q_by_agent",
    f"""SELECT session_id, coalesce(agent, '?') AS agent, count(*) AS calls, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms, max(coalesce(duration_ms, 0)) AS max_ms, {_SUMS}
FROM v_run_log WHERE type = 'model_call' GROUP BY session_id, coalesce(agent, '?')""",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return runlog.by_agent(t["v_run_log"])


@query(
    "q_tokens",
    f"SELECT session_id, {_SUMS}, count(coalesce({', '.join(runlog.USAGE)})) AS calls_reported FROM v_run_log WHERE type = 'model_call' GROUP BY session_id",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return runlog.token_totals(t["v_run_log"])


_BOUNDS = """SELECT session_id, min_by(ts, line) AS started_at, max_by(ts, line) AS last_at, min_by(ts, line) FILTER (type IN ('run_complete', 'run_failed')) AS terminal_at,
  min_by(type, line) FILTER (type IN ('run_complete', 'run_failed')) AS terminal_type FROM v_run_log GROUP BY session_id"""


@query("q_run_bounds", _BOUNDS, ("v_run_log",))
def _(t: Tables) -> DataFrame:
    return runlog.run_bounds(t["v_run_log"])


@query(
    "q_phase_durations",
    f"""WITH b AS ({_BOUNDS}), e AS (SELECT session_id, CASE WHEN session_id % 3 = 0 THEN {NOW_SQL} ELSE coalesce(terminal_at, last_at) END AS end_ref FROM b),
p AS (SELECT session_id, phase, line, ts, lead(ts) OVER (PARTITION BY session_id ORDER BY line) AS until FROM v_run_log WHERE type = 'phase' AND phase <> '')
SELECT session_id, phase, CAST(max_by(greatest(0, epoch_us(coalesce(until, end_ref)) // 1000 - epoch_us(ts) // 1000), line) AS BIGINT) AS duration_ms FROM p JOIN e USING (session_id) GROUP BY session_id, phase""",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return runlog.phase_durations(t["v_run_log"], status(), now())


@query(
    "q_slowest_calls",
    """SELECT session_id, CAST(rn AS INT) AS rank, agent, model, ms AS duration_ms, coalesce(ok, true) AS ok, line
FROM (SELECT *, coalesce(duration_ms, 0) AS ms, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(duration_ms, 0) DESC, line) AS rn FROM v_run_log WHERE type = 'model_call') WHERE rn <= 5""",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return runlog.slowest_calls(t["v_run_log"])


@query(
    "q_run_errors",
    "SELECT session_id, line, ts, type, coalesce(error, 'unknown') AS message FROM v_run_log WHERE type = 'run_failed' OR ok = false",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return runlog.run_errors(t["v_run_log"])


@query(
    "q_in_flight",
    """WITH c AS (SELECT *, coalesce(agent, '?') || '|' || coalesce(model, '?') || '|' || coalesce(capability, '?') AS key FROM v_run_log WHERE type IN ('model_call_start', 'model_call')),
e AS (SELECT session_id, key, count(*) FILTER (type = 'model_call') AS ended FROM c GROUP BY session_id, key),
s AS (SELECT session_id, key, ts, line, row_number() OVER (PARTITION BY session_id, key ORDER BY line) AS nth FROM c WHERE type = 'model_call_start')
SELECT session_id, count(*) AS open_calls, min(ts) AS oldest_at, min_by(key, (ts, line)) AS oldest_key FROM s JOIN e USING (session_id, key) WHERE nth > ended GROUP BY session_id""",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return runlog.in_flight(t["v_run_log"])


@query(
    "q_in_flight_exact",
    """WITH RECURSIVE c AS (SELECT session_id, ts, line, type, coalesce(agent, '?') || '|' || coalesce(model, '?') || '|' || coalesce(capability, '?') AS key,
  row_number() OVER (PARTITION BY session_id ORDER BY line) AS n FROM v_run_log WHERE type IN ('model_call_start', 'model_call')),
r AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(key VARCHAR, ts TIMESTAMP, line BIGINT)[]) AS opened FROM (SELECT DISTINCT session_id FROM c)
  UNION ALL SELECT session_id, n, CASE WHEN type = 'model_call_start' THEN list_append(opened, {'key': key, 'ts': ts, 'line': line}) ELSE list_concat(opened[1:k - 1], opened[k + 1:]) END
  FROM (SELECT c.*, r.opened, coalesce(list_position(list_transform(r.opened, lambda x: x.key), c.key), 1) AS k FROM r JOIN c ON c.session_id = r.session_id AND c.n = r.n + 1))
SELECT session_id, o.key, o.ts, o.line FROM (SELECT session_id, unnest(max_by(opened, n)) AS o FROM r GROUP BY session_id)""",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return runlog.in_flight_exact(t["v_run_log"])


_RAW = """SELECT user_id AS session_id, event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN concat(chr(123), '"ts": broken') ELSE
  concat(chr(123), '"ts":"2024-01-01T00:00:00.000Z","type":"', event_type, '","duration_ms":', cast(cast(floor(value) AS bigint) AS varchar(20)), chr(125)) END AS raw FROM {events}"""


@query(
    "q_log_parse",
    "WITH r AS (" + _RAW.replace("{events}", "events") + """), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) - 1 AS line FROM r)
SELECT session_id, CAST(line AS INT) AS line, regexp_extract(raw, '"type":"([a-z]+)"', 1) AS type, CAST(regexp_extract(raw, '"duration_ms":([0-9]+)', 1) AS BIGINT) AS duration_ms
FROM n WHERE suffix(raw, chr(125))""",
)
def _(t: Tables) -> DataFrame:
    raw = t.spark.sql(_RAW, events=t["events"])
    held = raw.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "raw"))).alias("held"))
    logs = held.select("session_id", F.array_join(F.transform("held", lambda x: x["raw"]), "\n").alias("value"))
    return runlog.parse_lines(logs).select("session_id", "line", "type", "duration_ms")
