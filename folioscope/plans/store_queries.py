"""Queries over the store: tallies, pages, merges, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import store
from .registry import Tables, query
from .views import NOW

DAYS = 14
LIMIT = 20
USER = 101
NOW_SQL = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    "q_volume_tally",
    "SELECT count(*) AS documents, CAST(coalesce(sum(image_count), 0) AS BIGINT) AS pages, min(first_completed_at) AS since"
    " FROM v_sessions WHERE first_completed_at IS NOT NULL",
    ("v_sessions",),
)
def _(t: Tables) -> DataFrame:
    return store.public_volume(t["v_sessions"])


@query(
    "q_quality_rates",
    f"""
SELECT documents, rounds / nullif(documents, 0)::DOUBLE AS mean_rounds, coalesce(u / nullif(documents, 0)::DOUBLE, 0.0) AS unresolved_rate,
       coalesce(d / nullif(documents, 0)::DOUBLE, 0.0) AS links_dropped_rate, coalesce(e / nullif(documents, 0)::DOUBLE, 0.0) AS lint_error_rate, since
FROM (SELECT count(*) FILTER (code = 'sys:rounds') AS documents, sum(count) FILTER (code = 'sys:rounds')::DOUBLE AS rounds,
        count(*) FILTER (code = 'sys:unresolved') AS u, count(*) FILTER (code = 'sys:links-dropped') AS d, count(*) FILTER (code = 'sys:lint-error') AS e,
        min(recorded_at) FILTER (code = 'sys:rounds') AS since
      FROM v_run_signals WHERE recorded_at >= {NOW_SQL} - INTERVAL {DAYS} DAY AND code LIKE 'sys:%')""",
    ("v_run_signals",),
)
def _(t: Tables) -> DataFrame:
    return store.quality_rates(t["v_run_signals"], now(), DAYS)


@query(
    "q_quality_rules",
    f"""
WITH w AS (SELECT * FROM v_run_signals WHERE recorded_at >= {NOW_SQL} - INTERVAL {DAYS} DAY),
n AS (SELECT count(*) AS total FROM w WHERE code = 'sys:rounds')
SELECT code, max(impact) AS impact, count(*) AS documents, CAST(sum(count) AS BIGINT) AS nodes, coalesce(count(*) / nullif(any_value(total), 0)::DOUBLE, 0.0) AS share
FROM w, n WHERE code NOT LIKE 'sys:%' GROUP BY code""",
    ("v_run_signals",),
)
def _(t: Tables) -> DataFrame:
    return store.quality_rules(t["v_run_signals"], now(), DAYS)


@query(
    "q_public_quality",
    f"""
SELECT documents, least(1.0, greatest(0.0, (documents - u) / documents::DOUBLE)) AS clean_rate, rounds / documents::DOUBLE AS mean_rounds
FROM (SELECT count(*) FILTER (code = 'sys:rounds') AS documents, count(*) FILTER (code = 'sys:unresolved') AS u, sum(count) FILTER (code = 'sys:rounds')::DOUBLE AS rounds
      FROM v_run_signals WHERE recorded_at >= {NOW_SQL} - INTERVAL 30 DAY) WHERE documents >= 20""",
    ("v_run_signals",),
)
def _(t: Tables) -> DataFrame:
    return store.public_quality(t["v_run_signals"], now())


_TEXTS = """SELECT e.event_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN concat('-', cast(k AS varchar(5))) WHEN 3 THEN '0'
  WHEN 4 THEN concat(cast(k AS varchar(5)), '.9') WHEN 5 THEN concat(cast(k * 100 AS varchar(8)), 'abc') WHEN 6 THEN concat(' ', cast(k AS varchar(5)), ' ')
  ELSE cast(k AS varchar(5)) END AS raw FROM {v_keyed} e"""
_TEXTS_SQL = _TEXTS.replace("{v_keyed}", "v_keyed")


def texts(t: Tables) -> DataFrame:
    return t.spark.sql(_TEXTS, v_keyed=t["v_keyed"])


@query(
    "q_window_clamp",
    f"WITH r AS ({_TEXTS_SQL}) SELECT event_id, raw, CAST(least(365, greatest(1, coalesce(nullif(floor(try_cast(trim(raw) AS DOUBLE)), 0), 30))) AS INT) AS days FROM r",
    ("v_keyed",),
)
def _(t: Tables) -> DataFrame:
    return texts(t).select("event_id", "raw", store.clamp_window(F.col("raw")).alias("days"))


@query(
    "q_limit_rule",
    f"""WITH r AS ({_TEXTS_SQL}), n AS (SELECT *, try_cast(nullif(regexp_extract(raw, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS v FROM r)
SELECT event_id, raw, CAST(CASE WHEN v >= 1 THEN least(v, 100) ELSE 20 END AS INT) AS page_limit FROM n""",
    ("v_keyed",),
)
def _(t: Tables) -> DataFrame:
    return texts(t).select("event_id", "raw", store.clamp_limit(F.col("raw")).alias("page_limit"))


@query(
    "q_session_page",
    f"""SELECT session_id, status, created_at, image_count, first_completed_at FROM v_sessions
WHERE github_user_id = {USER} AND (created_at, session_id) < (TIMESTAMP '1998-01-01 00:00:00', '9') ORDER BY created_at DESC, session_id DESC LIMIT 5""",
    ("v_sessions",),
)
def _(t: Tables) -> DataFrame:
    cursor = (F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), "9")
    return store.session_summary(store.list_sessions(t["v_sessions"], USER, 5, cursor=cursor))


@query(
    "q_session_page_status",
    f"""SELECT session_id, status, created_at, image_count, first_completed_at FROM v_sessions
WHERE github_user_id = {USER} AND status = 'queued' ORDER BY created_at DESC, session_id DESC LIMIT 5""",
    ("v_sessions",),
)
def _(t: Tables) -> DataFrame:
    return store.session_summary(store.list_sessions(t["v_sessions"], USER, 5, status="queued"))


@query(
    "q_session_pages_all",
    """SELECT github_user_id, session_id, CAST(rn AS INT) AS row, CAST((rn - 1) // 3 AS BIGINT) AS page_no, n > ((rn - 1) // 3 + 1) * 3 AS has_more
FROM (SELECT *, row_number() OVER (PARTITION BY github_user_id ORDER BY created_at DESC, session_id DESC) AS rn, count(*) OVER (PARTITION BY github_user_id) AS n FROM v_sessions)""",
    ("v_sessions",),
)
def _(t: Tables) -> DataFrame:
    return store.page_numbers(t["v_sessions"], 3).select("github_user_id", "session_id", "row", "page_no", "has_more")


_CURSORS = """SELECT session_id, CASE github_user_id % 6 WHEN 0 THEN concat('2024-03-05T06:07:08.009Z|', session_id) WHEN 1 THEN '2024-03-05T06:07:08.009Z'
  WHEN 2 THEN concat('2024-13-05T06:07:08.009Z|', session_id) WHEN 3 THEN concat('2024-03-05T06:07:08Z|', session_id) WHEN 4 THEN concat('2024-02-30T06:07:08.009Z|a|', session_id)
  ELSE concat('2024-03-05T06:07:08.009Z|a|', session_id) END AS raw FROM {v_sessions}"""


@query(
    "q_cursor_parse",
    "WITH r AS (" + _CURSORS.replace("{v_sessions}", "v_sessions") + r"""), p AS (
SELECT session_id, raw, split_part(raw, '|', 1) AS ts, CASE WHEN strpos(raw, '|') > 0 THEN substr(raw, strpos(raw, '|') + 1) ELSE '' END AS id FROM r)
SELECT session_id, raw, CASE WHEN ok THEN ts END AS cursor_ts, CASE WHEN ok THEN id END AS cursor_id
FROM (SELECT *, regexp_matches(ts, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$') AND try_cast(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP) IS NOT NULL AS ok FROM p)""",
    ("v_sessions",),
)
def _(t: Tables) -> DataFrame:
    raw = t.spark.sql(_CURSORS, v_sessions=t["v_sessions"])
    parsed = raw.withColumn("c", store.parse_cursor(F.col("raw")))
    return parsed.select("session_id", "raw", F.col("c.ts").alias("cursor_ts"), F.col("c.id").alias("cursor_id"))


@query("q_owned_session", "SELECT session_id, status, image_count FROM v_sessions WHERE session_id = '0000000001' AND github_user_id % 2 IN (0, 1)"
       " AND github_user_id = (SELECT o_custkey FROM orders WHERE o_orderkey = 1)", ("v_sessions",))  # fmt: skip
def _(t: Tables) -> DataFrame:
    owner = t["orders"].where("o_orderkey = 1").select("o_custkey").scalar()
    s = t["v_sessions"]
    return s.where((F.col("session_id") == "0000000001") & (F.col("github_user_id") == owner)).select("session_id", "status", "image_count")


@query("q_signals_merge", "SELECT session_id, run, code, count, impact FROM v_merged", ("v_merged",))
def _(t: Tables) -> DataFrame:
    return store.merge_signals(t["v_recorded"]).select("session_id", "run", "code", "count", "impact")


@query("q_signals_replace", "SELECT session_id, run, code, count, impact FROM v_run_signals", ("v_run_signals",))
def _(t: Tables) -> DataFrame:
    merged = store.merge_signals(t["v_recorded"])
    return store.latest_run(merged).select("session_id", "run", "code", "count", "impact")


@query(
    "q_user_upsert",
    """SELECT coalesce(o.github_user_id, n.github_user_id) AS github_user_id, coalesce(n.github_login, o.github_login) AS github_login,
       coalesce(o.max_review_iterations, 3) AS max_review_iterations, coalesce(o.created_at, n.created_at) AS created_at
FROM v_users o FULL JOIN v_logins n ON o.github_user_id = n.github_user_id""",
    ("v_users", "v_logins"),
)
def _(t: Tables) -> DataFrame:
    return store.upsert_users(t["v_users"], t["v_logins"])


_MOVES = """SELECT user_id AS session_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed'
  WHEN 'signup' THEN 'ready_for_review' ELSE 'closed' END AS status FROM {events}"""
_MOVES_SQL = _MOVES.replace("{events}", "events")


def moves(t: Tables) -> DataFrame:
    return t.spark.sql(_MOVES, events=t["events"])


@query(
    "q_session_fold",
    f"""WITH m AS ({_MOVES_SQL})
SELECT session_id, max_by(status, (ts, seq)) AS status, max(ts) AS updated_at, min(ts) FILTER (status = 'ready_for_review') AS first_completed_at FROM m GROUP BY session_id""",
)
def _(t: Tables) -> DataFrame:
    return store.fold_transitions(moves(t))


_CLAIMS = "SELECT user_id AS session_id, cast(ts AS date) AS epoch, event_id AS claim_id, ts FROM {events} WHERE event_type IN ('view', 'click')"


@query(
    "q_claim_winner",
    f"WITH c AS ({_CLAIMS.replace('{events}', 'events')}) SELECT session_id, epoch, min_by(claim_id, (ts, claim_id)) AS claim_id, min(ts) AS ts, count(*) AS claims FROM c GROUP BY session_id, epoch",
)
def _(t: Tables) -> DataFrame:
    return store.winning_claims(t.spark.sql(_CLAIMS, events=t["events"]))


@query(
    "q_compare_and_set",
    f"""WITH RECURSIVE m AS ({_MOVES_SQL}), c AS (SELECT session_id, seq AS claim_id, status, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS n FROM m),
r AS (SELECT session_id, claim_id, n, session_id % 5 <> 0 AS claimed, CASE WHEN session_id % 5 <> 0 THEN status END AS now FROM c WHERE n = 1
  UNION ALL SELECT c.session_id, c.claim_id, c.n, coalesce(r.now = 'ready_for_review', false), CASE WHEN r.now = 'ready_for_review' THEN c.status ELSE r.now END FROM r JOIN c ON c.session_id = r.session_id AND c.n = r.n + 1)
SELECT session_id, claim_id, claimed FROM r""",
)
def _(t: Tables) -> DataFrame:
    claims = moves(t).select("session_id", F.col("seq").alias("claim_id"), "ts", F.lit("ready_for_review").alias("expected"), "status")
    sessions = t["events"].select(F.col("user_id").alias("session_id")).distinct().where("session_id % 5 <> 0").withColumn("status", F.lit("ready_for_review"))
    return store.compare_and_set(sessions, claims)


@query(
    "q_stale_sweep",
    f"""SELECT session_id, CASE WHEN status IN ('running', 'queued') THEN 'failed' ELSE status END AS status,
  CASE WHEN status IN ('running', 'queued') THEN '{store.INTERRUPTED}' END AS error, CASE WHEN status IN ('running', 'queued') THEN {NOW_SQL} ELSE created_at END AS updated_at FROM v_sessions""",
    ("v_sessions",),
)
def _(t: Tables) -> DataFrame:
    s = t["v_sessions"].select("session_id", "status", F.lit(None).cast("string").alias("error"), F.col("created_at").alias("updated_at"))
    return store.fail_stale(s, now()).select("session_id", "status", "error", "updated_at")


@query(
    "q_completion_backfill",
    "SELECT session_id, CASE WHEN status IN ('ready_for_review', 'closed') THEN created_at END AS first_completed_at FROM v_sessions",
    ("v_sessions",),
)
def _(t: Tables) -> DataFrame:
    return store.backfill_completion(t["v_sessions"].withColumn("updated_at", F.col("created_at"))).select("session_id", "first_completed_at")


@query(
    "q_status_view",
    "SELECT session_id, status, CASE WHEN status = 'failed' AND error <> '' THEN error END AS error FROM (SELECT session_id, status, CASE WHEN image_count % 2 = 0 THEN '' ELSE 'boom' END AS error FROM v_sessions)",
    ("v_sessions",),
)
def _(t: Tables) -> DataFrame:
    error = F.when(F.col("image_count") % 2 == 0, F.lit("")).otherwise(F.lit("boom"))
    return t["v_sessions"].select("session_id", "status", store.visible_error(F.col("status"), error).alias("error"))


@query(
    "q_create_sessions",
    f"""SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS session_id, user_id AS github_user_id, 'queued' AS status, 'extraction' AS phase, CAST(0 AS BIGINT) AS iterations_completed,
  CAST(3 AS BIGINT) AS iterations_max, CAST(user_id % 25 AS BIGINT) AS image_count, {NOW_SQL} AS created_at FROM events WHERE event_type = 'signup'""",
)
def _(t: Tables) -> DataFrame:
    asked = t["events"].where("event_type = 'signup'").select(
        F.lpad(F.col("event_id").cast("string"), 10, "0").alias("session_id"), F.col("user_id").alias("github_user_id"), F.lit(3).cast("long").alias("iterations_max"), (F.col("user_id") % 25).alias("image_count")
    )
    return store.new_sessions(asked, now()).drop("error", "updated_at", "first_completed_at")


_RUNS = "SELECT cast(page_id AS varchar(20)) AS session_id, page_id % 4 AS rounds, page_id % 3 AS unresolved, page_id % 5 AS links_dropped, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS lint_failed FROM {pages}"
_FOUND = "SELECT cast(page_id AS varchar(20)) AS session_id, 'image-alt' AS id, 'critical' AS impact, page_id % 6 + 1 AS nodes FROM {pages} WHERE page_id % 2 = 0"


@query(
    "q_run_signals",
    f"""WITH r AS ({_RUNS.replace('{pages}', 'pages')}), v AS ({_FOUND.replace('{pages}', 'pages')}), s AS (
SELECT session_id, 'sys:rounds' AS code, NULL AS impact, CAST(rounds AS BIGINT) AS count FROM r UNION ALL SELECT session_id, 'sys:unresolved', NULL, unresolved FROM r WHERE unresolved > 0
UNION ALL SELECT session_id, 'sys:links-dropped', NULL, links_dropped FROM r WHERE links_dropped > 0 UNION ALL SELECT session_id, 'sys:lint-error', NULL, lint_failed FROM r WHERE lint_failed > 0
UNION ALL SELECT session_id, id, impact, nodes FROM v) SELECT session_id, code, CAST(impact AS VARCHAR) AS impact, count FROM s""",
)
def _(t: Tables) -> DataFrame:
    runs = t.spark.sql(_RUNS, pages=t["pages"]).withColumn("recorded_at", now())
    return store.run_signals(runs, t.spark.sql(_FOUND, pages=t["pages"])).drop("recorded_at")


@query("q_floored_percent", "SELECT event_id, CAST(floor(value / 500 * 100 + 1e-9) AS INT) AS percent FROM events")
def _(t: Tables) -> DataFrame:
    return t["events"].select("event_id", store.floored_percent(F.col("value") / 500).alias("percent"))
