"""Views that give the driver's tables the shape of the store, the run log and the page tables.

Each view is one SQL text that Spark and the oracle both run; ``{name}`` stands for a table or an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")

#: When reports are drawn up: just after the last event.
NOW = "2024-01-31 00:00:00"

VIEWS = {
    "v_sessions": """
SELECT lpad(cast(o_orderkey AS varchar(20)), 10, '0') AS session_id, o_custkey AS github_user_id,
       CASE o_orderstatus WHEN 'F' THEN 'ready_for_review' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status,
       o_orderdate AS created_at, cast(coalesce(n, 0) AS bigint) AS image_count,
       CASE WHEN o_orderstatus = 'F' THEN last_ship END AS first_completed_at
FROM {orders} LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last_ship FROM {lineitem} GROUP BY l_orderkey
) l ON o_orderkey = l_orderkey""",
    "v_users": """
SELECT c_custkey AS github_user_id, c_name AS github_login, cast(1 + c_nationkey % 5 AS bigint) AS max_review_iterations,
       '2024-01-01T00:00:00.000Z' AS created_at
FROM {customer} WHERE c_custkey % 3 <> 0""",
    "v_logins": """
SELECT c_custkey AS github_user_id, concat(c_name, '-new') AS github_login, '2024-02-01T00:00:00.000Z' AS created_at
FROM {customer} WHERE c_custkey % 2 = 0""",
    "v_recorded": """
SELECT user_id AS session_id, cast(ts AS date) AS run, event_id AS seq,
       CASE event_type WHEN 'signup' THEN 'sys:rounds' WHEN 'error' THEN 'sys:unresolved' WHEN 'purchase' THEN 'sys:links-dropped'
         WHEN 'click' THEN 'click-rule' ELSE 'view-rule' END AS code,
       CASE WHEN event_type IN ('click', 'view') THEN
         CASE event_id % 4 WHEN 0 THEN 'minor' WHEN 1 THEN 'serious' WHEN 2 THEN 'critical' END END AS impact,
       CASE WHEN event_type = 'signup' THEN 1.0 ELSE cast(value AS double) END AS count, ts AS recorded_at
FROM {events}
UNION ALL
SELECT user_id, cast(ts AS date), cast(-1 AS bigint), 'sys:rounds', cast(NULL AS varchar(10)), cast(0.0 AS double), max(ts)
FROM {events} GROUP BY user_id, cast(ts AS date)""",
    "v_merged": """
SELECT session_id, run, code, cast(sum(cast(greatest(0, floor(count)) AS bigint)) AS bigint) AS count,
       max_by(impact, CASE WHEN impact IS NOT NULL THEN seq END) AS impact, max(recorded_at) AS recorded_at
FROM {v_recorded} GROUP BY session_id, run, code""",
    "v_run_signals": """
SELECT m.* FROM {v_merged} m JOIN (SELECT session_id, max(run) AS last_run FROM {v_merged} GROUP BY session_id) l
  ON m.session_id = l.session_id AND m.run = l.last_run""",
    "v_keyed": """
SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM {events}""",
    "v_run_log": """
SELECT user_id AS session_id, event_id AS line, ts,
       CASE event_type WHEN 'view' THEN 'model_call_start' WHEN 'click' THEN 'model_call' WHEN 'error' THEN 'model_call'
         WHEN 'signup' THEN 'phase' ELSE 'run_complete' END AS type,
       CASE WHEN event_type = 'signup' THEN CASE k % 4 WHEN 0 THEN 'extraction' WHEN 1 THEN 'assembly' WHEN 2 THEN 'review' ELSE '' END END AS phase,
       CASE WHEN k % 7 <> 0 THEN concat('a', cast(k % 3 AS varchar(5))) END AS agent, 'm' AS model, cast(NULL AS varchar(5)) AS capability,
       CASE WHEN event_type IN ('click', 'error') AND k % 11 <> 0 THEN cast(floor(value * 1000) AS bigint) END AS duration_ms,
       CASE WHEN event_type = 'error' THEN false WHEN event_type = 'click' AND k % 2 = 0 THEN true END AS ok,
       CASE WHEN event_type = 'error' AND k % 3 = 0 THEN concat('e', cast(k AS varchar(5))) END AS error,
       CASE WHEN k % 5 <> 0 THEN cast(k * 10 AS bigint) END AS input_tokens, CASE WHEN k % 5 <> 0 THEN cast(k AS bigint) END AS output_tokens,
       CASE WHEN k % 5 = 1 THEN cast(k + 1 AS bigint) END AS cache_read_input_tokens,
       CASE WHEN k % 5 = 2 THEN cast(k + 2 AS bigint) END AS cache_creation_input_tokens
FROM {v_keyed}""",
    "v_fragments": """
SELECT cast(floor(page_id / 5.0) AS bigint) AS doc, cast(page_id % 5 + 1 AS int) AS ord, html AS inner_html FROM {pages}""",
    "v_text_pages": """
SELECT cast(floor(doc_id / 5.0) AS bigint) AS doc, cast(doc_id % 5 + 1 AS int) AS ord, text FROM {documents} WHERE text IS NOT NULL""",
    "v_fixtures": """
SELECT a.doc_id AS case_id, a.source AS agent, lpad(cast(a.doc_id AS varchar(20)), 10, '0') AS case_file, a.text AS accepted,
       CASE a.doc_id % 4 WHEN 0 THEN a.text WHEN 1 THEN b.text WHEN 2 THEN substring(a.text, 1, cast(floor(length(a.text) * 0.9) AS int)) ELSE '' END AS candidate,
       CASE a.doc_id % 3 WHEN 0 THEN true WHEN 1 THEN cast(NULL AS boolean) ELSE a.doc_id % 2 = 0 END AS faithful,
       CASE WHEN a.doc_id % 5 <> 0 THEN true ELSE a.doc_id % 10 = 0 END AS accessible,
       cast(a.doc_id % 4 AS int) AS blocks
FROM {documents} a LEFT JOIN {documents} b ON b.doc_id = a.doc_id + 1""",
    "v_lessons": """
SELECT lang AS agent, CASE WHEN doc_id % 7 = 0 THEN 'a11y_policy' ELSE 'generalizable' END AS kind,
       CASE WHEN doc_id % 3 = 0 THEN concat(substring(text, 1, 12), ' !') ELSE substring(text, 1, 12) END AS instruction,
       cast(doc_id AS varchar(20)) AS session, doc_id AS seq
FROM {documents} WHERE text IS NOT NULL""",
    "v_issues": """
SELECT conv_id AS doc, cast(turn AS int) AS round, role AS severity, length(text) AS size,
       CASE WHEN length(text) % 5 = 0 THEN '' ELSE cast(length(text) % 7 AS varchar(5)) END AS page_a,
       CASE length(text) % 3 WHEN 0 THEN 'x' WHEN 1 THEN '3.0' ELSE cast(length(text) % 11 AS varchar(5)) END AS page_b
FROM {conversations}""",
    "v_requests": """
SELECT event_id AS request_id, user_id AS client, user_id % 64 AS deployment, ts,
       CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 11 = 0 THEN -5 ELSE cast(floor(value * 1000) AS bigint) END AS declared_bytes,
       cast(floor(value) AS bigint) AS hold_s
FROM {events}""",
    "v_chunks": """
SELECT user_id AS call_id, event_id AS seq, ts,
       CASE event_type WHEN 'view' THEN 'keepalive' WHEN 'click' THEN 'text' WHEN 'error' THEN 'protocol' WHEN 'signup' THEN 'text' ELSE 'text' END AS kind,
       CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN cast(floor(value) AS int) % 3 ELSE 0 END AS text_length
FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def _needs(sql: str) -> list[str]:
    """Views that a text uses, those they use before them."""
    out: list[str] = []
    for name in _NAME.findall(sql):
        if name in VIEWS:
            for x in [*_needs(VIEWS[name]), name]:
                if x not in out:
                    out.append(x)
    return out


def oracle(sql: str, views: tuple[str, ...] = ()) -> str:
    """A query over views as one SQL text over the driver's tables."""
    names: list[str] = []
    for v in views:
        for x in [*_needs(VIEWS[v]), v]:
            if x not in names:
                names.append(x)
    plain = lambda text: _NAME.sub(lambda m: m[1], text)
    heads = [f"{n} AS ({plain(VIEWS[n]).strip()})" for n in names]
    body = sql.strip()
    if not heads:
        return body
    start = "WITH "
    if body[:15].upper() == "WITH RECURSIVE ":
        start, body = "WITH RECURSIVE ", ", " + body[15:]
    elif body[:5].upper() == "WITH ":
        body = ", " + body[5:]
    return start + ",\n".join(heads) + "\n" + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir`` or a view over its tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in dict.fromkeys(_NAME.findall(sql))})
