"""Queries over lessons, gates, limits, dispatch, queues and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import limits, text, urls
from ..operators import dispatch, gates, lessons, scheduling
from .registry import Tables, query
from .store_queries import now

# --- lessons -----------------------------------------------------------------------------------------------------

_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_BANK = f"""WITH k AS (SELECT *, {_KEY.format("instruction")} AS norm_key FROM v_lessons),
c AS (SELECT agent, norm_key, count(DISTINCT session) AS count, max_by(instruction, seq) AS instruction, max_by(kind, seq) AS kind, max(seq) AS updated_seq FROM k GROUP BY agent, norm_key),
b AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY count DESC, updated_seq DESC, norm_key) AS rank FROM c)"""


@query("q_norm_key", f"SELECT doc_id, {_KEY.format('substring(text, 1, 200)')} AS norm_key FROM documents")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", text.norm_key(F.substring("text", 1, 200)).alias("norm_key"))


_FILLER = ", ".join(f"'{w}'" for w in text.SLUG_FILLER)


@query(
    "q_lesson_slug",
    f"""WITH w AS (SELECT doc_id, string_split({_KEY.format('substring(text, 1, 200)')}, ' ')[1:8] AS w FROM documents WHERE lang = 'en'),
k AS (SELECT doc_id, w[1:greatest(1, len(list_filter(range(1, len(w) + 1), lambda n: length(array_to_string(w[1:n], ' ')) <= 60)))] AS w FROM w)
SELECT doc_id, array_to_string(w[1:list_max(list_transform(range(1, len(w) + 1), lambda n: CASE WHEN n = 1 OR w[n] NOT IN ({_FILLER}) THEN n ELSE 0 END))], ' ') AS slug FROM k""",
)
def _(t: Tables) -> DataFrame:
    return t["documents"].where("lang = 'en'").select("doc_id", text.lesson_slug(F.substring("text", 1, 200)).alias("slug"))


# Over whole texts of all documents, which the SQL of the two above does not read; tests hold them against brute force.
@query("q_norm_key_whole")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", text.norm_key(F.col("text")).alias("norm_key"))


@query("q_lesson_slug_whole")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", text.lesson_slug(F.col("text")).alias("slug"))


@query(
    "q_snippet",
    r"SELECT doc_id, CASE WHEN length(s) > 280 THEN substring(s, 1, 280) || '…' ELSE s END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)",
)
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("q_lessons_corroborated", _BANK + " SELECT agent, norm_key, count, instruction, kind, updated_seq FROM c", ("v_lessons",))
def _(t: Tables) -> DataFrame:
    return lessons.corroborated(t["v_lessons"])


@query("q_lessons_bank", _BANK + " SELECT agent, norm_key, count, instruction, kind, updated_seq, CAST(rank AS INT) AS rank FROM b WHERE rank <= 20", ("v_lessons",))
def _(t: Tables) -> DataFrame:
    return lessons.bank(t["v_lessons"])


@query(
    "q_lessons_eligible",
    _BANK + """, e AS (SELECT agent, norm_key, count, instruction, kind, updated_seq, row_number() OVER (PARTITION BY agent ORDER BY count DESC, updated_seq DESC, norm_key) AS r
FROM b WHERE rank <= 20 AND (kind = 'a11y_policy' OR count >= 2)) SELECT agent, norm_key, count, instruction, kind, updated_seq, CAST(r AS INT) AS rank FROM e WHERE r <= 6""",
    ("v_lessons",),
)
def _(t: Tables) -> DataFrame:
    return lessons.eligible(lessons.bank(t["v_lessons"]))


# --- gates -------------------------------------------------------------------------------------------------------

_WORDS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower(regexp_replace({}, '\[[^\]]*\]', ' ', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1))"
_SCORED = f"""WITH w AS (SELECT *, {_WORDS.format('accepted')} AS a, {_WORDS.format('candidate')} AS c FROM v_fixtures),
s AS (SELECT * EXCLUDE (a, c), CASE WHEN len(a) >= 8 THEN len(list_intersect(a, c))::DOUBLE / len(a) END AS covered FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY case_file DESC) AS rank FROM s)"""


def scored(t: Tables) -> DataFrame:
    return t["v_fixtures"].withColumn("covered", gates.fixture_coverage(F.col("accepted"), F.col("candidate"))).drop("accepted", "candidate")


@query("q_coverage", _SCORED + " SELECT case_id, covered FROM s", ("v_fixtures",))
def _(t: Tables) -> DataFrame:
    return scored(t).select("case_id", "covered")


@query("q_fixture_scores", _SCORED + " SELECT case_id, CASE WHEN blocks = 0 THEN 0.0 ELSE covered END AS score FROM s", ("v_fixtures",))
def _(t: Tables) -> DataFrame:
    return scored(t).select("case_id", gates.fixture_score(F.col("blocks"), F.col("covered")).alias("score"))


@query("q_gate_fixtures_topn", "SELECT case_id, agent, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY case_file DESC) AS rank FROM v_fixtures) WHERE rank <= 3", ("v_fixtures",))
def _(t: Tables) -> DataFrame:
    return gates.newest(t["v_fixtures"]).select("case_id", "agent", "rank")


@query(
    "q_regression_gate",
    _SCORED + """, f AS (SELECT agent, blocks = 0 OR coalesce(covered < 0.85, false) OR NOT (coalesce(faithful, true) AND coalesce(accessible, true)) AS fails FROM n WHERE rank <= 3),
g AS (SELECT DISTINCT source AS agent FROM documents UNION SELECT 'none')
SELECT g.agent, count(f.agent) AS cases, count(*) FILTER (fails) AS failures, count(*) FILTER (fails) = 0 AS passed FROM g LEFT JOIN f ON g.agent = f.agent GROUP BY g.agent""",
    ("v_fixtures",),
)
def _(t: Tables) -> DataFrame:
    agents = t["documents"].select(F.col("source").alias("agent")).union(t.spark.sql("SELECT 'none' AS agent")).distinct()
    newest = gates.newest(t["v_fixtures"])
    cases = newest.withColumn("covered", gates.fixture_coverage(F.col("accepted"), F.col("candidate")))
    return gates.regression_gate(agents, cases)


_PAIRED = """, cur AS (SELECT agent, case_file, CASE WHEN case_id % 9 <> 0 THEN covered END AS score FROM s WHERE case_id % 5 <> 0),
can AS (SELECT agent, case_file, CASE WHEN blocks = 0 THEN 0.0 ELSE covered END AS score FROM s WHERE case_id % 7 <> 0),
m AS (SELECT coalesce(cur.agent, can.agent) AS agent, count(*) FILTER (cur.score IS NOT NULL AND can.score IS NOT NULL) AS paired,
  avg(cur.score) FILTER (can.score IS NOT NULL) AS a, avg(can.score) FILTER (cur.score IS NOT NULL) AS b FROM cur FULL JOIN can ON cur.agent = can.agent AND cur.case_file = can.case_file GROUP BY 1)"""


def means(t: Tables) -> DataFrame:
    s = scored(t)
    current = s.where("case_id % 5 <> 0").select("agent", "case_file", F.when(F.col("case_id") % 9 != 0, F.col("covered")).alias("score"))
    candidate = s.where("case_id % 7 <> 0").select("agent", "case_file", gates.fixture_score(F.col("blocks"), F.col("covered")).alias("score"))
    return gates.paired_means(current, candidate)


@query("q_paired_means", _SCORED + _PAIRED + " SELECT agent, paired, round(a, 9) AS current_mean, round(b, 9) AS candidate_mean FROM m", ("v_fixtures",))
def _(t: Tables) -> DataFrame:
    return means(t).select("agent", "paired", F.round("current_mean", 9).alias("current_mean"), F.round("candidate_mean", 9).alias("candidate_mean"))


@query("q_eval_gate", _SCORED + _PAIRED + " SELECT agent, coalesce(b < a - 0.02, false) AS blocked FROM m", ("v_fixtures",))
def _(t: Tables) -> DataFrame:
    return gates.eval_gate(means(t)).select("agent", "blocked")


@query(
    "q_merge_proposals",
    "SELECT user_id AS agent_name, max_by(event_id, (ts, event_id)) AS proposal, max(ts) AS run_ts FROM events WHERE event_type = 'signup' GROUP BY user_id",
)
def _(t: Tables) -> DataFrame:
    p = t["events"].where("event_type = 'signup'").select(F.col("user_id").alias("agent_name"), F.col("event_id").alias("proposal"), F.col("ts").alias("run_ts"), F.col("event_id").alias("seq"))
    return gates.merge_proposals(p)


@query(
    "q_capture_fixtures",
    """WITH f AS (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS session, doc_id AS seq, lang AS agent, CAST(doc_id % 2 AS VARCHAR) AS image, substring(text, 1, 20) AS html FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
i AS (SELECT session, agent, min_by(image, seq) AS image FROM f GROUP BY session, agent)
SELECT session, agent, image, string_agg(html, chr(10) || chr(10) ORDER BY seq) AS accepted_html FROM f JOIN i USING (session, agent, image) GROUP BY session, agent, image""",
)
def _(t: Tables) -> DataFrame:
    return gates.capture_fixtures(_fragments(t, F.substring("text", 1, 20)))


@query("q_capture_fixtures_whole")
def _(t: Tables) -> DataFrame:
    return gates.capture_fixtures(_fragments(t, F.col("text")))


def _fragments(t: Tables, html: Column) -> DataFrame:
    d = t["documents"].where("text IS NOT NULL AND lang IS NOT NULL")
    return d.select(F.floor(F.col("doc_id") / 5).alias("session"), F.col("doc_id").alias("seq"), F.col("lang").alias("agent"), (F.col("doc_id") % 2).cast("string").alias("image"), html.alias("html"))


# --- scalars -----------------------------------------------------------------------------------------------------

_MODEL = "CASE event_id % 6 WHEN 0 THEN 'anthropic.claude-example-4-7' WHEN 1 THEN 'claude-sample-4.6' WHEN 2 THEN 'claude-small-5' WHEN 3 THEN 'claude-example-4-10' WHEN 4 THEN 'other-model-1' ELSE 'claude-instant' END"


@query(
    "q_model_generation",
    f"""WITH m AS (SELECT event_id, {_MODEL} AS model FROM events), g AS (SELECT event_id, model, try_cast(nullif(regexp_extract(model, 'claude-[a-z]+-([0-9]+)(?:[.-]([0-9]+))?', 1), '') AS INT) AS major,
  coalesce(try_cast(nullif(regexp_extract(model, 'claude-[a-z]+-([0-9]+)(?:[.-]([0-9]+))?', 2), '') AS INT), 0) AS minor FROM m)
SELECT event_id, major, CASE WHEN major IS NOT NULL THEN minor END AS minor, CASE WHEN major > 4 OR (major = 4 AND minor >= 7) THEN 2576 ELSE 1568 END AS long_edge FROM g""",
)
def _(t: Tables) -> DataFrame:
    m = F.expr(_MODEL)
    g = limits.model_generation(m)
    return t["events"].select("event_id", g["major"].alias("major"), g["minor"].alias("minor"), limits.long_edge(m).alias("long_edge"))


_AGENTS = [("page", "p1", "claude-example-4-7"), ("feedback", "p2", "claude-sample-4-5"), ("copy_editor", "p3", "claude-example-5"), ("builder", "p1", "x"), ("reader", "p4", "claude-a-1")]
_PROVIDERS = [("p1", 4_000_000, None, None), ("p2", None, 3_500_000, None), ("p3", None, None, 1200), ("p4", 1, 1, 1)]


@query("q_image_limits", "SELECT CAST(3000000 AS BIGINT) AS max_bytes, CAST(1200 AS BIGINT) AS long_edge_px")
def _(t: Tables) -> DataFrame:
    models = t.spark.createDataFrame(_AGENTS, "agent string, provider string, model string")
    providers = t.spark.createDataFrame(_PROVIDERS, "provider string, max_base64_bytes long, max_image_bytes long, max_long_edge_px long")
    return dispatch.image_limits(models, providers)


def _bytes_sql(n: str) -> str:
    return f"CASE WHEN {n} >= 1048576 THEN regexp_replace(CAST(CAST(floor({n} / 1048576 * 10) / 10 AS DECIMAL(20, 1)) AS VARCHAR), '\\.0$', '') || ' MB' ELSE CAST(floor({n} / 1024) AS BIGINT) || ' KB' END"


@query("q_bytes_format", f"SELECT event_id, {_bytes_sql('CAST(floor(value * 40000) AS BIGINT)')} AS size FROM events")
def _(t: Tables) -> DataFrame:
    return t["events"].select("event_id", limits.human_bytes(F.floor(F.col("value") * 40000)).alias("size"))


@query(
    "q_image_rejection",
    f"""WITH i AS (SELECT event_id, CAST(floor(value * 40000) AS BIGINT) AS b, CASE WHEN event_id % 4 <> 0 THEN event_id % 9000 END AS w, CASE WHEN event_id % 4 <> 0 THEN event_id % 8500 END AS h FROM events)
SELECT event_id, CASE WHEN b > 3932160 THEN 'image is ' || {_bytes_sql('b')} || '; the limit is 3.7 MB' WHEN greatest(w, h) > 8000 THEN 'image side is ' || greatest(w, h) || ' px; the limit is 8000 px' END AS rejection FROM i""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    w, h = F.when(i % 4 != 0, i % 9000), F.when(i % 4 != 0, i % 8500)
    return t["events"].select("event_id", limits.image_rejection(F.floor(F.col("value") * 40000), w, h, F.lit(3_932_160)).alias("rejection"))


_FILE = "CASE page_id % 5 WHEN 0 THEN concat('dir/My file ', cast(page_id AS varchar(9)), '.PNG') WHEN 1 THEN 'a.tar.webp' WHEN 2 THEN 'noext' WHEN 3 THEN '.hidden' ELSE 'scan.jpeg' END"


@query(
    "q_media_type",
    f"""SELECT page_id, CASE lower(regexp_extract({_FILE}, '(\\.[^./]*)$', 1)) WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' ELSE 'image/png' END AS media_type,
  CASE page_id % 5 WHEN 0 THEN concat('My_file_', page_id) WHEN 1 THEN 'a.tar' WHEN 2 THEN 'noext' WHEN 3 THEN 'document' ELSE 'scan' END || '_converted.html' AS output_name FROM pages""",
)
def _(t: Tables) -> DataFrame:
    name = F.expr(_FILE)
    return t["pages"].select("page_id", limits.media_type(name).alias("media_type"), text.converted_name(name).alias("output_name"))


_SETTING = "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '0' WHEN 3 THEN '-3' WHEN 4 THEN ' 7.9 ' WHEN 5 THEN '100' ELSE cast(NULL AS varchar(5)) END"
_N = f"floor(try_cast(trim({_SETTING}) AS DOUBLE))"


@query(
    "q_normalizers",
    f"""SELECT event_id, CAST(CASE WHEN {_N} IS NULL OR {_N} < 1 THEN 32000 ELSE {_N} END AS BIGINT) AS max_tokens, CAST(CASE WHEN {_N} IS NULL THEN 2 ELSE least(greatest({_N}, 1), 32) END AS BIGINT) AS concurrent_runs,
  CAST(CASE WHEN {_N} IS NULL THEN 5 ELSE least(greatest({_N}, 1), 16) END AS BIGINT) AS concurrency, CAST(CASE WHEN {_N} IS NULL THEN 3 ELSE greatest({_N}, 1) END AS BIGINT) AS review_iterations FROM events""",
)
def _(t: Tables) -> DataFrame:
    s = F.expr(_SETTING)
    return t["events"].select(
        "event_id", limits.max_tokens(s).alias("max_tokens"), limits.concurrent_runs(s).alias("concurrent_runs"), limits.concurrency(s).alias("concurrency"), limits.review_iterations(s).alias("review_iterations")
    )


@query(
    "q_usage_sum",
    """WITH u AS (SELECT session_id AS call_id, line % 3 AS attempt, line AS seq, input_tokens, output_tokens FROM v_run_log),
l AS (SELECT call_id, attempt, max_by(input_tokens, seq) FILTER (input_tokens IS NOT NULL) AS i, max_by(output_tokens, seq) FILTER (output_tokens IS NOT NULL) AS o FROM u GROUP BY call_id, attempt)
SELECT call_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM l GROUP BY call_id""",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    e = t["v_run_log"].select(F.col("session_id").alias("call_id"), (F.col("line") % 3).alias("attempt"), F.col("line").alias("seq"), "input_tokens", "output_tokens")
    return scheduling.call_usage(e)


@query(
    "q_usage_normalized",
    "SELECT line, CASE WHEN input_tokens IS NOT NULL THEN greatest(0, input_tokens - coalesce(cache_read_input_tokens, 0)) END AS input_tokens FROM v_run_log",
    ("v_run_log",),
)
def _(t: Tables) -> DataFrame:
    return t["v_run_log"].select("line", limits.normal_usage(F.col("input_tokens"), F.col("cache_read_input_tokens")).alias("input_tokens"))


@query(
    "q_client_key",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 't:' || substring(sha256('tok' || user_id), 1, 16) ELSE 'ip:10.0.0.' || user_id END AS client,
  CASE WHEN event_id % 3 = 0 THEN 'tok' || user_id END AS bearer FROM events""",
)
def _(t: Tables) -> DataFrame:
    u, i = F.col("user_id").cast("string"), F.col("event_id")
    token = F.when(i % 2 == 0, F.concat(F.lit("tok"), u))
    header = F.when(i % 3 == 0, F.concat(F.lit("bearer  tok"), u, F.lit(" "))).when(i % 3 == 1, F.lit("Basic x")).otherwise(F.lit(""))
    return t["events"].select("event_id", urls.client_key(token, F.concat(F.lit("10.0.0."), u)).alias("client"), urls.bearer_token(header).alias("bearer"))


@query(
    "q_retries",
    """SELECT event_id, CAST(400 * power(2, event_id % 4) AS BIGINT) AS delay_ms, event_id % 4 + 1 < 3 AND event_id % 5 <> 0 AND
  (CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 404 WHEN 4 THEN 503 ELSE 0 END IN (429, 500, 502, 503, 504) OR event_id % 6 = 5) AS retried FROM events""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 429, 500, 404, 503, 0))), (i % 6 + 1).cast("int"))
    return t["events"].select("event_id", limits.retry_delay_ms(i % 4 + 1).alias("delay_ms"), limits.is_retryable(status, i % 6 == 5, i % 5 == 0, i % 4 + 1).alias("retried"))


@query("q_quoted_feedback", r"""SELECT doc_id, '```' || ' ' || CASE WHEN length(s) > 500 THEN substring(s, 1, 500) || '…' ELSE s END || ' ```' AS quoted
FROM (SELECT doc_id, trim(regexp_replace('``x`` ' || text, '\s+', ' ', 'g')) AS s FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    d = t["documents"].where("text IS NOT NULL")
    return d.select("doc_id", text.quoted(F.concat(F.lit("``x`` "), "text")).alias("quoted"))


# --- dispatch ----------------------------------------------------------------------------------------------------

_NAMES = "CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'Table' WHEN 2 THEN 'chart.md' WHEN 3 THEN ' map ' WHEN 4 THEN 'FORMFIELD' WHEN 5 THEN 'Chart' WHEN 6 THEN concat('kind', cast(user_id % 9 AS varchar(5))) ELSE 'timeline' END"
_TYPE = f"trim(regexp_replace(trim({_NAMES}), '\\.md$', ''))"
_STANDARD = ", ".join(f"'{x.lower()}'" for x in dispatch.STANDARD_TYPES)


@query(
    "q_dispatch",
    f"""WITH r AS (SELECT event_id, {_TYPE} AS type, event_id % 3 AS found FROM events)
SELECT event_id, CASE WHEN type = '' THEN 'unresolved' WHEN lower(type) IN ({_STANDARD}) THEN 'declined' WHEN type NOT IN ('chart', 'map', 'kind1') THEN 'unresolved' WHEN found = 0 THEN 'no_content' ELSE 'dispatched' END AS decision FROM r""",
)
def _(t: Tables) -> DataFrame:
    library = t.spark.createDataFrame([("chart",), ("map",), ("kind1",)], "name string")
    asked = t["events"].select("event_id", F.expr(_NAMES).alias("name"), (F.col("event_id") % 3).alias("found"))
    return dispatch.dispatch(asked, library).select("event_id", "decision")


@query(
    "q_new_types",
    f"""WITH s AS (SELECT event_id AS seq, {_TYPE} AS type FROM events)
SELECT min(seq) AS seq, min_by(type, seq) AS type FROM s WHERE type <> '' AND lower(type) NOT IN ({_STANDARD}) AND lower(type) NOT IN ('map', 'kind1') GROUP BY lower(type)""",
)
def _(t: Tables) -> DataFrame:
    library = t.spark.createDataFrame([("Map.md",), ("kind1",)], "name string")
    return dispatch.new_types(t["events"].select(F.col("event_id").alias("seq"), F.expr(_NAMES).alias("name")), library)


@query("q_agent_names", "SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL")
def _(t: Tables) -> DataFrame:
    d = t["documents"]
    extra = t.spark.createDataFrame([("page",), ("feedback",)], "name string")
    return dispatch.dispatchable_names(d.select(F.col("source").alias("name")), d.where("lang IS NOT NULL").select(F.col("lang").alias("name")), extra)


@query(
    "q_quality_alerts",
    f"""WITH s AS (SELECT event_type AS code, count(*) AS documents, avg(value) / 500 AS rate, CAST(CASE event_type WHEN 'error' THEN 0.0 ELSE 0.05 END AS DOUBLE) AS threshold FROM events GROUP BY event_type)
SELECT code, documents, round(rate, 9) AS rate, threshold FROM s WHERE documents >= 20 AND rate > threshold AND code <> 'click' AND code <> 'view'
ORDER BY threshold > 0, rate - threshold DESC, code LIMIT 2""",
)
def _(t: Tables) -> DataFrame:
    threshold = F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.lit(0.05))
    rates = t["events"].groupBy(F.col("event_type").alias("code"), threshold.alias("threshold")).agg(F.count("*").alias("documents"), (F.avg("value") / 500).alias("rate"))
    issues = t.spark.sql("SELECT 'click' AS code, true AS open, cast(NULL AS timestamp_ntz) AS closed_at UNION ALL SELECT 'view', false, timestamp_ntz '2024-01-20 00:00:00' UNION ALL SELECT 'signup', false, timestamp_ntz '2023-01-01 00:00:00'")
    return dispatch.quality_alerts(rates, issues, now()).select("code", "documents", F.round("rate", 9).alias("rate"), "threshold")


@query("q_issue_actions", "SELECT DISTINCT 'Agent update proposal: ' || lang AS title, CASE WHEN lang = 'en' THEN 'commented' ELSE 'created' END AS action FROM documents WHERE lang IS NOT NULL")
def _(t: Tables) -> DataFrame:
    wanted = t["documents"].where("lang IS NOT NULL").select(dispatch.proposal_title(F.col("lang"), F.lit("")).alias("title")).distinct()
    return dispatch.issue_actions(wanted, t.spark.createDataFrame([("Agent update proposal: en",)], "title string"))


# --- rates, queues, stalls ---------------------------------------------------------------------------------------

_CROWD = "(SELECT event_id AS request_id, user_id % 3 AS client, date_trunc('day', ts) + INTERVAL (user_id) SECOND AS ts FROM events)"


def crowd(t: Tables) -> DataFrame:
    moment = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("user_id"))
    return t["events"].select(F.col("event_id").alias("request_id"), (F.col("user_id") % 3).alias("client"), moment.alias("ts"))


@query(
    "q_rate_windows",
    f"SELECT client, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS requests, greatest(count(*) - 12, 0) AS refused FROM {_CROWD} GROUP BY 1, 2",
)
def _(t: Tables) -> DataFrame:
    return scheduling.rate_windows(crowd(t), 12)


@query(
    "q_refusals",
    f"""WITH r AS (SELECT *, time_bucket(INTERVAL 60 SECOND, ts) AS w FROM {_CROWD}), n AS (SELECT *, row_number() OVER (PARTITION BY client, w ORDER BY ts, request_id) AS nth FROM r)
SELECT request_id, client, ts, CAST(greatest(1, ceil(epoch(w + INTERVAL 60 SECOND) - epoch(ts))) AS INT) AS retry_after_s FROM n WHERE nth > 12""",
)
def _(t: Tables) -> DataFrame:
    return scheduling.refusals(crowd(t), 12)


@query(
    "q_inflight_bytes",
    """WITH c AS (SELECT *, CASE WHEN declared_bytes > 0 AND declared_bytes < 200000 THEN declared_bytes ELSE 200000 END AS charge FROM v_requests),
s AS (SELECT client, request_id, ts AS "at", charge AS delta FROM c UNION ALL SELECT client, request_id, ts + INTERVAL (hold_s) SECOND, -charge FROM c)
SELECT client, request_id, "at", delta, CAST(sum(delta) OVER (PARTITION BY client ORDER BY "at", delta, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM s""",
    ("v_requests",),
)
def _(t: Tables) -> DataFrame:
    return scheduling.occupancy(t["v_requests"], 200_000)


@query(
    "q_admitted",
    """WITH RECURSIVE n AS (SELECT deployment, client, request_id, epoch_us(ts) / 1e6 AS at_s, hold_s, CASE WHEN declared_bytes > 0 AND declared_bytes < 200000 THEN declared_bytes ELSE 200000 END AS charge,
  row_number() OVER (PARTITION BY deployment ORDER BY ts, request_id) AS n FROM v_requests),
r AS (SELECT deployment, client, request_id, n, true AS admitted, [{'ends': at_s + hold_s, 'charge': charge}] AS flying FROM n WHERE n = 1
  UNION ALL SELECT deployment, client, request_id, n, ok, CASE WHEN ok THEN list_append(left_, {'ends': at_s + hold_s, 'charge': charge}) ELSE left_ END
  FROM (SELECT *, len(left_) = 0 OR list_sum(list_transform(left_, lambda x: x.charge)) + charge <= 300000 AS ok
    FROM (SELECT n.*, list_filter(r.flying, lambda x: x.ends > n.at_s) AS left_ FROM r JOIN n ON n.deployment = r.deployment AND n.n = r.n + 1)))
SELECT client, request_id, admitted FROM r""",
    ("v_requests",),
)
def _(t: Tables) -> DataFrame:
    return scheduling.admitted(t["v_requests"], 200_000, 300_000, "deployment")


@query(
    "q_body_meter",
    """WITH c AS (SELECT user_id AS request_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS bytes FROM events), s AS (SELECT *, sum(bytes) OVER (PARTITION BY request_id ORDER BY seq) AS size FROM c)
SELECT request_id, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) FILTER (size > 3000) AS cut_at FROM s GROUP BY request_id""",
)
def _(t: Tables) -> DataFrame:
    return scheduling.metered(t["events"].select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.floor("value").alias("bytes")), 3000)


@query(
    "q_queue_waits",
    """WITH RECURSIVE j AS (SELECT user_id AS queue, event_id AS job_id, epoch(ts) AS submit_s, floor(value) * 100 AS run_s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT queue, job_id, n, submit_s, run_s, submit_s AS started_s FROM j WHERE n = 1
  UNION ALL SELECT j.queue, j.job_id, j.n, j.submit_s, j.run_s, greatest(j.submit_s, r.started_s + r.run_s) FROM r JOIN j ON j.queue = r.queue AND j.n = r.n + 1)
SELECT queue, job_id, round(started_s, 3) AS started_s, round(started_s - submit_s, 3) AS waited_s FROM r""",
)
def _(t: Tables) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    jobs = t["events"].select(F.col("user_id").alias("queue"), F.col("event_id").alias("job_id"), s.alias("submit_s"), (F.floor("value") * 100.0).alias("run_s"))
    return scheduling.queue_waits(jobs, 1).select("queue", "job_id", F.round("started_s", 3).alias("started_s"), F.round("waited_s", 3).alias("waited_s"))


@query(
    "q_queue_waits_two_slots",
    """WITH RECURSIVE j AS (SELECT user_id AS queue, event_id AS job_id, epoch_us(ts) / 1e6 AS submit_s, floor(value) * 100 AS run_s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT queue, job_id, n, submit_s, submit_s AS started_s, 0.0::DOUBLE AS low, submit_s + run_s AS high FROM j WHERE n = 1
  UNION ALL SELECT j.queue, j.job_id, j.n, j.submit_s, greatest(j.submit_s, low), least(high, greatest(j.submit_s, low) + j.run_s), greatest(high, greatest(j.submit_s, low) + j.run_s) FROM r JOIN j ON j.queue = r.queue AND j.n = r.n + 1)
SELECT queue, job_id, round(started_s, 3) AS started_s, round(started_s - submit_s, 3) AS waited_s FROM r""",
)
def _(t: Tables) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    jobs = t["events"].select(F.col("user_id").alias("queue"), F.col("event_id").alias("job_id"), s.alias("submit_s"), (F.floor("value") * 100.0).alias("run_s"))
    return scheduling.queue_waits(jobs, 2).select("queue", "job_id", F.round("started_s", 3).alias("started_s"), F.round("waited_s", 3).alias("waited_s"))


@query(
    "q_stalls",
    """WITH l AS (SELECT * FROM v_chunks WHERE kind <> 'keepalive'), c AS (SELECT *, sum(text_length) OVER w AS sofar, min(ts) OVER w AS began FROM l WINDOW w AS (PARTITION BY call_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, lag(ts) OVER w AS before, coalesce(lag(sofar) OVER w > 0, false) AS had FROM c WINDOW w AS (PARTITION BY call_id ORDER BY ts, seq)),
k AS (SELECT *, CASE WHEN had AND epoch_us(ts) - epoch_us(before) > 60000000 THEN 'idle' WHEN NOT had AND epoch_us(ts) - epoch_us(before) > 120000000 THEN 'first_output' WHEN epoch_us(ts) - epoch_us(began) > 900000000 THEN 'total' END AS stall FROM g)
SELECT call_id, min_by(seq, (ts, seq)) AS seq, min_by(stall, (ts, seq)) AS kind FROM k WHERE stall IS NOT NULL GROUP BY call_id""",
    ("v_chunks",),
)
def _(t: Tables) -> DataFrame:
    return scheduling.stalls(t["v_chunks"])


@query(
    "q_token_cache",
    """WITH RECURSIVE l AS (SELECT event_id % 40 AS client, event_id AS request_id, event_id * 7 + event_id % 11 AS at_s FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY at_s, request_id) AS n FROM l),
r AS (SELECT client, request_id, n, at_s AS made, false AS hit FROM n WHERE n = 1
  UNION ALL SELECT n.client, n.request_id, n.n, CASE WHEN n.at_s - r.made < 300 THEN r.made ELSE n.at_s END, n.at_s - r.made < 300 FROM r JOIN n ON n.client = r.client AND n.n = r.n + 1)
SELECT client, request_id, hit FROM r""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    moment = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=i * 7 + i % 11)
    return scheduling.token_cache(t["events"].select((i % 40).alias("client"), i.alias("request_id"), moment.alias("ts")))


@query(
    "q_token_cache_bounded",
    """WITH RECURSIVE l AS (SELECT event_id % 61 AS gate, CASE WHEN event_id % 61 < 20 THEN event_id % 4 ELSE user_id % 17 END AS client, event_id AS request_id, event_id AS at_s FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY at_s, request_id) AS n FROM l),
r AS (SELECT gate, client, request_id, n, false AS hit, [{'c': client, 'e': at_s + 900}] AS entries FROM n WHERE n = 1
  UNION ALL SELECT gate, client, request_id, n, hit, CASE WHEN hit THEN entries ELSE list_append(CASE WHEN len(alive) >= 6 THEN alive[len(alive) - 4 :] ELSE alive END, {'c': client, 'e': at_s + 900}) END
  FROM (SELECT *, len(list_filter(alive, lambda x: x.c = client)) > 0 AS hit FROM (SELECT n.*, r.entries, list_filter(r.entries, lambda x: x.e > n.at_s) AS alive FROM r JOIN n ON n.gate = r.gate AND n.n = r.n + 1)))
SELECT client, request_id, hit FROM r""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    client = F.when(i % 61 < 20, i % 4).otherwise(F.col("user_id") % 17)
    moment = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=i)
    return scheduling.token_cache(t["events"].select((i % 61).alias("gate"), client.alias("client"), i.alias("request_id"), moment.alias("ts")), 900, 6, "gate")


@query(
    "q_rate_decisions",
    """WITH RECURSIVE n AS (SELECT user_id AS client, event_id AS request_id, event_id // 10 AS at_s, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 10, event_id) AS n FROM events),
r AS (SELECT client, request_id, at_s, n, at_s AS began, 1 AS nth FROM n WHERE n = 1
  UNION ALL SELECT n.client, n.request_id, n.at_s, n.n, CASE WHEN n.at_s - r.began >= 60 THEN n.at_s ELSE r.began END, CASE WHEN n.at_s - r.began >= 60 THEN 1 ELSE r.nth + 1 END FROM r JOIN n ON n.client = r.client AND n.n = r.n + 1)
SELECT client, request_id, CAST(began + epoch(TIMESTAMP '2024-01-01') AS DOUBLE) AS window_start_s, CAST(nth AS BIGINT) AS nth, nth > 2 AS refused, CASE WHEN nth > 2 THEN CAST(greatest(1, began + 60 - at_s) AS BIGINT) END AS retry_after_s FROM r""",
)
def _(t: Tables) -> DataFrame:
    moment = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(F.col("event_id") / 10))
    return scheduling.rate_decisions(t["events"].select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), moment.alias("ts")), 2)


@query(
    "q_stalls_watched",
    """WITH l AS (SELECT call_id, seq, ts, text_length, 0 AS silence FROM v_chunks WHERE kind <> 'keepalive' UNION ALL SELECT DISTINCT call_id, NULL, TIMESTAMP '2024-03-01', 0, 1 FROM v_chunks WHERE call_id % 2 = 0),
c AS (SELECT *, sum(text_length) OVER w AS sofar, min(ts) OVER w AS began FROM l WINDOW w AS (PARTITION BY call_id ORDER BY ts, silence, seq ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, lag(ts) OVER w AS before, coalesce(lag(sofar) OVER w > 0, false) AS had FROM c WINDOW w AS (PARTITION BY call_id ORDER BY ts, silence, seq)),
k AS (SELECT *, CASE WHEN had AND epoch_us(ts) - epoch_us(before) > 60000000 THEN 'idle' WHEN NOT had AND epoch_us(ts) - epoch_us(before) > 120000000 THEN 'first_output' WHEN epoch_us(ts) - epoch_us(began) > 900000000 THEN 'total' END AS stall FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ts, silence, seq) AS nth FROM k WHERE stall IS NOT NULL)
SELECT call_id, CAST(seq AS BIGINT) AS seq, stall AS kind FROM f WHERE nth = 1""",
    ("v_chunks",),
)
def _(t: Tables) -> DataFrame:
    chunks = t["v_chunks"]
    watched = chunks.where("call_id % 2 = 0").select("call_id").distinct().withColumn("ts", F.lit("2024-03-01").cast("timestamp_ntz"))
    return scheduling.stalls(chunks, watched)


@query(
    "q_sse_events",
    """WITH e AS (SELECT user_id AS call_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT call_id, min(n) AS stop FROM e WHERE event_id % 50 = 0 GROUP BY call_id)
SELECT e.call_id, CAST(3 * (n - 1) + 1 AS INT) AS pos, CAST(event_id AS VARCHAR) AS data FROM e LEFT JOIN s ON e.call_id = s.call_id WHERE stop IS NULL OR n < stop""",
)
def _(t: Tables) -> DataFrame:
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    said = F.concat(F.lit(": ping\ndata: "), F.when(i % 50 == 0, F.lit("[DONE]")).otherwise(n), F.lit("\n\n"))
    # Each message arrives in two reads, cut in the middle of a line.
    cut = F.array(F.struct((2 * i).alias("seq"), F.substring(said, 1, 10).alias("text")), F.struct((2 * i + 1).alias("seq"), F.substring(said, 11, 100).alias("text")))
    reads = t["events"].select(F.col("user_id").alias("call_id"), F.explode(cut).alias("r")).select("call_id", "r.*")
    return scheduling.sse_events(reads)


_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in scheduling.ALLOWED_MOVES)
_MOVES = "SELECT user_id AS session_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'ready_for_review' ELSE 'closed' END AS status FROM {events}"


@query(
    "q_illegal_moves",
    f"""WITH m AS ({_MOVES.replace('{events}', 'events')}), b AS (SELECT *, lag(status) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM m)
SELECT session_id, seq, before, status FROM b WHERE before IS NOT NULL AND (before, status) NOT IN (VALUES {_ALLOWED})""",
)
def _(t: Tables) -> DataFrame:
    return scheduling.illegal_moves(t.spark.sql(_MOVES, events=t["events"]))
