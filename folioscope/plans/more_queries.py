"""Queries over lookups, files, notes and small decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import limits, text, udfs, urls
from ..operators import dispatch, gates, links, review, store
from ..sources import readers
from .registry import Tables, query


@query("q_user_lookup", "SELECT * FROM v_users WHERE github_user_id = 7", ("v_users",))
def _(t: Tables) -> DataFrame:
    return store.get_user(t["v_users"], 7)


_FILES = "SELECT page_id, concat(lpad(cast(page_id AS varchar(9)), 4, '0'), '__', cast(page_id % 40 AS varchar(9)), '.png') AS file FROM {pages}"


@query(
    "q_fixture_inputs",
    f"""WITH f AS ({_FILES.replace('{pages}', 'pages')}), n AS (SELECT split_part(file, '__', 2) AS image_file, min(file) AS input_file FROM f GROUP BY 1)
SELECT doc_id, doc_id % 50 || '.png' AS image_file, input_file FROM documents LEFT JOIN n ON n.image_file = doc_id % 50 || '.png'""",
)
def _(t: Tables) -> DataFrame:
    wanted = t["documents"].select("doc_id", F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".png")).alias("image_file"))
    return gates.fixture_inputs(wanted, t.spark.sql(_FILES, pages=t["pages"])).select("doc_id", "image_file", "input_file")


@query("q_fixtures_kept", "SELECT case_id, agent, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY case_file DESC) AS rank FROM v_fixtures) WHERE rank <= 5", ("v_fixtures",))
def _(t: Tables) -> DataFrame:
    return gates.newest(t["v_fixtures"], gates.STORED_FIXTURES).select("case_id", "agent", "rank")


@query(
    "q_wrap_document",
    """SELECT item_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head><meta charset="utf-8"><title>T</title></head>' || chr(10) || '<body>' || chr(10) || text
  || CASE WHEN item_id % 2 = 0 THEN '' ELSE chr(10) || '<!-- unresolved: a — b -->' END || chr(10) || '</body>' || chr(10) || '</html>' AS page FROM benchmark""",
)
def _(t: Tables) -> DataFrame:
    notes = F.when(F.col("item_id") % 2 == 1, F.lit("a --- b"))
    return t["benchmark"].select("item_id", text.wrap_document(F.col("text"), F.lit("T"), notes).alias("page"))


@query(
    "q_unresolved_notes",
    "SELECT conv_id AS doc, string_agg('- **' || role || '** ' || length(text), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id",
)
def _(t: Tables) -> DataFrame:
    issues = t["conversations"].select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), F.col("role").alias("severity"), F.length("text").cast("string").alias("issue"))
    return review.unresolved_markdown(issues)


@query(
    "q_lint_summary",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'lint failed: boom' WHEN 1 THEN 'no violations' ELSE 'image-alt (critical): ' || page_id || chr(10) || 'label (?): 2' END AS summary FROM pages""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("page_id")
    v = lambda name, impact, n: F.struct(F.lit(name).alias("id"), F.lit(impact).cast("string").alias("impact"), n.alias("nodes"))
    some = F.array(v("image-alt", "critical", i), v("label", None, F.lit(2).cast("long")))
    found = F.when(i % 3 == 2, some).otherwise(F.slice(some, 1, 0))
    return t["pages"].select("page_id", review.lint_summary(F.when(i % 3 == 0, F.lit("boom")), found).alias("summary"))


@query(
    "q_lesson_block",
    """SELECT page_id, '1. one' || CASE WHEN page_id % 2 = 0 THEN chr(10) || '   was: b' || page_id || chr(10) || '   fix: c' ELSE '' END || chr(10) || '2. two' AS block FROM pages""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("page_id")
    one = lambda said, b, a: F.struct(F.lit(said).alias("instruction"), b.alias("before"), a.alias("after"))
    before = F.when(i % 2 == 0, F.concat(F.lit("b"), i.cast("string"))).otherwise(F.lit(""))
    return t["pages"].select("page_id", text.list_block(F.array(one("one", before, F.lit("c")), one("two", F.lit(None).cast("string"), F.lit("x")))).alias("block"))


@query(
    "q_repo_of",
    """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'o' || page_id END AS owner, CASE WHEN page_id % 3 < 2 THEN 'r' END AS repo FROM pages""",
)
def _(t: Tables) -> DataFrame:
    o = F.concat(F.lit("o"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://github.com/"), o, F.lit("/r.git"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("git@github.com:"), o, F.lit("/r"))).otherwise(F.col("url"))
    r = urls.repo_of(url)
    return t["pages"].select("page_id", r["owner"].alias("owner"), r["repo"].alias("repo"))


@query(
    "q_filing_hint",
    """SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) AND event_id % 5 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'install the app on the repository' WHEN 1 THEN 'give the token access to issues'
  ELSE 'sign in again and allow access to the repository' END END AS hint FROM events""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 403, 404, 500))), (i % 4 + 1).cast("int"))
    credential = F.element_at(F.array(*map(F.lit, ("app", "token", "login"))), (i % 3 + 1).cast("int"))
    return t["events"].select("event_id", dispatch.filing_hint(status, i % 5 == 0, credential).alias("hint"))


@query(
    "q_usage_pick",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, CAST(7 AS BIGINT) AS cache_read_input_tokens FROM events""",
)
def _(t: Tables) -> DataFrame:
    n = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.lit('"many"'))
    raw = F.concat(F.lit('{"input_tokens": '), n, F.lit(', "output_tokens": null, "cache_read_input_tokens": 7.0, "x": [1]}'))
    return t["events"].select("event_id", limits.usage_of(raw).alias("u")).select("event_id", "u.input_tokens", "u.output_tokens", "u.cache_read_input_tokens")


@query(
    "q_pages_with_links",
    """WITH l AS (SELECT page_id, page_id % 3 AS n FROM pages) SELECT page_id, CAST(n AS INT) AS n_links, CASE WHEN n > 0 THEN 'h' || (n - 1) END AS last_href FROM l""",
)
def _(t: Tables) -> DataFrame:
    n = (F.col("page_id") % 3).cast("int")
    rows = t["pages"].where(n > 0).select("page_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    held = rows.withColumns({"text": F.lit("t"), "href": F.concat(F.lit("h"), F.col("pos").cast("string"))})
    out = links.pages_with_links(t["pages"].select("page_id"), held, ("page_id",))
    return out.select("page_id", F.size("links").alias("n_links"), F.try_element_at("links", F.lit(-1))["href"].alias("last_href"))


@query(
    "q_image_sizes",
    """SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE 1 + page_id % 60000 END AS width, CASE page_id % 4 WHEN 3 THEN NULL ELSE 9 END AS height,
  CASE page_id % 4 WHEN 0 THEN 1 + page_id % 60000 END AS native_width FROM pages""",
)
def _(t: Tables) -> DataFrame:
    w = F.col("page_id") % 60000 + 1
    be = lambda c, n: F.lpad(F.hex(c), n, "0")
    le = F.concat(F.substring(be(w, 4), 3, 2), F.substring(be(w, 4), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 8), F.lit("00000009"))
    gif = F.concat(F.lit("474946383961"), le, F.lit("0900"))
    jpeg = F.concat(F.lit("FFD8FFE000046162FFC0000B080009"), be(w, 4), F.lit("01000000"))
    i = F.col("page_id") % 4
    content = F.unhex(F.when(i == 0, png).when(i == 1, gif).when(i == 2, jpeg).otherwise(F.substring(png, 1, 40)))
    found = t["pages"].select("page_id", udfs.image_dimensions(content).alias("s"), limits.png_size(content).alias("p"))
    return found.select("page_id", "s.width", F.col("s.height").cast("int").alias("height"), F.col("p.width").alias("native_width"))


@query("q_failed_checks", "SELECT event_id, event_type = 'error' AND event_id % 3 > 0 AS failed FROM events")
def _(t: Tables) -> DataFrame:
    problems = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("event_id") % 3).cast("int"))
    return t["events"].select("event_id", gates.failed_check(F.col("event_type") != "error", problems).alias("failed"))


@query(
    "q_prompt_pick",
    """SELECT name, CAST(min(priority) AS INT) AS priority, CASE WHEN min(priority) = 0 THEN ['vision', 'audio'] ELSE ['vision'] END AS capabilities
FROM (SELECT 'agent' || user_id AS name, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS priority FROM events) GROUP BY name""",
)
def _(t: Tables) -> DataFrame:
    own = F.col("event_type") == "view"
    prompt = F.when(own, F.lit("# A\n## Required capability\nvision, audio\n## Next\nx")).otherwise(F.lit("# A"))
    files = t["events"].select(F.concat(F.lit("agent"), F.col("user_id").cast("string")).alias("name"), F.when(own, 0).otherwise(1).alias("priority"), prompt.alias("text"))
    return dispatch.pick_agents(files).select("name", "priority", "capabilities")


@query(
    "q_links_file",
    """SELECT CAST(page_id AS VARCHAR) AS session, CAST(3 AS INT) AS page, CAST(p AS INT) AS pos, 't' AS text, 'h' || p AS href FROM pages, (SELECT unnest([0, 1]) AS p) WHERE page_id % 3 = 0""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("page_id") % 3
    raw = F.when(i == 0, F.lit('{"3": [{"text": "t", "href": "h0"}, {"text": "t", "href": "h1"}], "4": []}')).when(i == 1, F.lit("[not json"))
    return readers.page_links(t["pages"].select(F.col("page_id").cast("string").alias("session"), raw.alias("value")))


@query(
    "q_refusal_cause",
    """WITH e AS (SELECT event_id, [200, 403, 404, 500][event_id % 4 + 1] AS status, CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '12' END AS remaining,
  CASE event_id % 7 WHEN 0 THEN 'API Rate Limit exceeded' WHEN 1 THEN 'abuse detected' WHEN 2 THEN 'a secondary limit' WHEN 3 THEN 'not accessible' END AS message,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS service FROM events)
SELECT event_id, CASE WHEN coalesce(remaining, '') = '0' OR event_id % 7 < 3 THEN NULL
  WHEN service IS TRUE AND status = 403 THEN 'service token: scopes' WHEN service IS TRUE AND status = 404 THEN 'service token: access or repository name'
  WHEN status = 403 THEN 'app: right to write issues' WHEN status = 404 THEN 'app not installed, repository name or user''s access' END AS cause FROM e""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 403, 404, 500))), (i % 4 + 1).cast("int"))
    remaining = F.when(i % 5 == 0, F.lit("0")).when(i % 5 == 1, F.lit("12"))
    said = ("API Rate Limit exceeded", "abuse detected", "a secondary limit", "not accessible")
    message = F.get(F.array(*map(F.lit, said)), (i % 7).cast("int"))
    service = F.when(i % 3 == 0, F.lit(True)).when(i % 3 == 1, F.lit(False))
    return t["events"].select("event_id", dispatch.refusal_cause(status, remaining, message, service).alias("cause"))
