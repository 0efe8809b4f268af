"""Queries over pages: text, links, announcements, anchors, review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, udfs, urls
from ..operators import anchors, links, review
from .registry import Tables, query

# --- chunks, indexes, page numbers -------------------------------------------------------------------------------


@query(
    "q_chunks",
    """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), s AS (
SELECT doc_id, text, n, unnest(CASE WHEN n <= 24000 THEN [0] ELSE range(0, n, 22000) END) AS pos FROM d)
SELECT doc_id, CAST(pos // 22000 AS INT) AS chunk, CASE WHEN n <= 24000 THEN text ELSE substring(text, pos + 1, 24000) END AS piece FROM s""",
)
def _(t: Tables) -> DataFrame:
    d = t["documents"].where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("chunk", "piece"))


@query(
    "q_page_index",
    r"""SELECT doc, string_agg('### Page ' || ord || chr(10) || substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 400), chr(10) || chr(10) ORDER BY ord) AS page_index
FROM v_text_pages GROUP BY doc""",
    ("v_text_pages",),
)
def _(t: Tables) -> DataFrame:
    return review.page_index(t["v_text_pages"])




def claims(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    said = F.array(
        (n % 7).cast("string"),
        F.when(n % 3 == 0, F.lit("x")).when(n % 3 == 1, F.lit("3.0")).otherwise((n % 4).cast("string")),
        F.when(n % 5 == 0, F.lit("")).otherwise((n % 2 + 0.5).cast("string")),
        F.lit("2"),
    )
    return t["documents"].select(F.floor(F.col("doc_id") / 5).alias("doc"), F.col("doc_id").alias("item"), said.alias("claimed"), "n_chars")


def text_pages(t: Tables) -> DataFrame:
    return t["documents"].select(F.floor(F.col("doc_id") / 5).alias("doc"), (F.col("doc_id") % 5 + 1).cast("int").alias("ord"))


_KNOWN = """
WITH c AS (SELECT doc_id AS item, CAST(floor(doc_id / 5) AS BIGINT) AS doc, n_chars AS n FROM documents),
e AS (SELECT item, doc, n % 7 AS ord FROM c UNION ALL SELECT item, doc, CASE n % 3 WHEN 1 THEN 3 ELSE n % 4 END FROM c WHERE n % 3 <> 0
      UNION ALL SELECT item, doc, 0 FROM c WHERE n % 5 = 0 UNION ALL SELECT item, doc, 2 FROM c),
p AS (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS doc, doc_id % 5 + 1 AS ord FROM documents),
k AS (SELECT doc, item, list_sort(list(DISTINCT CAST(ord AS INT))) AS pages FROM e SEMI JOIN p USING (doc, ord) GROUP BY doc, item)"""


@query("q_known_pages", _KNOWN + " SELECT doc, item, coalesce(pages, CAST([] AS INT[])) AS pages FROM c LEFT JOIN k USING (doc, item)")
def _(t: Tables) -> DataFrame:
    return review.known_pages(claims(t).drop("n_chars"), text_pages(t))


@query(
    "q_images_for_issues",
    """
WITH i AS (SELECT doc_id AS item, CAST(floor(doc_id / 5) AS BIGINT) AS doc, CAST(n_chars % 2 AS INT) AS round, CASE n_chars % 6 WHEN 0 THEN 0 WHEN 1 THEN 9 ELSE n_chars % 6 END AS p FROM documents),
r AS (SELECT doc, round, bool_or(p = 0) AS any_open FROM i GROUP BY doc, round),
g AS (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS doc, CAST(doc_id % 5 + 1 AS INT) AS ord FROM documents),
m AS (SELECT r.doc, r.round, any_open, g.ord, EXISTS (SELECT 1 FROM i WHERE i.doc = r.doc AND i.round = r.round AND i.p = g.ord) AS hit FROM r JOIN g ON r.doc = g.doc)
SELECT doc, round, ord FROM (SELECT *, bool_or(hit) OVER (PARTITION BY doc, round) AS any_hit FROM m) WHERE any_open OR NOT any_hit OR hit""",
)
def _(t: Tables) -> DataFrame:
    p = F.col("n_chars") % 6
    one = F.when(p == 0, F.array().cast("array<int>")).when(p == 1, F.array(F.lit(9))).otherwise(F.array(p.cast("int")))
    issues = t["documents"].select(F.floor(F.col("doc_id") / 5).alias("doc"), (F.col("n_chars") % 2).cast("int").alias("round"), F.col("doc_id").alias("item"), one.alias("pages"))
    return review.images_for_issues(issues, text_pages(t))


@query(
    "q_reextract_merge",
    "SELECT doc, ord, CASE WHEN doc % 2 = 0 AND ord <> 3 THEN '<p>again</p>' ELSE inner_html END AS inner_html FROM v_fragments",
    ("v_fragments",),
)
def _(t: Tables) -> DataFrame:
    prior = t["v_fragments"]
    fresh = prior.where("doc % 2 = 0 AND ord <> 3").select("doc", "ord", F.lit("<p>again</p>").alias("inner_html"))
    return review.replace_fragments(prior, fresh).select("doc", "ord", "inner_html")


@query(
    "q_reextract_missing",
    """WITH g AS (SELECT DISTINCT doc, ord + 1 AS ord FROM v_fragments)
SELECT doc, ord, EXISTS (SELECT 1 FROM v_fragments f WHERE f.doc = g.doc AND f.ord = g.ord AND f.ord % 2 = 0) AS runs FROM g""",
    ("v_fragments",),
)
def _(t: Tables) -> DataFrame:
    f = t["v_fragments"].select("doc", "ord")
    return review.reextraction(f.select("doc", (F.col("ord") + 1).alias("ord")), f, f.where("ord % 2 = 0"))


@query(
    "q_scope_decision",
    _KNOWN + """
SELECT doc, item, CASE WHEN n % 4 <> 0 AND len(coalesce(pages, [])) > 0 AND len(pages) <= greatest(1, floor(5 * 0.5)) THEN 'extraction' ELSE 'document' END AS scope
FROM c LEFT JOIN k USING (doc, item)""",
)
def _(t: Tables) -> DataFrame:
    said = claims(t)
    known = review.known_pages(said.drop("n_chars"), text_pages(t)).join(said.select("doc", "item", "n_chars"), ["doc", "item"])
    target = F.when(F.col("n_chars") % 4 != 0, F.lit("extraction")).otherwise(F.lit("other"))
    return known.select("doc", "item", review.feedback_scope(target, F.size("pages"), F.lit(5)).alias("scope"))


@query(
    "q_review_outcome",
    """WITH r AS (SELECT conv_id AS doc, turn AS round, length(text) % 3 AS issues FROM conversations),
t AS (SELECT doc, min(round) FILTER (issues = 0) AS clean, sum(issues) FILTER (round = 3) AS at_cap FROM r GROUP BY doc)
SELECT doc, CASE WHEN clean <= 3 THEN clean ELSE 3 END AS iterations, CAST(CASE WHEN clean <= 3 THEN 0 ELSE coalesce(at_cap, 0) END AS BIGINT) AS unresolved FROM t""",
)
def _(t: Tables) -> DataFrame:
    rounds = t["conversations"].select(F.col("conv_id").alias("doc"), F.col("turn").alias("round"), (F.length("text") % 3).alias("issues"))
    return review.review_outcome(rounds, 3)


@query(
    "q_diff_preview",
    """WITH p AS (SELECT a.page_id, string_split(replace(a.html, '><', '>' || chr(10) || '<'), chr(10)) AS a, string_split(replace(b.html, '><', '>' || chr(10) || '<'), chr(10)) AS b
  FROM pages a JOIN pages b ON b.page_id = a.page_id + 1),
l AS (SELECT page_id, list_concat(list_transform(list_filter(a, lambda x: NOT list_contains(b, x)), lambda x: '- ' || x), list_transform(list_filter(b, lambda x: NOT list_contains(a, x)), lambda x: '+ ' || x)) AS l FROM p)
SELECT page_id, array_to_string(CASE WHEN len(l) > 80 THEN list_append(l[1:80], '… (' || (len(l) - 80) || ' more changed lines)') ELSE l END, chr(10)) AS preview FROM l""",
)
def _(t: Tables) -> DataFrame:
    lines = F.replace(F.col("html"), F.lit("><"), F.lit(">\n<"))
    a = t["pages"].select("page_id", lines.alias("a"))
    b = t["pages"].select((F.col("page_id") - 1).alias("page_id"), lines.alias("b"))
    return a.join(b, "page_id").select("page_id", text.diff_preview(F.col("a"), F.col("b")).alias("preview"))


@query(
    "q_page_inputs",
    r"""WITH f AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'plain.png' ELSE lpad(CAST(page_id % 25 AS VARCHAR), 4, '0') || '__a__' || page_id || '.png' END AS file FROM pages)
SELECT page_id, CAST(regexp_extract(file, '^([0-9]+)__', 1) AS INT) AS "order", regexp_replace(file, '^[0-9]+__', '') AS name FROM f WHERE contains(file, '__')""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("page_id")
    file = F.when(i % 6 == 0, F.lit("plain.png")).otherwise(F.concat(F.lpad((i % 25).cast("string"), 4, "0"), F.lit("__a__"), i.cast("string"), F.lit(".png")))
    return review.page_inputs(t["pages"].select("page_id", file.alias("file"))).select("page_id", "order", "name")


# --- links -------------------------------------------------------------------------------------------------------

_HREFS = r"""h AS (SELECT page_id, html, regexp_extract_all(html, '\bhref\s*=\s*"([^"]*)"', 1, 'i') AS raw FROM {src}),
n AS (SELECT page_id, html, list_transform(raw, lambda r: regexp_replace(trim(replace(r, '&amp;', '&')), '/+$', '')) AS hrefs FROM h)"""
_SITE = "SELECT page_id, replace(html, 'href=\"/', 'href=\"HTTPS://Site.example/') AS html FROM pages"


def site(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.replace(F.col("html"), F.lit('href="/'), F.lit('href="HTTPS://Site.example/')).alias("html"))


def annotated(t: Tables) -> DataFrame:
    """Links of a page: those of the page before it, with positions."""
    own = site(t).select((F.col("page_id") + 1).alias("page_id"), F.posexplode(urls.raw_hrefs(F.col("html"))).alias("pos", "href"))
    return own.withColumn("text", F.concat(F.lit("t"), F.col("pos").cast("string")))


_NORM = "regexp_replace('https:' || substr(href, 7), '/+$', '')"
_LINKS = r"""s AS (SELECT page_id, replace(html, 'href="/', 'href="HTTPS://Site.example/') AS html FROM pages),
a AS (SELECT page_id, regexp_extract_all(html, '\bhref\s*=\s*"([^"]*)"', 1, 'i') AS raw FROM s),
l AS (SELECT page_id + 1 AS page_id, CAST(pos - 1 AS INT) AS pos, href FROM (SELECT page_id, unnest(raw) AS href, generate_subscripts(raw, 1) AS pos FROM a)),
o AS (SELECT DISTINCT page_id, """ + _NORM + """ AS norm FROM (SELECT page_id, unnest(raw) AS href FROM a))"""


@query("q_hrefs", "WITH " + _HREFS.replace("{src}", "pages") + " SELECT page_id, list_sort(list_distinct(hrefs)) AS hrefs FROM n")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", F.sort_array(urls.hrefs(F.col("html"))).alias("hrefs"))


@query(
    "q_missing_links",
    "WITH " + _LINKS + ", k AS (SELECT *, " + _NORM + """ AS norm FROM l WHERE pos < 40)
SELECT page_id, pos, 't' || pos AS text, href FROM (SELECT k.*, row_number() OVER (PARTITION BY page_id, norm ORDER BY pos) AS r FROM k
  WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = k.page_id AND o.norm = k.norm)) WHERE r = 1""",
)
def _(t: Tables) -> DataFrame:
    return links.missing_links(annotated(t), site(t), ("page_id",)).select("page_id", "pos", "text", "href")


@query(
    "q_dropped_links",
    "WITH " + _LINKS + """, b AS (SELECT page_id, list_sort(list(norm)) AS dropped FROM (SELECT o.page_id, o.norm FROM o WHERE EXISTS (SELECT 1 FROM pages p WHERE p.page_id = o.page_id + 1)
  AND NOT EXISTS (SELECT 1 FROM o x WHERE x.page_id = o.page_id + 1 AND x.norm = o.norm)) GROUP BY page_id) SELECT page_id, dropped FROM b""",
)
def _(t: Tables) -> DataFrame:
    after = site(t).select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("after"))
    return links.dropped_links(site(t).withColumnRenamed("html", "before").join(after, "page_id"))


@query(
    "q_unexpected_links",
    "WITH " + _LINKS + """ SELECT page_id, norm FROM o WHERE page_id IN (SELECT page_id FROM l)
AND NOT EXISTS (SELECT 1 FROM l WHERE l.page_id = o.page_id AND regexp_replace('https:' || substr(href, 7), '/+$', '') = o.norm)""",
)
def _(t: Tables) -> DataFrame:
    return links.unexpected_links(annotated(t), site(t), ("page_id",))


@query("q_link_cap", "WITH " + _LINKS + " SELECT page_id, least(count(*), 40) AS shown, greatest(count(*) - 40, 0) AS dropped FROM l GROUP BY page_id")
def _(t: Tables) -> DataFrame:
    return links.link_counts(annotated(t), ("page_id",))


@query(
    "q_review_links_dropped",
    "WITH " + _LINKS + """, r AS (SELECT page_id, CAST(floor(page_id / 5) AS BIGINT) AS doc FROM pages),
d AS (SELECT r.doc, o.page_id FROM o JOIN r USING (page_id) WHERE EXISTS (SELECT 1 FROM r x WHERE x.doc = r.doc AND x.page_id = o.page_id + 1)
  AND NOT EXISTS (SELECT 1 FROM o y WHERE y.page_id = o.page_id + 1 AND y.norm = o.norm))
SELECT doc, CAST(count(d.page_id) AS BIGINT) AS links_dropped FROM (SELECT DISTINCT doc FROM r) LEFT JOIN d USING (doc) GROUP BY doc""",
)
def _(t: Tables) -> DataFrame:
    rounds = site(t).select(F.floor(F.col("page_id") / 5).alias("doc"), F.col("page_id").alias("round"), "html")
    return links.review_links_dropped(rounds)


_XML = """SELECT page_id AS doc, concat('<outline>x</outline><a href="http://before.example/">early</a>', '<page number="1" top="0"><text><a href="', replace(url, '&', '&amp;'), '">Part one-</a></text><text><a href="',
  replace(url, '&', '&amp;'), '"><b>two</b></a></text>', '<a href="javascript:alert(1)">no</a><a href="http://q.example/&quot;x">quote</a></page><page number="', cast(2 + page_id % 3 AS varchar(5)), '"><a href="mailto:a@b.example">mail  to</a><a href="',
  replace(url, '&', '&amp;'), '">again</a></page>') AS xml, url, page_id FROM {pages}"""


@query(
    "q_pdf_links",
    """SELECT page_id AS doc, 1 AS page, 0 AS pos, 'Part one-two' AS text, url AS href FROM pages
UNION ALL SELECT page_id, CAST(2 + page_id % 3 AS INT), 0, 'mail to', 'mailto:a@b.example' FROM pages UNION ALL SELECT page_id, CAST(2 + page_id % 3 AS INT), 1, 'again', url FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return links.pdf_links(t.spark.sql(_XML, pages=t["pages"]))


@query(
    "q_link_runs",
    """WITH e AS (SELECT user_id AS doc, event_id AS eid, 'http://h.example/' || event_type AS href, CASE event_id % 3 WHEN 0 THEN 'a-' WHEN 1 THEN ' b' ELSE 'c' END AS text FROM events),
c AS (SELECT *, CASE WHEN lag(href) OVER w = href THEN 0 ELSE 1 END AS changed FROM e WINDOW w AS (PARTITION BY doc ORDER BY eid)),
i AS (SELECT *, sum(changed) OVER (PARTITION BY doc ORDER BY eid) - 1 AS pos FROM c),
s AS (SELECT *, lag(text) OVER (PARTITION BY doc, pos ORDER BY eid) AS prev FROM i),
p AS (SELECT *, CASE WHEN prev IS NULL OR prev LIKE '%-' OR text LIKE ' %' THEN '' ELSE ' ' END || text AS part FROM s),
j AS (SELECT doc, CAST(pos AS INT) AS pos, href, trim(regexp_replace(string_agg(part, '' ORDER BY eid), '\\s+', ' ', 'g')) AS text FROM p GROUP BY doc, pos, href)
SELECT doc, 1 AS page, pos, CASE WHEN length(text) > 160 THEN substring(text, 1, 160) || '…' ELSE text END AS text, href FROM j""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("event_id") % 3
    rows = t["events"].select(
        F.col("user_id").alias("doc"), F.lit(1).alias("page"), F.col("event_id").alias("at"), F.concat(F.lit("http://h.example/"), F.col("event_type")).alias("href"),
        F.when(n == 0, F.lit("a-")).when(n == 1, F.lit(" b")).otherwise(F.lit("c")).alias("text"),
    )
    return links.merge_runs(rows)


# --- trees -------------------------------------------------------------------------------------------------------


@query("q_flatten")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", udfs.flatten_html(F.col("html")).alias("announced"))


@query(
    "q_flatten_fragments",
    """SELECT page_id, concat_ws(chr(10), '[Heading 2] T' || page_id, '[List item] one', '[List item] inner ' || page_id, '[Link] [Image alt] Logo go', '[Table] Fees [2 rows, 3 columns]', '[Header row] a | b [spans 2 columns]',
  '[Row] ' || page_id || ' | [empty] | z', '[Field input email] Work v', '[Quote] said & done', 'tail') AS announced FROM pages""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<h2>T"), i, F.lit("</h2><ul><li>one<ul><li> inner "), i, F.lit('</ul></ul><p><a href="/x"><img alt="Logo"> go</a></p><table><caption>Fees</caption><tr><th>a<th colspan=2>b<tr><td>'), i,
        F.lit('<td></td><td>z</table><input type="email" aria-label="Work" value="v"><blockquote><p>said &amp;\n done</p></blockquote><style>no</style>tail'),
    )
    return t["pages"].select("page_id", udfs.flatten_html(html).alias("announced"))


@query(
    "q_lint_subset",
    """SELECT page_id, 'image-alt' AS id, 'critical' AS impact, CAST(1 AS BIGINT) AS nodes FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'heading-order', 'moderate', 1 FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'label', 'critical', 2 FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'link-name', 'serious', 1 FROM pages WHERE page_id % 7 = 0
UNION ALL SELECT page_id, 'duplicate-id', 'minor', 1 FROM pages WHERE page_id % 11 = 0 UNION ALL SELECT page_id, 'table-header', 'serious', 1 FROM pages WHERE page_id % 13 = 0""",
)
def _(t: Tables) -> DataFrame:
    i = F.col("page_id")
    flaw = lambda n, html: F.when(i % n == 0, F.lit(html)).otherwise(F.lit(""))
    extra = [
        flaw(2, '<img src="a.png"><img alt="" src="b.png">'),
        flaw(3, "<h4>deep</h4>"),
        flaw(5, '<input name="q"><select></select><label>ok <input></label>'),
        flaw(7, '<a href="/z"></a>'),
        flaw(11, '<p id="d">a</p><p id="d">b</p>'),
        flaw(13, "<table><tr><td>1</td></tr></table>"),
    ]
    found = t["pages"].select("page_id", F.explode(udfs.lint_html(F.concat("html", *extra))).alias("v"))
    return found.select("page_id", "v.*")


@query(
    "q_json_from_text",
    """SELECT event_id, '{"a": ' || event_id || ', "s": "}"}' AS found FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2""",
)
def _(t: Tables) -> DataFrame:
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    body = F.concat(F.lit('{"s": "}", "a": '), n, F.lit("}"))
    said = F.when(i % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nthanks {x"))).when(i % 3 == 1, F.concat(F.lit("I think "), body, F.lit(" is it."))).otherwise(F.lit("none {at all"))
    return t["events"].select("event_id", udfs.json_in_text(said).alias("found"))


_ENTITIES = "CASE event_id % 6 WHEN 0 THEN concat('a &amp;lt; ', event_type) WHEN 1 THEN '&#38;amp;' WHEN 2 THEN '&#x41;&#233;&LT;' WHEN 3 THEN '&constructor; &#0; &#1114112;' WHEN 4 THEN '&quot;&apos;&' ELSE event_type END"


@query(
    "q_entities",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('a &lt; ', event_type) WHEN 1 THEN '&amp;' WHEN 2 THEN 'Aé<' WHEN 3 THEN '&constructor; &#0; &#1114112;' WHEN 4 THEN '"''&' ELSE event_type END AS decoded,
  true AS same FROM events""",
)
def _(t: Tables) -> DataFrame:
    raw = t["events"].select("event_id", F.expr(_ENTITIES).alias("raw"))
    native = urls.decode_entities(F.col("raw"))
    return raw.select("event_id", native.alias("decoded"), (native == udfs.decode_html_entities(F.col("raw"))).alias("same"))


# --- anchors -----------------------------------------------------------------------------------------------------

_PAGES = "SELECT cast(floor(doc_id / 5.0) AS bigint) AS doc, cast(doc_id % 5 AS int) AS page_idx, cast(doc_id % 5 - doc_id % 2 + 1 AS int) AS ord, n_chars AS n FROM {documents}"
_IDS = """SELECT doc, page_idx, concat('fn-', cast(n % 4 AS varchar(5))) AS token FROM {p} UNION ALL SELECT doc, page_idx, concat('q', cast(n % 9 AS varchar(5))) FROM {p}
UNION ALL SELECT doc, page_idx, concat('p', cast(ord AS varchar(5)), '-x') FROM {p} WHERE n % 11 = 0 UNION ALL SELECT doc, page_idx, 'p3--z' FROM {p} WHERE n % 97 = 0"""
_REFS = """SELECT doc, page_idx, 'href' AS attr, concat('fn-', cast((n + 1) % 4 AS varchar(5))) AS token FROM {p} UNION ALL SELECT doc, page_idx, 'for', concat('q', cast((n + 2) % 9 AS varchar(5))) FROM {p}
UNION ALL SELECT doc, page_idx, 'href', 'nowhere' FROM {p}"""


def anchor_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = t.spark.sql(_PAGES, documents=t["documents"])
    return p, t.spark.sql(_IDS, p=p), t.spark.sql(_REFS, p=p)


_ANCHORS = (
    "p AS (" + _PAGES.replace("{documents}", "documents") + "), ids AS (" + _IDS.replace("{p}", "p") + "), refs AS (" + _REFS.replace("{p}", "p") + """),
coll AS (SELECT doc, token, count(DISTINCT page_idx) AS n_pages, min(page_idx) AS first_owner FROM ids GROUP BY doc, token HAVING count(DISTINCT page_idx) > 1),
lab AS (SELECT doc, page_idx, 'p' || ord || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY doc, ord ORDER BY page_idx) AS r FROM p)),
seps AS (SELECT doc, min(sep) AS sep FROM (SELECT doc, sep FROM (SELECT DISTINCT doc FROM p), (SELECT unnest(['-', '--', '---', '----']) AS sep)) d
  WHERE NOT EXISTS (SELECT 1 FROM ids JOIN lab ON ids.doc = lab.doc WHERE ids.doc = d.doc AND starts_with(ids.token, lab.label || d.sep)) GROUP BY doc)"""
)


@query("q_id_owners", "WITH " + _ANCHORS + " SELECT doc, token, list_sort(list(DISTINCT page_idx)) AS owners, min(page_idx) AS first_owner FROM ids GROUP BY doc, token")
def _(t: Tables) -> DataFrame:
    return anchors.id_owners(anchor_tables(t)[1])


@query("q_collisions", "WITH " + _ANCHORS + " SELECT * FROM coll")
def _(t: Tables) -> DataFrame:
    return anchors.collisions(anchor_tables(t)[1])


@query("q_prefix", "WITH " + _ANCHORS + " SELECT lab.doc, page_idx, label, sep FROM lab JOIN seps ON lab.doc = seps.doc")
def _(t: Tables) -> DataFrame:
    p, ids, _ = anchor_tables(t)
    return anchors.labels(p).join(anchors.separators(p, ids), "doc").select("doc", "page_idx", "label", "sep")


@query(
    "q_ref_repoint",
    "WITH " + _ANCHORS + """, r AS (SELECT DISTINCT doc, page_idx, token FROM refs),
o AS (SELECT r.doc, r.page_idx, r.token, CASE WHEN c.token IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM ids i WHERE i.doc = r.doc AND i.page_idx = r.page_idx AND i.token = r.token) THEN r.page_idx ELSE c.first_owner END AS owner
  FROM r LEFT JOIN coll c ON c.doc = r.doc AND c.token = r.token)
SELECT o.doc, o.page_idx, o.token, coalesce(lab.label || seps.sep || o.token, o.token) AS new_token FROM o LEFT JOIN lab ON lab.doc = o.doc AND lab.page_idx = o.owner LEFT JOIN seps ON seps.doc = o.doc""",
)
def _(t: Tables) -> DataFrame:
    return anchors.repoint(*anchor_tables(t))


@query(
    "q_id_renames",
    "WITH " + _ANCHORS + """, i AS (SELECT DISTINCT doc, page_idx, token FROM ids)
SELECT i.doc, i.page_idx, i.token, CASE WHEN c.token IS NULL THEN i.token ELSE lab.label || seps.sep || i.token END AS new_token
FROM i LEFT JOIN coll c ON c.doc = i.doc AND c.token = i.token JOIN lab ON lab.doc = i.doc AND lab.page_idx = i.page_idx JOIN seps ON seps.doc = i.doc""",
)
def _(t: Tables) -> DataFrame:
    p, ids, _ = anchor_tables(t)
    return anchors.renames(p, ids)


@query(
    "q_ambiguous_refs",
    "WITH " + _ANCHORS + """ SELECT DISTINCT r.doc, r.page_idx, r.token FROM refs r JOIN coll c ON c.doc = r.doc AND c.token = r.token
WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.doc = r.doc AND i.page_idx = r.page_idx AND i.token = r.token)""",
)
def _(t: Tables) -> DataFrame:
    _, ids, refs = anchor_tables(t)
    return anchors.ambiguous_references(ids, refs)


@query(
    "q_assemble",
    "WITH " + _ANCHORS + """, m AS (SELECT p.doc, p.page_idx, p.ord, 'fn-' || n % 4 AS own, 'fn-' || (n + 1) % 4 AS ref FROM p),
mid AS (SELECT doc, own AS token, min(rk) AS first_rk, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord, page_idx) AS rk FROM m) GROUP BY doc, own),
k AS (SELECT m.*, row_number() OVER (PARTITION BY doc ORDER BY ord, page_idx) AS rk, row_number() OVER (PARTITION BY doc, ord ORDER BY page_idx) AS nth FROM m),
l AS (SELECT *, 'p' || ord || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END || '-' AS prefix FROM k),
w AS (SELECT l.*, CASE WHEN a.c > 1 THEN l.prefix ELSE '' END || l.own AS new_own, CASE WHEN b.c > 1 THEN f.prefix ELSE '' END || l.ref AS new_ref
  FROM l LEFT JOIN mid a ON a.doc = l.doc AND a.token = l.own LEFT JOIN mid b ON b.doc = l.doc AND b.token = l.ref LEFT JOIN l f ON f.doc = l.doc AND f.rk = b.first_rk)
SELECT doc, string_agg('<p id="' || new_own || '">note</p><a href="#' || new_ref || '">see</a>', chr(10) || chr(10) ORDER BY rk) AS body FROM w GROUP BY doc""",
)
def _(t: Tables) -> DataFrame:
    p = t.spark.sql(_PAGES, documents=t["documents"])
    n = F.col("n")
    html = F.concat(F.lit(' <p id="fn-'), (n % 4).cast("string"), F.lit('">note</p><a href="#fn-'), ((n + 1) % 4).cast("string"), F.lit('">see</a>\n'))
    return anchors.assemble(p.withColumn("inner_html", html)).select("doc", "body")


@query(
    "q_assemble_native",
    "SELECT doc, string_agg(trim(inner_html), chr(10) || chr(10) ORDER BY ord) AS body FROM v_fragments WHERE trim(inner_html) <> '' GROUP BY doc",
    ("v_fragments",),
)
def _(t: Tables) -> DataFrame:
    return anchors.assemble_native(t["v_fragments"])
