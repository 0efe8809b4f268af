"""Operators on small tables of edge rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import anchors, dispatch, gates, lessons, links, review, runlog, scheduling, store
from folioscope.schemas import LegacySchemaError, refuse_legacy_users
from folioscope.sources import readers, writers

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("y")).first().y


# --- store


def test_window_and_limit(spark):
    window = lambda v: one(spark, store.clamp_window(F.lit(v).cast("string")))
    assert [window(v) for v in (None, "", "x", "0", "-5", "1", "30", "365", "1000", "7.9", "NaN")] == [30, 30, 30, 30, 1, 1, 30, 365, 365, 7, 30]
    limit = lambda v: one(spark, store.clamp_limit(F.lit(v).cast("string")))
    assert [limit(v) for v in ("0", "-1", "abc", "1.9", "101", None, "12abc", " 7", "9" * 60)] == [20, 20, 20, 1, 100, 20, 12, 7, 20]


CURSORS = {
    "2024-03-05T06:07:08.009Z|a|b": ("2024-03-05T06:07:08.009Z", "a|b"), "2024-03-05T06:07:08.009Z": ("2024-03-05T06:07:08.009Z", ""), "2024-03-05T06:07:08Z|a": None, "2024-03-05T06:07:08.009+00:00|a": None,
    "9999": None, "text|x": None, "2024-02-30T00:00:00.000Z|a": None, "": None,
}


@pytest.mark.parametrize("text", CURSORS)
def test_cursor(spark, text):
    got = one(spark, store.parse_cursor(F.lit(text)))
    assert (tuple(got) if got else None) == CURSORS[text]


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 50])
def test_walk_meets_each_session_once(spark, limit):
    rnd = random.Random(limit)
    data = [(f"s|{i:03}", rnd.choice([1, 2]), "queued", f"2024-01-01T00:00:0{rnd.randrange(4)}.000Z", 1, None) for i in range(20)]
    df = spark.createDataFrame(data, "session_id string, github_user_id long, status string, created_at string, image_count long, first_completed_at string")
    seen, cursor = [], None
    while True:
        page = store.list_sessions(df, 1, limit + 1, cursor=cursor).collect()
        seen += [r.session_id for r in page[:limit]]
        if len(page) <= limit:
            break
        cursor = (page[limit - 1].created_at, page[limit - 1].session_id)
    mine = sorted((r for r in data if r[1] == 1), key=lambda r: (r[3], r[0]), reverse=True)
    assert seen == [r[0] for r in mine]
    numbered = store.page_numbers(df, limit).where("github_user_id = 1").orderBy("row").collect()
    assert [r.session_id for r in numbered] == seen and [r.page_no for r in numbered] == [i // limit for i in range(len(seen))]
    assert not numbered[-1].has_more and (len(seen) <= limit or numbered[0].has_more)


SIGNALS = "session_id string, code string, impact string, count long, recorded_at timestamp_ntz"


def signals(spark, data):
    return spark.createDataFrame([(s, c, i, n, at(86_400 * day)) for s, c, i, n, day in data], SIGNALS)


def test_quality(spark):
    now = F.lit(at(86_400 * 40)).cast("timestamp_ntz")
    empty = signals(spark, [])
    assert tuple(store.quality_rates(empty, now).first()) == (0, None, 0.0, 0.0, 0.0, None)
    assert store.quality_rules(empty, now).count() == 0 and store.public_quality(empty, now).count() == 0
    data = [("a", "sys:rounds", None, 0, 39), ("b", "sys:rounds", None, 3, 38), ("b", "sys:unresolved", None, 2, 38), ("b", "rule", "minor", 40, 38), ("a", "rule", "critical", 1, 39), ("a", "rounds", None, 5, 39),
            ("c", "sys:lint-error", None, 1, 39), ("old", "sys:rounds", None, 9, 5), ("a", "late", None, 1, 40), ("edge", "other", None, 1, 10)]
    df = signals(spark, data)
    r = store.quality_rates(df, now).first()
    assert (r.documents, r.mean_rounds, r.unresolved_rate, r.lint_error_rate, r.since) == (2, 1.5, 0.5, 0.5, at(86_400 * 38))
    assert [tuple(x) for x in store.quality_rules(df, now).collect()] == [("rule", "minor", 2, 41, 1.0), ("rounds", None, 1, 5, 0.5), ("late", None, 1, 1, 0.5), ("other", None, 1, 1, 0.5)]
    for n, shown in ((19, 0), (20, 1)):
        many = signals(spark, [(f"s{i}", "sys:rounds", None, 1, 39) for i in range(n)] + [(f"s{i}", "sys:unresolved", None, 1, 39) for i in range(n)])
        found = store.public_quality(many, now).collect()
        assert len(found) == shown and (not found or (found[0].clean_rate, found[0].mean_rounds) == (0.0, 1.0))


def test_merge_and_replace(spark):
    data = [("a", 1, 1, "x", "minor", 2.9), ("a", 1, 2, "x", None, -4.0), ("a", 1, 3, "x", "serious", float("nan")), ("a", 1, 4, "", None, 1.0), ("a", 1, 5, "y", None, float("inf")), ("a", 2, 1, "y", None, 1.0), ("b", 1, 1, "x", None, None)]
    df = spark.createDataFrame(data, "session_id string, run int, seq int, code string, impact string, count double").withColumn("recorded_at", F.lit(T0))
    merged = store.merge_signals(df).drop("recorded_at")
    assert rows(merged.select("session_id", "run", "code", "count", "impact")) == [("a", 1, "x", 2, "serious"), ("a", 1, "y", 0, None), ("a", 2, "y", 1, None), ("b", 1, "x", 0, None)]
    assert rows(store.latest_run(merged).select("session_id", "run", "code")) == [("a", 2, "y"), ("b", 1, "x")]


def test_users_and_sweeps(spark):
    users = spark.createDataFrame([(1, "old", 9, "t0"), (2, "kept", 3, "t0")], "github_user_id long, github_login string, max_review_iterations long, created_at string")
    new = spark.createDataFrame([(1, "new", "t1"), (3, "third", "t1")], "github_user_id long, github_login string, created_at string")
    assert rows(store.upsert_users(users, new)) == [(1, "new", 9, "t0"), (2, "kept", 3, "t0"), (3, "third", 3, "t1")]
    s = spark.createDataFrame([("a", "running", None, "t0"), ("b", "closed", None, "t0"), ("c", "queued", None, "t0")], "session_id string, status string, error string, updated_at string")
    swept = rows(store.fail_stale(s, F.lit("t9"), "gone").select("session_id", "status", "error", "updated_at"))
    assert swept == [("a", "failed", "gone", "t9"), ("b", "closed", None, "t0"), ("c", "failed", "gone", "t9")]
    assert rows(store.backfill_completion(s).select("session_id", "first_completed_at")) == [("a", None), ("b", "t0"), ("c", None)]
    with pytest.raises(LegacySchemaError):
        refuse_legacy_users(["github_user_id", "github_token"])
    refuse_legacy_users(users.columns)


def test_completion_is_never_lost(spark):
    rnd = random.Random(6)
    moves = [(f"s{rnd.randrange(6)}", i, at(i), rnd.choice(["running", "failed", "ready_for_review", "closed"])) for i in range(80)]
    df = spark.createDataFrame(moves, "session_id string, seq long, ts timestamp_ntz, status string")
    before = 0
    for upto in (5, 20, 50, 80):
        folded = store.fold_transitions(df.where(F.col("seq") < upto)).withColumn("image_count", F.lit(1).cast("long"))
        documents = store.public_volume(folded).first().documents
        assert documents >= before
        before = documents
    for r in store.fold_transitions(df).collect():
        own = [m for m in moves if m[0] == r.session_id]
        assert r.status == own[-1][3] and r.first_completed_at == next((m[2] for m in own if m[3] == "ready_for_review"), None)


def test_claims(spark):
    sessions = spark.createDataFrame([("a", "ready_for_review"), ("b", "failed")], "session_id string, status string")
    claims = [("a", 1, 10, "ready_for_review", "queued"), ("a", 2, 11, "ready_for_review", "queued"), ("a", 3, 12, "queued", None), ("a", 4, 13, "queued", "running"), ("b", 5, 1, "ready_for_review", "queued"), ("zz", 6, 1, "queued", "x")]
    df = spark.createDataFrame(claims, "session_id string, claim_id long, ts long, expected string, status string")
    assert rows(store.compare_and_set(sessions, df)) == [("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 4, True), ("b", 5, False), ("zz", 6, False)]


# --- run log


def test_log_lines(spark):
    log = "\n".join(['{"ts":"t1","type":"phase","phase":"extraction"}', "", "not json", '{"ts":"t2","type":"model_call","ok":false,"duration_ms":5,"extra":[1]}', "[]", '{"type":'])
    found = runlog.parse_lines(spark.createDataFrame([("s", log), ("e", "")], "session_id string, value string"))
    assert [(r.session_id, r.line, r.type, r.ok) for r in found.orderBy("line").collect()] == [("s", 0, "phase", None), ("s", 3, "model_call", False)]


EVENT = "session_id string, line long, ts timestamp_ntz, type string, agent string, model string, capability string"


def by_hand(events):
    opened = []
    for kind, key, line in events:
        if kind == "model_call_start":
            opened.append((key, line))
        else:
            hit = next((x for x in opened if x[0] == key), opened[0] if opened else None)
            opened = [x for x in opened if x is not hit]
    return opened


@pytest.mark.parametrize("seed", range(4))
def test_open_calls(spark, seed):
    rnd = random.Random(seed)
    events = [(rnd.choice(["model_call_start", "model_call"]), rnd.choice(["a", "b", None]), i) for i in range(30)]
    df = spark.createDataFrame([("s", i, at(i), k, a, "m", None) for k, a, i in events], EVENT)
    want = by_hand([(k, f"{a or '?'}|m|?", i) for k, a, i in events])
    assert sorted((r.key, r.line) for r in runlog.in_flight_exact(df).collect()) == sorted(want)


def test_phases(spark):
    log = spark.createDataFrame([("s", 0, at(0), "phase", "a"), ("s", 1, at(5), "phase", "b"), ("s", 2, at(6), "phase", "a"), ("s", 3, at(9), "run_complete", None), ("s", 4, at(20), "phase", "")], "session_id string, line long, ts timestamp_ntz, type string, phase string")
    done = rows(runlog.phase_durations(log, F.lit("closed"), F.lit(at(99)).cast("timestamp_ntz")))
    assert done == [("s", "a", 3000), ("s", "b", 1000)]
    assert rows(runlog.phase_durations(log, F.lit("running"), F.lit(at(99)).cast("timestamp_ntz"))) == [("s", "a", 93_000), ("s", "b", 1000)]


# --- links


def test_pdf_links(spark):
    xml = (
        'x<a href="http://early/">e</a><page number="1"><a href="http://a/?x=1&amp;y">One </a><a href="http://a/?x=1&amp;y"><b>two</b></a><a href="http://b/">hy-</a><a href="http://b/">phen</a><a href="http://a/?x=1&amp;y">again</a>'
        '<a href="javascript:x">j</a><a href="http://q/&#34;">q</a></page><page number="3"><a href="tel:1">' + "t" * 200 + "</a></page>"
    )
    found = rows(links.pdf_links(spark.createDataFrame([("d", xml), ("none", "")], "doc string, xml string")))
    assert found == [("d", 1, 0, "One two", "http://a/?x=1&y"), ("d", 1, 1, "hy-phen", "http://b/"), ("d", 1, 2, "again", "http://a/?x=1&y"), ("d", 3, 0, "t" * 160 + "…", "tel:1")]


def test_missing_and_unexpected(spark):
    held = [("d", 1, 0, "a", "HTTP://A/x/"), ("d", 1, 1, "b", "http://b"), ("d", 1, 2, "b2", "http://b/"), ("d", 1, 45, "late", "http://late"), ("d", 2, 0, "c", "http://c")]
    own = spark.createDataFrame(held, "doc string, page int, pos int, text string, href string")
    html = spark.createDataFrame([("d", 1, '<a href="http://A/x">a</a><a href="#z">z</a><a href=http://new>n</a>'), ("d", 2, ""), ("d", 3, '<a href="http://free">f</a>')], "doc string, page int, html string")
    assert rows(links.missing_links(own, html)) == [("d", 1, 1, "b", "http://b"), ("d", 2, 0, "c", "http://c")]
    assert rows(links.unexpected_links(own, html)) == [("d", 1, "http://new")]
    assert [len(r.links) for r in links.pages_with_links(html.drop("html"), own).orderBy("page").collect()] == [4, 1, 0]


# --- lessons, gates, review


def test_lessons(spark):
    events = [("p", "generalizable", "Use ALT text!", "s1", 1), ("p", "generalizable", "use alt text", "s1", 2), ("p", "generalizable", "use  alt text", "s2", 3), ("p", "a11y_policy", "label fields", "s1", 4), ("p", "generalizable", "once only", "s9", 9)]
    events += [("q", "generalizable", f"lesson {chr(97 + i)}", f"s{j}", 100 + i) for i in range(26) for j in range(2)]
    df = spark.createDataFrame(events, "agent string, kind string, instruction string, session string, seq long")
    kept = lessons.bank(df)
    assert [(r.norm_key, r["count"]) for r in kept.where("agent = 'p'").orderBy("rank").collect()] == [("use alt text", 2), ("once only", 1), ("label fields", 1)]
    assert kept.where("agent = 'q'").count() == 20
    fit = lessons.eligible(kept)
    assert {r.norm_key for r in fit.where("agent = 'p'").collect()} == {"use alt text", "label fields"} and fit.where("agent = 'q'").count() == 6
    assert lessons.eligible(kept, kind="a11y_policy").count() == 1


def test_gates(spark):
    cases = [("a", 1, 0.9, True, None), ("a", 1, None, None, None), ("b", 0, 1.0, True, True), ("c", 1, 0.84, True, True), ("d", 1, 0.9, False, True)]
    df = spark.createDataFrame(cases, "agent string, blocks int, covered double, faithful boolean, accessible boolean")
    agents = spark.createDataFrame([(x,) for x in "abcde"], "agent string")
    assert rows(gates.regression_gate(agents, df).select("agent", "passed")) == [("a", True), ("b", False), ("c", False), ("d", False), ("e", True)]
    score = "agent string, case_file string, score double"
    was = spark.createDataFrame([("a", "1", 1.0), ("a", "2", None), ("a", "3", 0.8), ("b", "1", None), ("c", "1", 0.9)], score)
    now = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.1), ("b", "1", 0.5), ("c", "1", 0.881)], score)
    got = {r.agent: r for r in gates.eval_gate(gates.paired_means(was, now)).collect()}
    assert (got["a"].paired, got["a"].current_mean, got["a"].candidate_mean, got["a"].blocked) == (1, 1.0, 0.9, True)
    assert (got["b"].paired, got["b"].current_mean, got["b"].blocked) == (0, None, False) and not got["c"].blocked


def test_review(spark):
    pages = spark.createDataFrame([("d", i) for i in (1, 2, 3)], "doc string, ord int")
    said = spark.createDataFrame([("d", 1, ["3", "1", "1", "x", "2.5", "3.0", "9"]), ("d", 2, []), ("d", 3, None)], "doc string, item int, claimed array<string>")
    assert rows(review.known_pages(said, pages)) == [("d", 1, [1, 3]), ("d", 2, []), ("d", 3, [])]
    issues = spark.createDataFrame([("d", 0, 1, [2]), ("d", 1, 1, [2]), ("d", 1, 2, []), ("d", 2, 1, [9]), ("d", 3, 1, [1]), ("d", 3, 2, None)], "doc string, round int, item int, pages array<int>")
    got = rows(review.images_for_issues(issues, pages))
    assert got == [("d", 0, 2), *(("d", r, p) for r in (1, 2, 3) for p in (1, 2, 3))]
    scope = lambda t, k, n: one(spark, review.feedback_scope(F.lit(t).cast("string"), F.lit(k), F.lit(n)))
    assert [scope("extraction", 2, 4), scope("extraction", 3, 4), scope("extraction", 1, 1), scope("extraction", 0, 4), scope(None, 1, 4), scope("assembly", 1, 4)] == ["extraction", "document", "extraction", "document", "document", "document"]
    rounds = spark.createDataFrame([("clean", 0, 0), ("third", 0, 2), ("third", 1, 1), ("third", 2, 0), ("open", 0, 4), ("open", 1, 4), ("open", 2, 4), ("open", 3, 5)], "doc string, round int, issues int")
    assert rows(review.review_outcome(rounds, 3)) == [("clean", 0, 0), ("open", 3, 5), ("third", 2, 0)]


# --- anchors


def test_relational_anchors_equal_the_exact_ones(spark):
    rnd = random.Random(3)
    tokens = ["fn-1", "q", "p1-x", "p2--y", "z"]
    data = []
    for doc in range(12):
        for i in range(rnd.randrange(1, 5)):
            html = "".join(f'<p id="{t}">{t}</p>' for t in rnd.sample(tokens, rnd.randrange(0, 4))) + "".join(f'<a href="#{t}">r</a>' for t in rnd.sample([*tokens, "none"], 3))
            data.append((doc, i, rnd.choice([1, 2, 3]), html))
    pages = spark.createDataFrame(data, "doc long, page_idx int, ord int, inner_html string")
    ids, refs = anchors.exploded_tokens(pages)
    new_ids = {(r.doc, r.page_idx, r.token): r.new_token for r in anchors.renames(pages, ids).collect()}
    new_refs = {(r.doc, r.page_idx, r.token): r.new_token for r in anchors.repoint(pages, ids, refs).collect()}
    for doc in range(12):
        own = [r for r in data if r[0] == doc]
        made = anchors._anchors.namespace_pages([(o, h) for _, _, o, h in own])
        for (_, i, _, html), new in zip(own, made.pages, strict=True):
            assert [new_ids[doc, i, t] for t in anchors._anchors.page_ids(html)] == anchors._anchors.page_ids(new)
            assert [new_refs[doc, i, t] for _, t in anchors._anchors.page_references(html)] == [t for _, t in anchors._anchors.page_references(new)]
        all_ids = [x for p in made.pages for x in anchors._anchors.page_ids(p)]
        assert len(all_ids) == len(set(all_ids))


def test_assembled_documents(spark):
    data = [(1, 0, 2, " <p>b</p> "), (1, 1, 1, "<p>a</p>"), (1, 2, 3, "  "), (2, 0, 1, None)]
    got = {r.doc: r for r in anchors.assemble(spark.createDataFrame(data, "doc long, page_idx int, ord int, inner_html string")).collect()}
    assert got[1].body == "<p>a</p>\n\n<p>b</p>" and got[2].body == "" and got[1].collisions == []


# --- dispatch


def test_dispatch(spark):
    library = spark.createDataFrame([("chart",)], "name string")
    asked = spark.createDataFrame([(1, "", 1), (2, None, 1), (3, " Table.md", 1), (4, "chart.md", 0), (5, "chart", 2), (6, "other", 2)], "i int, name string, found int")
    got = {r.i: r.decision for r in dispatch.dispatch(asked, library).collect()}
    assert got == {1: "unresolved", 2: "unresolved", 3: "declined", 4: "no_content", 5: "dispatched", 6: "unresolved"}
    types = spark.createDataFrame([(1, "Map"), (2, "map.md"), (3, "LIST"), (4, "Chart"), (5, "  ")], "seq int, name string")
    assert rows(dispatch.new_types(types, library)) == [(1, "Map")]
    prompts = spark.createDataFrame([("a", 1, "x"), ("a", 0, "## Required capability\nvision, audio\n## Next\nno"), ("b", 1, "y")], "name string, priority int, text string")
    assert {r.name: (r.priority, r.capabilities) for r in dispatch.pick_agents(prompts).collect()} == {"a": (0, ["vision", "audio"]), "b": (1, ["vision"])}


def test_image_limits_without_agents(spark):
    models = spark.createDataFrame([("reader", "p", "m")], "agent string, provider string, model string")
    providers = spark.createDataFrame([], "provider string, max_base64_bytes long, max_image_bytes long, max_long_edge_px long")
    assert tuple(dispatch.image_limits(models, providers).first()) == (3_932_160, 1568)


# --- scheduling


def test_queue(spark):
    jobs = spark.createDataFrame([("q", i, float(s), float(r)) for i, (s, r) in enumerate([(0, 10), (1, 10), (2, 1), (30, 1)])], "queue string, job_id long, submit_s double, run_s double")
    assert rows(scheduling.queue_waits(jobs, 0)) == [("q", 0, 0.0, 0.0), ("q", 1, 10.0, 9.0), ("q", 2, 20.0, 18.0), ("q", 3, 30.0, 0.0)]
    assert rows(scheduling.queue_waits(jobs, 2))[2] == ("q", 2, 10.0, 8.0)


def test_byte_gate_and_cache(spark):
    req = [(1, 1, at(0), 80, 10), (1, 2, at(1), None, 10), (1, 3, at(2), 20, 1), (1, 4, at(11), 500, 5), (2, 5, at(0), 999, 1)]
    df = spark.createDataFrame(req, "client long, request_id long, ts timestamp_ntz, declared_bytes long, hold_s long")
    assert rows(scheduling.admitted(df, 100, 100, "client")) == [(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True), (2, 5, True)]
    # One counter for all clients of a deployment: the second client meets the 80 of the first.
    assert rows(scheduling.admitted(df, 100, 100)) == [(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True), (2, 5, False)]
    odd = spark.createDataFrame([(1, 1, at(0), 0, 10), (2, 2, at(1), -5, 10), (3, 3, at(11), -5, 1), (3, 4, at(11), 0, 1)], df.schema)
    assert rows(scheduling.admitted(odd, 100, 150)) == [(1, 1, True), (2, 2, False), (3, 3, True), (3, 4, False)]
    looks = spark.createDataFrame([(1, i, at(s)) for i, s in enumerate([0, 299, 300, 500, 601])], "client long, request_id long, ts timestamp_ntz")
    assert [r[2] for r in rows(scheduling.token_cache(looks))] == [False, True, False, True, False]


CHUNKS = "call_id string, seq long, ts timestamp_ntz, kind string, text_length int"


def test_stalls(spark):
    def call(name, *events):
        return [(name, i, at(s), k, n) for i, (s, k, n) in enumerate(events)]

    data = [
        *call("fine", (0, "protocol", 0), (119, "text", 3), (178, "text", 0), (237, "done", 0)),
        *call("first", (0, "protocol", 0), (60, "keepalive", 0), (121, "text", 1)),
        *call("idle", (0, "text", 1), (50, "keepalive", 0), (61, "text", 1)),
        *call("slow", *((50 * i, "text", 1) for i in range(20))),
        *call("rearmed", (0, "protocol", 0), (100, "protocol", 0), (200, "text", 1)),
    ]
    got = {r.call_id: r.kind for r in scheduling.stalls(spark.createDataFrame(data, CHUNKS)).collect()}
    assert got == {"first": "first_output", "idle": "idle", "slow": "total"}


def test_event_stream(spark):
    reads = [("c", 0, "data: on"), ("c", 1, "e\r\n: ping\ndata:two\nda"), ("c", 2, "ta: [DONE]\ndata: after\n"), ("d", 0, "data: x")]
    assert rows(scheduling.sse_events(spark.createDataFrame(reads, "call_id string, seq int, text string"))) == [("c", 0, "one"), ("c", 2, "two"), ("d", 0, "x")]


def test_usage_keeps_absent_apart_from_zero(spark):
    events = [("a", 1, 0, 5, None), ("a", 1, 1, 7, None), ("a", 2, 0, 1, None), ("b", 1, 0, None, 0)]
    got = rows(scheduling.call_usage(spark.createDataFrame(events, "call_id string, attempt int, seq int, input_tokens long, output_tokens long")))
    assert got == [("a", 8, None), ("b", None, 0)]


def test_bounded_map(spark):
    def double(batches):
        for b in batches:
            yield b.assign(x=b["x"] * 2)

    got = scheduling.bounded_map(spark.range(5).select(F.col("id").alias("x")), double, "x long", 2, "x").collect()
    assert [r.x for r in got] == [0, 2, 4, 6, 8]


# --- sources and sinks


def test_sources(spark, tmp_path):
    for session, name, body in (("s1", "log.jsonl", '{"type":"phase","ts":"t"}\nbad\n'), ("s2", "log.jsonl", "\n")):
        (tmp_path / "runs" / session).mkdir(parents=True)
        (tmp_path / "runs" / session / name).write_text(body)
    assert [(r.session_id, r.type) for r in readers.read_run_logs(spark, f"{tmp_path}/runs/*/log.jsonl").collect()] == [("s1", "phase")]
    (tmp_path / "in" / "s1").mkdir(parents=True)
    for f in ("0002__b__c.png", "0001__a.png", "skip.png", "x__y.png"):
        (tmp_path / "in" / "s1" / f).write_bytes(b"x")
    got = rows(readers.read_page_images(spark, f"{tmp_path}/in/*").select("session", "order", "name"))
    assert got == [("s1", 1, "a.png"), ("s1", 2, "b__c.png"), ("s1", None, "y.png")]
    files = spark.createDataFrame([("s", '{"1":[{"text":"t","href":"h"}],"2":[]}'), ("bad", "[1"), ("none", None)], "session string, value string")
    assert rows(readers.page_links(files)) == [("s", 1, 0, "t", "h")]
    banks = spark.createDataFrame([('[{"instruction":"i","count":2}]',), ("{}",), ("nope",), (None,)], "v string")
    assert [len(r.x) for r in banks.select(readers.lessons(F.col("v")).alias("x")).collect()][0] == 1
    (tmp_path / "lib").mkdir()
    (tmp_path / "own").mkdir()
    for folder, name in (("lib", "page.md"), ("lib", "table.md"), ("own", "table.md")):
        (tmp_path / folder / name).write_text(folder)
    best = dispatch.pick_agents(readers.read_prompts(spark, f"{tmp_path}/own", f"{tmp_path}/lib"))
    assert {(r.name, r.text) for r in best.collect()} == {("page", "lib"), ("table", "own")}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", None, 1, "t"), ("b", "x", None, 1, "t")], "session_id string, code string, impact string, count long, recorded_at string")
    writers.replace_signals(old, f"{tmp_path}/signals", 1)
    writers.replace_signals(old.where("session_id = 'b'"), f"{tmp_path}/signals", 1)
    assert [r.session_id for r in spark.read.parquet(f"{tmp_path}/signals").collect()] == ["b"]
    path = writers.write_table(old.drop("impact"), str(tmp_path), "run_signals", "v1")
    assert path.endswith("run_signals/v1") and readers.read_table(spark, str(tmp_path), "run_signals").columns == ["session_id", "code", "impact", "count", "recorded_at"]
    writers.append_events(spark.createDataFrame([("t", "phase", None)], "ts string, type string, phase string"), f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").first().value == '{"ts":"t","type":"phase"}'


def test_bounded_cache(spark):
    schema = "client long, request_id long, ts timestamp_ntz"
    looks = spark.createDataFrame([(c, i, at(s)) for i, (c, s) in enumerate([(1, 0), (2, 1), (3, 2), (1, 3), (3, 4), (2, 5), (None, 6), (None, 7)])], schema)
    # The third entry takes the oldest one's place, the fourth the second's, and so on; a hit renews nothing.
    assert [r[2] for r in sorted(rows(scheduling.token_cache(looks, 300, 2)), key=lambda r: r[1])] == [False, False, False, False, True, False, False, True]
    assert [r[2] for r in sorted(rows(scheduling.token_cache(looks, 300, 9)), key=lambda r: r[1])] == [False, False, False, True, True, True, False, True]
    assert rows(scheduling.token_cache(looks.limit(0), 300, 2)) == []


def test_rate_decisions(spark):
    asked = [(1, i, at(s)) for i, s in enumerate([30, 50, 61, 89, 90, 91, 150, 1000])]
    got = rows(scheduling.rate_decisions(spark.createDataFrame(asked, "client long, request_id long, ts timestamp_ntz"), 2))
    began = [r[2] - got[0][2] for r in got]
    assert began == [0, 0, 0, 0, 60, 60, 120, 970]
    assert [(r[3], r[5]) for r in got] == [(1, None), (2, None), (3, 29), (4, 1), (1, None), (2, None), (1, None), (1, None)]


def test_stalls_until_watched(spark):
    data = [("a", 0, at(0), "text", 1), ("b", 0, at(0), "protocol", 0), ("c", 0, at(0), "text", 1), ("d", 0, at(0), "text", 1), ("d", 1, at(70), "text", 1)]
    watched = spark.createDataFrame([("a", at(61)), ("b", at(119)), ("d", at(900))], "call_id string, ts timestamp_ntz")
    chunks = spark.createDataFrame(data, CHUNKS)
    assert sorted(map(tuple, scheduling.stalls(chunks, watched).collect())) == [("a", None, "idle"), ("d", 1, "idle")]
    assert [tuple(r) for r in scheduling.stalls(chunks).collect()] == [("d", 1, "idle")]
