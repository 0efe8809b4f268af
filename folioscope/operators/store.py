"""The relational store: tallies over signals, keyset pages, merges, claims and sweeps.

Every operator takes and returns DataFrames; nothing is collected, and "now" is always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, UNRESOLVED, LINKS_DROPPED, LINT_ERROR = "sys:rounds", "sys:unresolved", "sys:links-dropped", "sys:lint-error"
OWN_PREFIX = "sys:"
#: Bounds of the quality window in days, and the documents a public figure needs.
DEFAULT_DAYS, MIN_DAYS, MAX_DAYS = 30, 1, 365
PUBLIC_FLOOR = 20
#: Session page sizes.
DEFAULT_LIMIT, MAX_LIMIT = 20, 100
INTERRUPTED = "The service restarted while this session was in progress."


# --- lookups and projections -------------------------------------------------------------------------------------


def get_user(users: DataFrame, user_id: int) -> DataFrame:
    return users.where(F.col("github_user_id") == user_id)


def owned_session(sessions: DataFrame, session_id: str, user_id: int) -> DataFrame:
    """The session if it is the user's; absent and not owned give the same empty answer."""
    return sessions.where((F.col("session_id") == session_id) & (F.col("github_user_id") == user_id))


def session_summary(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "status", "created_at", "image_count", "first_completed_at")


def visible_error(status: Column, error: Column) -> Column:
    """An error shows only on a failed session, and only if it says something."""
    return F.when((status == "failed") & (error != ""), error)


# --- keyset paging -----------------------------------------------------------------------------------------------


def before_cursor(created_at: Column, session_id: Column, cursor_at: Column, cursor_id: Column) -> Column:
    """(created_at, session_id) < cursor, spelled so that Parquet can prune by the first column."""
    return (created_at <= cursor_at) & ((created_at < cursor_at) | (session_id < cursor_id))


def clamp_limit(text: Column) -> Column:
    """The page size for a query parameter: its leading integer if that is 1 or more, at most 100, else 20."""
    lead = F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit(""))
    value = lead.try_cast("decimal(38,0)")
    return F.when(value >= 1, F.least(value, F.lit(MAX_LIMIT)).cast("int")).otherwise(F.lit(DEFAULT_LIMIT))


def list_sessions(
    sessions: DataFrame, user_id: int, limit: int, status: str | None = None, cursor: tuple[object, str] | None = None
) -> DataFrame:
    """The newest sessions of a user before a cursor; the plan is a bounded top-k, not a sort."""
    tests = [F.col("github_user_id") == user_id]
    if status is not None:
        tests.append(F.col("status") == status)
    if cursor is not None:
        tests.append(before_cursor(F.col("created_at"), F.col("session_id"), F.lit(cursor[0]), F.lit(cursor[1])))
    found = sessions.where(reduce(Column.__and__, tests))
    return found.orderBy(F.desc("created_at"), F.desc("session_id")).limit(max(1, limit))


def page_numbers(sessions: DataFrame, limit: int) -> DataFrame:
    """Every session with the page a walk through its user's list meets it on, and whether more follow that page."""
    order = Window.partitionBy("github_user_id").orderBy(F.desc("created_at"), F.desc("session_id"))
    total = Window.partitionBy("github_user_id")
    ranked = sessions.withColumn("row", F.row_number().over(order)).withColumn("rows", F.count("*").over(total))
    page = F.floor((F.col("row") - 1) / limit)
    return ranked.withColumn("page_no", page).withColumn("has_more", F.col("rows") > (page + 1) * limit).drop("rows")


def encode_cursor(ts: Column, session_id: Column) -> Column:
    return F.concat_ws("|", ts, session_id)


def parse_cursor(text: Column) -> Column:
    """struct<ts, id> of ``ts|id`` (split at the first bar; id may be missing); null unless ts is a full ISO stamp in UTC."""
    at = F.locate("|", text)
    ts = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    rest = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(F.lit(""))
    shape = ts.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$")
    moment = F.try_to_timestamp(F.when(shape, F.translate(F.substring(ts, 1, 23), "T", " ")), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return F.when(moment.isNotNull(), F.struct(ts.alias("ts"), rest.alias("id")))


# --- tallies -----------------------------------------------------------------------------------------------------


def clamp_window(value: Column) -> Column:
    """Days of the quality window: whole, 1 to 365; anything that is no number, or 0, is 30."""
    days = F.floor(F.trim(value).try_cast("double"))
    usable = F.when(days.isNull() | (days == 0) | F.isnan(F.trim(value).try_cast("double")), F.lit(DEFAULT_DAYS)).otherwise(days)
    return F.least(F.lit(MAX_DAYS), F.greatest(F.lit(MIN_DAYS), usable)).cast("int")


def public_volume(sessions: DataFrame) -> DataFrame:
    """Documents ever completed, their pages, and since when."""
    done = sessions.where(F.col("first_completed_at").isNotNull())
    return done.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("image_count"), F.lit(0)).alias("pages"),
        F.min("first_completed_at").alias("since"),
    )


def in_window(signals: DataFrame, now: Column, days: int) -> DataFrame:
    return signals.where(F.col("recorded_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def _documents(code: str) -> Column:
    return F.count(F.when(F.col("code") == code, 1))


def quality_rates(signals: DataFrame, now: Column, days: int = DEFAULT_DAYS) -> DataFrame:
    """One row for the window: documents, mean rounds (null without documents) and rates (0 without documents)."""
    own = in_window(signals, now, days).where(F.col("code").startswith(OWN_PREFIX))
    rounds = F.col("code") == ROUNDS
    t = own.agg(
        _documents(ROUNDS).alias("documents"),
        F.sum(F.when(rounds, F.col("count"))).alias("rounds"),
        _documents(UNRESOLVED).alias("unresolved"),
        _documents(LINKS_DROPPED).alias("links_dropped"),
        _documents(LINT_ERROR).alias("lint_error"),
        F.min(F.when(rounds, F.col("recorded_at"))).alias("since"),
    )
    n = F.nullif(F.col("documents"), F.lit(0)).cast("double")
    rate = lambda c: F.coalesce(F.col(c) / n, F.lit(0.0))
    return t.select(
        "documents",
        (F.col("rounds") / n).alias("mean_rounds"),
        rate("unresolved").alias("unresolved_rate"),
        rate("links_dropped").alias("links_dropped_rate"),
        rate("lint_error").alias("lint_error_rate"),
        "since",
    )


def quality_rules(signals: DataFrame, now: Column, days: int = DEFAULT_DAYS) -> DataFrame:
    """Per rule: documents, nodes, greatest impact by text, share of documents; the commonest first.

    The number of documents rides along as one row that is joined to the rules, which are few.
    """
    own = in_window(signals, now, days)
    documents = own.agg(_documents(ROUNDS).alias("total"))
    rules = own.where(~F.col("code").startswith(OWN_PREFIX)).groupBy("code")
    per_rule = rules.agg(F.max("impact").alias("impact"), F.count("*").alias("documents"), F.sum("count").alias("nodes"))
    share = F.coalesce(F.col("documents") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return (
        per_rule.withColumn("total", documents.scalar())
        .select("code", "impact", "documents", "nodes", share.alias("share"))
        .orderBy(F.desc("documents"), F.desc("nodes"), "code")
    )


def public_quality(signals: DataFrame, now: Column, floor: int = PUBLIC_FLOOR) -> DataFrame:
    """The public figures of thirty days; no row below the floor of documents."""
    t = in_window(signals, now, DEFAULT_DAYS).agg(
        _documents(ROUNDS).alias("documents"),
        _documents(UNRESOLVED).alias("unresolved"),
        F.sum(F.when(F.col("code") == ROUNDS, F.col("count"))).alias("rounds"),
    )
    clean = (F.col("documents") - F.col("unresolved")) / F.col("documents")
    return t.where(F.col("documents") >= floor).select(
        "documents",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), clean)).alias("clean_rate"),
        (F.col("rounds") / F.col("documents")).alias("mean_rounds"),
    )


def floored_percent(rate: Column) -> Column:
    """A rate as whole percent, never rounded up; guards against 0.29 * 100 = 28.999…"""
    return F.floor(rate * 100 + 1e-9).cast("int")


# --- writes ------------------------------------------------------------------------------------------------------


def merge_signals(signals: DataFrame, keys: tuple[str, ...] = ("session_id", "run")) -> DataFrame:
    """One row per code of a record call: counts floored, at least 0 and summed, the last impact that is not null.

    Rows without a code are dropped; a count that is no number is 0.
    """
    count = F.when(F.isnan("count") | (F.abs("count") == float("inf")), F.lit(0.0)).otherwise(F.coalesce("count", F.lit(0.0)))
    whole = F.greatest(F.lit(0), F.floor(count)).cast("long")
    return (
        signals.where((F.col("code") != "") & F.col("code").isNotNull())
        .groupBy(*keys, "code")
        .agg(
            F.sum(whole).alias("count"),
            F.max_by("impact", F.when(F.col("impact").isNotNull(), F.col("seq"))).alias("impact"),
            F.max("recorded_at").alias("recorded_at"),
        )
    )


def latest_run(signals: DataFrame, run: str = "run") -> DataFrame:
    """Each session's latest run only: a run replaces the signals of the one before it.

    The latest run is found by an aggregate and joined back, so no session is ever sorted whole.
    """
    last = signals.groupBy("session_id").agg(F.max(run).alias(run))
    return signals.join(last, ["session_id", run], "left_semi")


def upsert_users(users: DataFrame, incoming: DataFrame, default_iterations: int = 3) -> DataFrame:
    """Existing users get the new login only; new ones the default cap."""
    old, new = users.alias("o"), incoming.alias("n")
    both = old.join(new, F.col("o.github_user_id") == F.col("n.github_user_id"), "full_outer")
    return both.select(
        F.coalesce("o.github_user_id", "n.github_user_id").alias("github_user_id"),
        F.coalesce("n.github_login", "o.github_login").alias("github_login"),
        F.coalesce("o.max_review_iterations", F.lit(default_iterations)).cast("long").alias("max_review_iterations"),
        F.coalesce("o.created_at", "n.created_at").alias("created_at"),
    )


def new_sessions(requests: DataFrame, now: Column) -> DataFrame:
    """Requests as queued sessions."""
    return requests.select(
        "session_id",
        "github_user_id",
        F.lit("queued").alias("status"),
        F.lit("extraction").alias("phase"),
        F.lit(0).cast("long").alias("iterations_completed"),
        "iterations_max",
        "image_count",
        F.lit(None).cast("string").alias("error"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.nullif(now, now).alias("first_completed_at"),
    )


def fold_transitions(events: DataFrame) -> DataFrame:
    """A session's state after its transitions (session_id, seq, ts, status): the first completion is never overwritten."""
    return events.groupBy("session_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max("ts").alias("updated_at"),
        F.min(F.when(F.col("status") == "ready_for_review", F.col("ts"))).alias("first_completed_at"),
    )


def winning_claims(claims: DataFrame) -> DataFrame:
    """The claim that wins each epoch of a session: the first by time, then by id."""
    order = F.struct("ts", "claim_id")
    return claims.groupBy("session_id", "epoch").agg(F.min_by("claim_id", order).alias("claim_id"), F.min("ts").alias("ts"), F.count("*").alias("claims"))


def compare_and_set(sessions: DataFrame, claims: DataFrame) -> DataFrame:
    """Whether each claim (session_id, claim_id, ts, expected, status) succeeded, by replaying them in order.

    A claim succeeds if the session exists, it has a patch, and no earlier successful claim has moved the
    session off ``expected``.  Claims of a session are folded in one pass over their sorted array.
    """
    per = claims.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("ts", "claim_id", "expected", "status"))).alias("claims"))
    joined = per.join(sessions.select("session_id", F.col("status").alias("start")), "session_id", "left")
    start = F.struct(F.col("start").alias("now"), F.array().cast("array<struct<claim_id:bigint,claimed:boolean>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        ok = F.coalesce((acc["now"] == c["expected"]) & c["status"].isNotNull(), F.lit(False))
        row = F.struct(c["claim_id"].cast("bigint").alias("claim_id"), ok.alias("claimed"))
        return F.struct(F.when(ok, c["status"]).otherwise(acc["now"]).alias("now"), F.concat(acc["out"], F.array(row)).alias("out"))

    return joined.select("session_id", F.explode(F.aggregate("claims", start, step, lambda a: a["out"])).alias("c")).select("session_id", "c.*")


def fail_stale(sessions: DataFrame, now: Column, message: str = INTERRUPTED) -> DataFrame:
    """Sessions after a restart: what was queued or running has failed."""
    stale = F.col("status").isin("running", "queued")
    return sessions.withColumns(
        {
            "error": F.when(stale, F.lit(message)).otherwise(F.col("error")),
            "updated_at": F.when(stale, now).otherwise(F.col("updated_at")),
            "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
        }
    )


def backfill_completion(sessions: DataFrame) -> DataFrame:
    """``first_completed_at`` for a store without that column; failed sessions are left null on purpose."""
    done = F.col("status").isin("ready_for_review", "closed")
    return sessions.withColumn("first_completed_at", F.when(done, F.col("updated_at")))


def run_signals(runs: DataFrame, violations: DataFrame) -> DataFrame:
    """The signals of runs (session_id, recorded_at, rounds, unresolved, links_dropped, lint_failed) and their lint violations.

    Rounds always; unresolved and dropped links only above 0; a lint error as 1; one row per violated rule.
    """
    own = F.array(
        F.struct(F.lit(ROUNDS).alias("code"), F.col("rounds").cast("long").alias("count")),
        F.struct(F.lit(UNRESOLVED).alias("code"), F.col("unresolved").cast("long").alias("count")),
        F.struct(F.lit(LINKS_DROPPED).alias("code"), F.col("links_dropped").cast("long").alias("count")),
        F.struct(F.lit(LINT_ERROR).alias("code"), F.col("lint_failed").cast("long").alias("count")),
    )
    mine = runs.select("session_id", "recorded_at", F.explode(own).alias("s"))
    mine = mine.where((F.col("s.count") > 0) | (F.col("s.code") == ROUNDS))
    mine = mine.select("session_id", "recorded_at", "s.code", F.lit(None).cast("string").alias("impact"), "s.count")
    found = violations.join(runs.select("session_id", "recorded_at"), "session_id")
    return mine.unionByName(found.select("session_id", "recorded_at", F.col("id").alias("code"), "impact", F.col("nodes").cast("long").alias("count")))
