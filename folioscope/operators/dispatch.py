"""Specialists, new content types, image limits and quality alerts: decisions over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.limits import BASE64_CAP, long_edge, raw_cap
from ..functions.text import type_name

# Content types that every page agent handles, and the agents that receive images.
STANDARD_TYPES = ("paragraph", "heading", "list", "table", "formField", "image", "quote", "caption", "footnote")
IMAGE_AGENTS = ("page", "feedback", "copy_editor", "builder")
RESERVED_AGENTS = ("page", "feedback")
MIN_ALERT_DOCUMENTS, ALERTS_A_RUN, ALERT_REST_DAYS = 20, 2, 30


def is_standard(name: Column) -> Column:
    return F.lower(name).isin(*(t.lower() for t in STANDARD_TYPES))


def dispatch_decision(name: Column, has_file: Column, found: Column) -> Column:
    """What happens to a request for a specialist by name: decided by the name, then the library, then what it found."""
    own = type_name(F.coalesce(name, F.lit("")))
    return (
        F.when(own == "", F.lit("unresolved"))
        .when(is_standard(own), F.lit("declined"))
        .when(~F.coalesce(has_file, F.lit(False)), F.lit("unresolved"))
        .when(F.coalesce(found, F.lit(0)) == 0, F.lit("no_content"))
        .otherwise(F.lit("dispatched"))
    )


def dispatch(requests: DataFrame, library: DataFrame) -> DataFrame:
    """Requests (name, found, …) with their decision; the library (name) is small."""
    files = library.select(F.col("name").alias("_file"), F.lit(True).alias("_has")).distinct()
    joined = requests.join(files, type_name(F.col("name")) == F.col("_file"), "left")
    return joined.withColumn("decision", dispatch_decision(F.col("name"), F.col("_has"), F.col("found"))).drop("_file", "_has")


def dispatchable_names(*folders: DataFrame) -> DataFrame:
    """The distinct agent names of several folders without the reserved ones."""
    names = folders[0].select("name")
    for f in folders[1:]:
        names = names.union(f.select("name"))
    return names.distinct().where(~F.col("name").isin(*RESERVED_AGENTS))


def new_types(suggestions: DataFrame, library: DataFrame) -> DataFrame:
    """Suggested types (seq, name) that are neither standard nor in the library; of spellings that differ in case the first."""
    own = suggestions.withColumn("type", type_name(F.col("name"))).where((F.col("type") != "") & ~is_standard(F.col("type")))
    first = own.groupBy(F.lower("type").alias("key")).agg(F.min_by("type", "seq").alias("type"), F.min("seq").alias("seq"))
    known = library.select(F.lower(type_name(F.col("name"))).alias("key"))
    return first.join(known, "key", "left_anti").select("seq", "type")


def pick_agents(candidates: DataFrame) -> DataFrame:
    """One prompt file per name, that of the smallest priority, with the capabilities its text asks for."""
    order = Window.partitionBy("name").orderBy("priority")
    best = candidates.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    section = F.regexp_extract("text", r"(?is)##\s*Required capability\s*\n(.*?)(?:\n##|\z)", 1)
    words = F.regexp_extract_all(F.lower(section), F.lit("[a-z_]+"), F.lit(0))
    return best.withColumn("capabilities", F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("vision"))))


def image_limits(models: DataFrame, providers: DataFrame, agents: tuple[str, ...] = IMAGE_AGENTS) -> DataFrame:
    """The strictest limit on each axis over the agents that receive images; defaults where no agent is configured.

    Models are (agent, provider, model); providers override with (provider, max_base64_bytes, max_image_bytes, max_long_edge_px).
    """
    own = models.where(F.col("agent").isin(*agents)).join(providers, "provider", "left")
    cap = F.coalesce(F.col("max_image_bytes"), raw_cap(F.coalesce(F.col("max_base64_bytes"), F.lit(BASE64_CAP))))
    edge = F.coalesce(F.col("max_long_edge_px"), long_edge(F.col("model")))
    t = own.agg(F.min(cap).alias("b"), F.min(edge).alias("e"))
    return t.select(F.coalesce("b", raw_cap(F.lit(BASE64_CAP))).alias("max_bytes"), F.coalesce(F.col("e"), F.lit(1568)).cast("long").alias("long_edge_px"))


def issue_actions(wanted: DataFrame, open_issues: DataFrame) -> DataFrame:
    """Titles to file: a comment where an issue of exactly that title is open, else a new one."""
    held = open_issues.select("title", F.lit(True).alias("_open")).distinct()
    return wanted.join(held, "title", "left").withColumn("action", F.when(F.col("_open"), F.lit("commented")).otherwise(F.lit("created"))).drop("_open")


def proposal_title(agent: Column, slug: Column) -> Column:
    bare = F.concat(F.lit("Agent update proposal: "), agent)
    return F.when(F.coalesce(slug, F.lit("")) == "", bare).otherwise(F.concat(bare, F.lit(" — "), slug))


def suggestion_title(name: Column) -> Column:
    return F.concat(F.lit("New agent suggestion: "), name)


def quality_alerts(rates: DataFrame, issues: DataFrame, now: Column) -> DataFrame:
    """At most two rates to raise: over their threshold, on enough documents, and not raised of late.

    Rates are (code, documents, rate, threshold); issues (code, open, closed_at).  A threshold of 0 goes first,
    then the rate that is furthest over its threshold.
    """
    over = rates.where((F.col("documents") >= MIN_ALERT_DOCUMENTS) & (F.col("rate") > F.col("threshold")))
    quiet = issues.where(F.col("open") | (F.col("closed_at") >= now - F.expr(f"INTERVAL {ALERT_REST_DAYS} DAYS")))
    fresh = over.join(quiet, "code", "left_anti")
    order = [(F.col("threshold") > 0).cast("int"), F.desc(F.col("rate") - F.col("threshold")), F.col("code")]
    return fresh.orderBy(*order).limit(ALERTS_A_RUN)


def filing_hint(http_status: Column, rate_limited: Column, credential: Column) -> Column:
    """Advice for a filing that was refused: only for 403 and 404, and not for a rate limit."""
    refused = http_status.isin(403, 404) & ~F.coalesce(rate_limited, F.lit(False))
    text = (
        F.when(credential == "app", F.lit("install the app on the repository"))
        .when(credential == "token", F.lit("give the token access to issues"))
        .otherwise(F.lit("sign in again and allow access to the repository"))
    )
    return F.when(refused, text)


def refusal_cause(http_status: Column, remaining: Column, message: Column, service_token: Column) -> Column:
    """What to look at after a refused filing; null where permissions are not the cause.

    403 and 404 are told apart for both credentials: a service token is short of scopes, or can't see the repository or has
    its name wrong; a user's token lacks the app's right to write issues, or can't see the repository, the name is wrong, or the app is not
    installed.  Rate limits, known by no requests ``remaining`` or by the message, are no matter of permissions.
    """
    limited = F.coalesce(remaining == "0", F.lit(False)) | F.coalesce(message.rlike("(?i)rate limit|abuse"), F.lit(False)) | F.coalesce(message.ilike("%secondary limit%"), F.lit(False))
    service = F.coalesce(service_token, F.lit(False))
    cause = (
        F.when(service & (http_status == 403), F.lit("service token: scopes"))
        .when(service & (http_status == 404), F.lit("service token: access or repository name"))
        .when(http_status == 403, F.lit("app: right to write issues"))
        .when(http_status == 404, F.lit("app not installed, repository name or user's access"))
    )
    return F.when(~limited, cause)
