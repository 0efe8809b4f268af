"""Pages and review: indexes, attribution, selection of images, re-extraction and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EXCERPT, excerpt

REEXTRACT_SHARE = 0.5


def page_inputs(files: DataFrame, links: DataFrame | None = None, name: str = "file") -> DataFrame:
    """(session, order, name) of files called ``<order>__<name>``, with their links where given."""
    order = F.split(F.col(name), "__", 2)[0].try_cast("int")
    own = files.where(F.contains(F.col(name), F.lit("__"))).withColumn("order", order).withColumn("name", F.split(F.col(name), "__", 2)[1])
    if links is None:
        return own
    held = links.groupBy("session", "order").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "href"))).alias("links"))
    return own.join(held, ["session", "order"], "left").withColumn("links", F.coalesce("links", F.expr("cast(array() AS array<struct<pos:int,text:string,href:string>>)")))


def page_index(pages: DataFrame, doc: str = "doc", order: str = "ord", text: str = "text", size: int = EXCERPT) -> DataFrame:
    """One text per document: an excerpt of each page under its number, in order."""
    block = F.concat(F.lit("### Page "), F.col(order).cast("string"), F.lit("\n"), excerpt(F.col(text), size))
    held = pages.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("held"))
    return held.select(doc, F.array_join(F.transform("held", lambda x: x["b"]), "\n\n").alias("page_index"))


def page_number(text: Column) -> Column:
    """A whole page number from what a model wrote; empty text is 0, anything else that is no whole number null."""
    n = F.when(F.trim(text) == "", F.lit(0.0)).otherwise(F.trim(text).try_cast("double"))
    return F.when(n == F.floor(n), n).cast("int")


def known_pages(claims: DataFrame, pages: DataFrame, keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Claims (keys…, item, claimed array<string>) with the pages that exist, distinct and ascending."""
    each = claims.select(*keys, "item", F.explode("claimed").alias("c")).select(*keys, "item", page_number(F.col("c")).alias("ord"))
    real = each.where(F.col("ord").isNotNull()).join(pages.select(*keys, "ord").distinct(), [*keys, "ord"], "left_semi")
    held = real.groupBy(*keys, "item").agg(F.sort_array(F.collect_set("ord")).alias("pages"))
    return claims.select(*keys, "item").join(held, [*keys, "item"], "left").withColumn("pages", F.coalesce("pages", F.expr("cast(array() AS array<int>)")))


def images_for_issues(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, round, ord) of the images an editor gets: those of attributed pages, or all if any issue has no page.

    Issues are (doc, round, item, pages array<int>).
    """
    rounds = issues.groupBy("doc", "round").agg(
        F.max((F.coalesce(F.size("pages"), F.lit(0)) == 0).cast("int")).alias("any_open"), F.array_distinct(F.flatten(F.collect_list("pages"))).alias("named")
    )
    joined = rounds.join(pages.select("doc", "ord").distinct(), "doc")
    matched = joined.withColumn("hit", F.array_contains("named", F.col("ord")))
    some = matched.groupBy("doc", "round").agg(F.max(F.col("hit").cast("int")).alias("any_hit"))
    out = matched.join(some, ["doc", "round"])
    return out.where((F.col("any_open") == 1) | (F.col("any_hit") == 0) | F.col("hit")).select("doc", "round", "ord")


def replace_fragments(prior: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("doc", "ord"), html: str = "inner_html") -> DataFrame:
    """Prior fragments, those extracted again in place of their old version."""
    new = fresh.select(*keys, F.col(html).alias("_new"))
    return prior.join(new, list(keys), "left").withColumn(html, F.coalesce("_new", html)).drop("_new")


def reextraction(targets: DataFrame, images: DataFrame, prior: DataFrame, keys: tuple[str, ...] = ("doc", "ord")) -> DataFrame:
    """Targets with whether they run: an image and a prior fragment must exist."""
    on = list(keys)
    runs = targets.join(images, on, "left_semi").join(prior, on, "left_semi").select(*keys).distinct().withColumn("runs", F.lit(True))
    return targets.select(*keys).distinct().join(runs, on, "left").withColumn("runs", F.coalesce("runs", F.lit(False)))


def feedback_scope(target: Column, named: Column, n_pages: Column) -> Column:
    """``extraction`` only for feedback aimed there that names some pages, at most half of them (one at least)."""
    most = F.greatest(F.lit(1), F.floor(n_pages * REEXTRACT_SHARE))
    narrow = (target == "extraction") & (named > 0) & (named <= most)
    return F.when(F.coalesce(narrow, F.lit(False)), F.lit("extraction")).otherwise(F.lit("document"))


def review_outcome(rounds: DataFrame, cap: int) -> DataFrame:
    """(doc, iterations, unresolved) from rounds (doc, round, issues): it stops at the first clean round, at the cap at the latest."""
    t = rounds.groupBy("doc").agg(
        F.min(F.when(F.col("issues") == 0, F.col("round"))).alias("clean"), F.sum(F.when(F.col("round") == cap, F.col("issues"))).alias("at_cap")
    )
    done = F.col("clean").isNotNull() & (F.col("clean") <= cap)
    return t.select(
        "doc", F.when(done, F.col("clean")).otherwise(F.lit(cap)).alias("iterations"), F.when(done, F.lit(0)).otherwise(F.coalesce("at_cap", F.lit(0))).cast("long").alias("unresolved")
    )


def unresolved_markdown(issues: DataFrame) -> DataFrame:
    """Open issues of a document (doc, seq, severity, issue) as a list."""
    line = F.concat(F.lit("- **"), F.coalesce("severity", F.lit("?")), F.lit("** "), F.col("issue"))
    held = issues.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("held"))
    return held.select("doc", F.array_join(F.transform("held", lambda x: x["line"]), "\n").alias("markdown"))


def lint_summary(error: Column, found: Column) -> Column:
    """Lint results as lines: the error, or one line per violation, or that there is none."""
    lines = F.array_join(F.transform(found, lambda v: F.concat(v["id"], F.lit(" ("), F.coalesce(v["impact"], F.lit("?")), F.lit("): "), v["nodes"].cast("string"))), "\n")
    return F.when(error.isNotNull(), F.concat(F.lit("lint failed: "), error)).when(F.size(found) == 0, F.lit("no violations")).otherwise(lines)
