"""Links: from PDF text to pages, and what became of them in the produced HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import shortened

_TOKEN = r"(?is)<page\b[^>]*\bnumber=\"[0-9]+\"|<a\b[^>]*\bhref=\"[^\"]*\"[^>]*>.*?</a>"


def run_separator(before: Column, after: Column) -> Column:
    """What stands between two runs of one link's text: nothing after a hyphen or beside white space, else a space."""
    touching = before.rlike(r"[\s­-]$") | after.rlike(r"^\s") | (before == "") | (after == "")
    return F.when(touching, F.lit("")).otherwise(F.lit(" "))


def pdf_links(xml: DataFrame, doc: str = "doc", source: str = "xml") -> DataFrame:
    """(doc, page, pos, text, href) of the links in converted PDFs.

    Anchors belong to the last page marker before them; those before the first, with an unsafe scheme or unsafe
    characters are dropped; neighbours on a page with the same target become one link.
    """
    found = xml.select(doc, F.posexplode(F.regexp_extract_all(source, F.lit(_TOKEN), F.lit(0))).alias("at", "token"))
    number = F.nullif(F.regexp_extract("token", r"(?i)^<page\b[^>]*\bnumber=\"([0-9]+)\"", 1), F.lit("")).try_cast("int")
    order = Window.partitionBy(doc).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.withColumn("page", F.last(number, ignorenulls=True).over(order))
    anchors = marked.where(F.col("token").rlike(r"(?i)^<a\b") & (F.col("page") >= 1))
    href = F.trim(urls.decode_entities(F.regexp_extract("token", r"(?is)^<a\b[^>]*\bhref=\"([^\"]*)\"", 1)))
    text = urls.decode_entities(F.regexp_replace(F.regexp_extract("token", r"(?is)^<a\b[^>]*>(.*)</a>$", 1), "<[^>]*>", ""))
    safe = anchors.select(doc, "page", "at", href.alias("href"), text.alias("text"))
    safe = safe.where(F.col("href").rlike(urls.SAFE_SCHEME) & ~F.col("href").rlike(urls.UNSAFE))
    return merge_runs(safe, doc)


def merge_runs(links: DataFrame, doc: str = "doc") -> DataFrame:
    """Links (doc, page, at, href, text) with neighbours of one target on a page merged, text cleaned and capped."""
    page = Window.partitionBy(doc, "page").orderBy("at")
    changed = F.coalesce((F.lag("href").over(page) != F.col("href")).cast("int"), F.lit(1))
    islands = links.withColumn("changed", changed).withColumn("pos", F.sum("changed").over(page.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    runs = islands.groupBy(doc, "page", "pos", "href").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("runs"))
    joined = F.aggregate("runs", F.lit(""), lambda acc, r: F.concat(acc, run_separator(acc, r["text"]), r["text"]))
    clean = F.trim(F.regexp_replace(joined, r"\s+", " "))
    return runs.select(doc, "page", F.col("pos").cast("int").alias("pos"), shortened(clean, urls.MAX_LINK_TEXT).alias("text"), "href")


def capped(links: DataFrame, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """The first links of each page, by position."""
    return links.where(F.col("pos") < urls.MAX_LINKS)


def link_counts(links: DataFrame, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """How many links of a page are shown and how many are left out."""
    n = links.groupBy(*keys).agg(F.count("*").alias("links"))
    return n.select(*keys, F.least("links", F.lit(urls.MAX_LINKS)).alias("shown"), F.greatest(F.col("links") - urls.MAX_LINKS, F.lit(0)).alias("dropped"))


def missing_links(links: DataFrame, outputs: DataFrame, keys: tuple[str, ...] = ("doc", "page"), html: str = "html") -> DataFrame:
    """Shown links of a page whose target its output does not link to; of repeats the first."""
    keyed = capped(links).withColumn("norm", urls.normalize_href(F.col("href")))
    present = outputs.select(*keys, F.explode(urls.hrefs(F.col(html))).alias("norm"))
    absent = keyed.join(present, [*keys, "norm"], "left_anti")
    first = Window.partitionBy(*keys, "norm").orderBy("pos")
    return absent.withColumn("r", F.row_number().over(first)).where("r = 1").select(*keys, "pos", "text", "href")


def dropped_links(rewrites: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Rewrites that lost absolute targets, with these."""
    lost = rewrites.withColumn("dropped", urls.dropped_hrefs(F.col(before), F.col(after)))
    return lost.where(F.size("dropped") > 0).drop(before, after)


def unexpected_links(links: DataFrame, outputs: DataFrame, keys: tuple[str, ...] = ("doc", "page"), html: str = "html") -> DataFrame:
    """Absolute targets in an output that no annotation of the page has; pages without annotations are not judged."""
    known = links.select(*keys, urls.normalize_href(F.col("href")).alias("norm")).distinct()
    found = outputs.select(*keys, F.explode(urls.absolute_hrefs(F.col(html))).alias("norm"))
    judged = found.join(known.select(*keys).distinct(), list(keys), "left_semi")
    return judged.join(known, [*keys, "norm"], "left_anti")


def review_links_dropped(rounds: DataFrame, keys: tuple[str, ...] = ("doc",), html: str = "html") -> DataFrame:
    """Targets lost over a document's review rounds, each round held against the one before."""
    order = Window.partitionBy(*keys).orderBy("round")
    lost = F.size(urls.dropped_hrefs(F.coalesce(F.lag(html).over(order), F.lit("")), F.col(html)))
    return rounds.withColumn("lost", lost).groupBy(*keys).agg(F.sum("lost").alias("links_dropped"))


def pages_with_links(pages: DataFrame, links: DataFrame, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """Pages with their links in order; none is an empty array."""
    held = links.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "text", "href"))).alias("held"))
    some = F.transform("held", lambda x: F.struct(x["text"].alias("text"), x["href"].alias("href")))
    return pages.join(held, list(keys), "left").withColumn("links", F.coalesce(some, F.expr("cast(array() AS array<struct<text:string,href:string>>)"))).drop("held")
