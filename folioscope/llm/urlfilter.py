"""URL filters: rules on host and path, and a blocked Bloom filter in front of a list of URLs.

A rule (host, path, verdict) fits its host and all subdomains of it, if the path of the URL begins with the rule's;
of several, the longest wins (of equal length, the first by text).  Where none fits, a URL is blocked if its
canonical form is listed.  A blocked Bloom filter of the list, an array of 64-bit blocks of fixed size, passes
possible hits; only these go on to an exact hash join with the list, which removes false positives.

The canonical form is host and path, the host in lower case without ``www.``, the path without its last slashes,
without fragment and without query.  A null URL, or one without ``://``, has an empty host and path,
fits no rule, is not listed and is allowed.  Repeated rows are judged alike; empty tables give empty results;
a null in the list is left out.  Only the id and the URL are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import BLOCKS, bloom_filter, may_hold

Rule = tuple[str, str, str]

#: The rules of the query: host, path, verdict.
RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: A host with a label that begins with one of these words is listed by default.
LISTED_WORDS = ("ads-", "adult-", "casino-", "cheap-", "free-", "spam-")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(host_col: Column, path_col: Column) -> Column:
    """The canonical form; null where there is no host."""
    form = F.concat(F.regexp_replace(host_col, r"^www\.", ""), F.regexp_replace(path_col, r"/+$", ""))
    return F.when(host_col != "", form)


def rule_of(host_col: Column, path_col: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The winning rule as struct<rule, verdict>; null if none fits."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def default_listing(urls: DataFrame, url_col: str = "url", words: Sequence[str] = LISTED_WORDS) -> DataFrame:
    """(canonical): the distinct canonical URLs whose host has a label that begins with a listed word."""
    own = urls.select(host(F.col(url_col)).alias("h"), path(F.col(url_col)).alias("p"))
    word = "|".join(w.replace("-", "\\-") for w in words)
    return own.where(F.col("h").rlike(rf"(^|\.)({word})")).select(canonical(F.col("h"), F.col("p")).alias("canonical")).distinct()


def filter_urls(
    urls: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, blocks: int = BLOCKS
) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row; ``listed`` has one column, ``canonical``."""
    known = listed.where(F.col("canonical").isNotNull()).select("canonical").distinct()
    own = urls.select(F.col(id_col).alias("_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    own = own.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_key", canonical(F.col("host"), F.col("path")))
    own = own.withColumn("_maybe", may_hold(bloom_filter(known, "canonical", blocks).scalar(), F.col("_key"), blocks))
    hits = known.withColumnRenamed("canonical", "_key").withColumn("_listed", F.lit(True))
    sure = own.where(~F.col("_maybe")).withColumn("_listed", F.lit(None).cast("boolean"))
    maybe = own.where("_maybe").join(hits, "_key", "left")
    both = sure.unionByName(maybe)
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return both.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", method).alias("verdict"),
        F.coalesce("_listed", F.lit(False)).alias("listed"),
    )
