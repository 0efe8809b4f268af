"""Ids across the pages of a document: who owns them, what they become, and documents put together.

The relational operators take exploded ids and references and scale with these; ``assemble`` is the exact version, one
document (at most some dozens of pages) at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import anchors as _anchors

TOKENS = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.StringType())),
        T.StructField("refs", T.ArrayType(T.StructType([T.StructField("attr", T.StringType()), T.StructField("token", T.StringType())]))),
    ]
)


@F.pandas_udf(TOKENS)
def page_tokens(pages: pd.Series) -> pd.DataFrame:
    rows = [(_anchors.page_ids(p or ""), [{"attr": a, "token": t} for a, t in _anchors.page_references(p or "")]) for p in pages]
    return pd.DataFrame(rows, columns=["ids", "refs"])


def sniffed(pages: DataFrame, html: str = "inner_html") -> DataFrame:
    """Pages that may hold an id or a reference: a native filter ahead of the parser."""
    return pages.where(F.col(html).rlike(_anchors.ID_PATTERN) | F.col(html).rlike(_anchors.REFERENCE_PATTERN))


def exploded_tokens(pages: DataFrame, html: str = "inner_html") -> tuple[DataFrame, DataFrame]:
    """(doc, page_idx, token) of ids, and (doc, page_idx, attr, token) of references."""
    found = sniffed(pages, html).select("doc", "page_idx", page_tokens(F.col(html)).alias("t"))
    ids = found.select("doc", "page_idx", F.explode("t.ids").alias("token"))
    refs = found.select("doc", "page_idx", F.explode("t.refs").alias("r")).select("doc", "page_idx", "r.attr", "r.token")
    return ids, refs


def id_owners(ids: DataFrame) -> DataFrame:
    """(doc, token, owners, first_owner): the pages that claim each id, in document order."""
    return ids.groupBy("doc", "token").agg(F.sort_array(F.collect_set("page_idx")).alias("owners"), F.min("page_idx").alias("first_owner"))


def collisions(ids: DataFrame) -> DataFrame:
    """Ids that more than one page claims; a repeat within a page is none."""
    t = ids.groupBy("doc", "token").agg(F.countDistinct("page_idx").alias("n_pages"), F.min("page_idx").alias("first_owner"))
    return t.where("n_pages > 1")


def labels(pages: DataFrame) -> DataFrame:
    """(doc, page_idx, label): ``p<order>``, repeats of an order numbered."""
    nth = F.row_number().over(Window.partitionBy("doc", "ord").orderBy("page_idx"))
    label = F.concat(F.lit("p"), F.col("ord").cast("string"), F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(F.lit("")))
    return pages.select("doc", "page_idx", label.alias("label"))


def separators(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, sep): the hyphens after a label that begin no id of the document.

    An id threatens a label if it begins with the label and hyphens; so each id is joined by what stands before one of its
    runs of hyphens, not held against every label.
    """
    names = labels(pages)
    runs = F.regexp_extract_all("token", F.lit("-+"), F.lit(0))
    heads = ids.select("doc", "token").distinct().select("doc", "token", F.posexplode(runs).alias("k", "run"))
    nth = F.regexp_extract_all("token", F.lit("[^-]+|-+"), F.lit(0))
    heads = heads.withColumn("first", F.when(F.startswith("token", F.lit("-")), 0).otherwise(1))
    head = F.array_join(F.slice(nth, F.lit(1), F.col("first") + 2 * F.col("k")), "")
    threats = heads.select("doc", head.alias("label"), F.length("run").alias("n")).join(names, ["doc", "label"], "left_semi")
    most = threats.groupBy("doc").agg(F.max("n").alias("n"))
    return names.select("doc").distinct().join(most, "doc", "left").select("doc", F.repeat(F.lit("-"), F.coalesce("n", F.lit(0)) + 1).alias("sep"))


def repoint(pages: DataFrame, ids: DataFrame, refs: DataFrame) -> DataFrame:
    """What each reference becomes where every page can be rewritten: (doc, page_idx, token, new_token), distinct.

    A reference to an id its page owns goes to that; else to the first owner; one that does not collide stays.
    """
    taken = collisions(ids).select("doc", "token", "first_owner")
    mine = ids.select("doc", "page_idx", "token", F.lit(True).alias("own")).distinct()
    aimed = refs.select("doc", "page_idx", "token").distinct().join(taken, ["doc", "token"], "left").join(mine, ["doc", "page_idx", "token"], "left")
    aimed = aimed.withColumn("owner", F.when(F.col("first_owner").isNotNull(), F.when(F.col("own"), F.col("page_idx")).otherwise(F.col("first_owner"))))
    return _prefixed(aimed, pages, ids)


def renames(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """What each id becomes where every page can be rewritten: (doc, page_idx, token, new_token), distinct."""
    taken = collisions(ids).select("doc", "token", F.lit(True).alias("taken"))
    own = ids.select("doc", "page_idx", "token").distinct().join(taken, ["doc", "token"], "left")
    return _prefixed(own.withColumn("owner", F.when(F.col("taken"), F.col("page_idx"))), pages, ids)


def _prefixed(tokens: DataFrame, pages: DataFrame, ids: DataFrame) -> DataFrame:
    names = labels(pages).withColumnRenamed("page_idx", "owner")
    joined = tokens.join(names, ["doc", "owner"], "left").join(separators(pages, ids), "doc", "left")
    new: Column = F.coalesce(F.concat("label", "sep", "token"), "token")
    return joined.select("doc", "page_idx", "token", new.alias("new_token"))


def ambiguous_references(ids: DataFrame, refs: DataFrame) -> DataFrame:
    """References to colliding ids that their page does not own."""
    taken = refs.select("doc", "page_idx", "token").distinct().join(collisions(ids), ["doc", "token"], "left_semi")
    return taken.join(ids, ["doc", "page_idx", "token"], "left_anti")


REPORT = "doc long, body string, collisions array<string>, pinned array<string>, ambiguous array<string>, skipped array<int>"


def _assemble(batch: pd.DataFrame) -> pd.DataFrame:
    pages = batch.sort_values(["ord", "page_idx"] if "page_idx" in batch else ["ord"], kind="stable")
    made = _anchors.namespace_pages([(int(o), (h or "").strip()) for o, h in zip(pages["ord"], pages["inner_html"], strict=True)])
    row = (
        batch["doc"].iloc[0],
        "\n\n".join(filter(None, made.pages)),
        made.collisions,
        made.pinned,
        [f"{o}:{t}" for o, t in made.ambiguous],
        made.skipped,
    )
    return pd.DataFrame([row], columns=[f.split()[0] for f in REPORT.split(", ")])


def assemble(pages: DataFrame) -> DataFrame:
    """One row per document: its pages in order, ids made unique, joined; and what was found on the way."""
    return pages.groupBy("doc").applyInPandas(_assemble, REPORT)


def assemble_native(pages: DataFrame, html: str = "inner_html") -> DataFrame:
    """Documents without any colliding id, put together without Python."""
    trimmed = F.trim(F.col(html))
    held = pages.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ord", trimmed.alias("h")))).alias("held"))
    return held.select("doc", F.array_join(F.filter(F.transform("held", lambda x: x["h"]), lambda h: h != ""), "\n\n").alias("body"))
