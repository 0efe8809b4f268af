"""Lesson memory: dedupe by key, corroboration by distinct sessions, bounded banks, eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key

KEPT, INJECTED, CORROBORATED = 20, 6, 2
POLICY = "a11y_policy"


def corroborated(events: DataFrame) -> DataFrame:
    """One lesson per agent and key: how many sessions taught it, its latest wording and kind.

    Events are (agent, kind, instruction, session, seq); ``seq`` orders them.
    """
    keyed = events.withColumn("norm_key", norm_key(F.col("instruction")))
    return keyed.groupBy("agent", "norm_key").agg(
        F.countDistinct("session").alias("count"),
        F.max_by("instruction", "seq").alias("instruction"),
        F.max_by("kind", "seq").alias("kind"),
        F.max("seq").alias("updated_seq"),
    )


def _ranked(lessons: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("agent").orderBy(F.desc("count"), F.desc("updated_seq"), "norm_key")
    return lessons.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def bank(events: DataFrame, kept: int = KEPT) -> DataFrame:
    """The lessons an agent keeps: the most corroborated, then the latest."""
    return _ranked(corroborated(events), kept)


def eligible(banked: DataFrame, kind: str | None = None, n: int = INJECTED) -> DataFrame:
    """Banked lessons that go into a prompt: policies always, others once corroborated; the best few."""
    fit = banked.where((F.col("kind") == POLICY) | (F.col("count") >= CORROBORATED))
    if kind is not None:
        fit = fit.where(F.col("kind") == kind)
    return _ranked(fit.drop("rank"), n)
