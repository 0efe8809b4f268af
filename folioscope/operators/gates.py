"""Regression and evaluation gates over fixtures, and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words, coverage

COVERAGE_FLOOR, EPSILON, GATE_FIXTURES, STORED_FIXTURES = 0.85, 0.02, 3, 5


def newest(fixtures: DataFrame, n: int = GATE_FIXTURES) -> DataFrame:
    """The newest fixtures of each agent by file name."""
    order = Window.partitionBy("agent").orderBy(F.desc("case_file"))
    return fixtures.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def verdict_ok(faithful: Column, accessible: Column) -> Column:
    """A verdict counts against an output only where it says so."""
    return F.coalesce(faithful, F.lit(True)) & F.coalesce(accessible, F.lit(True))


def failed_check(ok: Column, problems: Column) -> Column:
    return ~ok & (F.size(problems) > 0)


def fixture_coverage(accepted: Column, candidate: Column) -> Column:
    """The word coverage of flattened texts; null where the accepted one has too few words."""
    return coverage(content_words(accepted), content_words(candidate))


def fixture_score(blocks: Column, covered: Column) -> Column:
    """0 without any output, else the coverage; null abstains."""
    return F.when(blocks == 0, F.lit(0.0)).otherwise(covered)


def case_fails(blocks: Column, covered: Column, faithful: Column, accessible: Column) -> Column:
    """No output, or coverage below the floor (the verdict is then not asked), or a bad verdict."""
    low = F.coalesce(covered < COVERAGE_FLOOR, F.lit(False))
    return (blocks == 0) | low | ~verdict_ok(faithful, accessible)


def regression_gate(agents: DataFrame, cases: DataFrame) -> DataFrame:
    """(agent, cases, failures, passed); an agent without fixtures passes.

    Cases carry (agent, blocks, covered, faithful, accessible).
    """
    fails = case_fails(F.col("blocks"), F.col("covered"), F.col("faithful"), F.col("accessible"))
    t = cases.groupBy("agent").agg(F.count("*").alias("cases"), F.count(F.when(fails, 1)).alias("failures"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return agents.join(t, "agent", "left").select("agent", n("cases").alias("cases"), n("failures").alias("failures"), (n("failures") == 0).alias("passed"))


def paired_means(current: DataFrame, candidate: DataFrame, keys: tuple[str, ...] = ("agent", "case_file")) -> DataFrame:
    """Per agent the means over fixtures that both prompts were scored on, and how many these are; null without any."""
    a, b = current.withColumnRenamed("score", "was"), candidate.withColumnRenamed("score", "now")
    both = a.join(b, list(keys), "full_outer")
    paired = F.col("was").isNotNull() & F.col("now").isNotNull()
    return both.groupBy(keys[0]).agg(
        F.count(F.when(paired, 1)).alias("paired"),
        F.avg(F.when(paired, F.col("was"))).alias("current_mean"),
        F.avg(F.when(paired, F.col("now"))).alias("candidate_mean"),
    )


def eval_gate(means: DataFrame) -> DataFrame:
    """Blocks a candidate whose paired mean is worse by more than epsilon."""
    worse = F.col("candidate_mean") < F.col("current_mean") - EPSILON
    return means.withColumn("blocked", F.coalesce(worse, F.lit(False)))


def merge_proposals(proposals: DataFrame) -> DataFrame:
    """One proposal per agent, the latest run's, in the order in which agents first appeared."""
    latest = F.struct("run_ts", "seq")
    return proposals.groupBy("agent_name").agg(F.max_by("proposal", latest).alias("proposal"), F.max("run_ts").alias("run_ts"), F.min(F.struct("run_ts", "seq")).alias("first")).orderBy("first").drop("first")


def capture_fixtures(fragments: DataFrame) -> DataFrame:
    """Accepted fragments (session, seq, agent, image, html) as one fixture per agent.

    The image is that of the agent's first fragment; the HTML joins its fragments of that image in order.
    """
    image = fragments.groupBy("session", "agent").agg(F.min_by("image", "seq").alias("image"))
    mine = fragments.join(image, ["session", "agent", "image"])
    parts = mine.groupBy("session", "agent", "image").agg(F.sort_array(F.collect_list(F.struct("seq", "html"))).alias("parts"))
    return parts.select("session", "agent", "image", F.array_join(F.transform("parts", lambda p: p["html"]), "\n\n").alias("accepted_html"))


def fixture_inputs(fixtures: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """Fixtures (agent, image_file) with the input file whose name after the first ``__`` is their image; null without one."""
    named = files.where(F.contains(F.col(file), F.lit("__"))).select(F.split(F.col(file), "__", 2)[1].alias("image_file"), F.col(file).alias("input_file"))
    first = named.groupBy("image_file").agg(F.min("input_file").alias("input_file"))
    return fixtures.join(first, "image_file", "left")
