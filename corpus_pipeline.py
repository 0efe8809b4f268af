"""A corpus pipeline over ``documents``: quality, language, near-duplicates, secrets, packing.

Each stage gets what the one before it kept and returns the columns of ``documents``; the last returns packed
pieces.  Stages are written as Parquet in the shared folder and read again, so a lost executor costs one stage
at most; a stage's table is deleted once the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import language, neardup, packing, quality, secrets
from folioscope.llm.common import Scratch, documents, small_batches, stored

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5
#: Documents that resemble no language's profile more than this are rejected, whatever the language.
MIN_LANGUAGE_SCORE = 0.05
#: So are those that score less than this share of a low quantile of the scores of their language's labelled documents.
LOW_QUANTILE = 0.05
LOW_SHARE = 0.7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the policy ``web-1``."""
    judged = small_batches(docs).withColumn("_m", quality.measured_quality(F.col("text"))).select(*docs.columns, "_m.*")
    return judged.withColumn("_bits", quality.failure_bits()).where(quality.passes("web-1", "_bits")).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language of the corpus is recognized: that score about as the labelled ones of the language do.

    Profiles and least scores are those of all labelled documents that are not held out.
    """
    labelled = docs.where(~language.held_out())
    profiles = language.fit_profiles(labelled)
    lows = language.low_scores(labelled, profiles, LOW_QUANTILE)
    least = F.lit(MIN_LANGUAGE_SCORE)
    if lows:
        bounds = F.create_map(*(F.lit(x) for name, low in sorted(lows.items()) for x in (name, LOW_SHARE * low)))
        least = F.greatest(least, F.try_element_at(bounds, F.col("_p.lang_pred")))
    judged = docs.withColumn("_p", language.predictor(profiles)(F.col("text")))
    known = (F.col("_p.lang_pred") != language.UNKNOWN) & (F.col("_p.score") >= least)
    return judged.where(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words), that of the smallest id.

    Rows that repeat an id are one document: all of them stay or go.  Rows without an id, or without words, are linked with nothing and stay.
    """
    others = neardup.near_duplicates(docs, size=SHINGLE).where("NOT kept").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and ``n_chars`` counted anew where one was."""
    masked = small_batches(docs).withColumn("_masked", secrets.masked(F.col("text")))
    changed = ~F.col("_masked").eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.length("_masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return masked.select(*(n_chars if c == "n_chars" else F.col("_masked").alias("text") if c == "text" else F.col(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Tokenization and rank-order profiles are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        own = Scratch(spark, "stage")
        docs = stored(stage(spark, docs, sf_dir), name, folder=own.folder)
        if before:
            before.drop()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
