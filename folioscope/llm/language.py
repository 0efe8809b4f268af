"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (one to three letters, words padded with a
space), most frequent first.  A document gets its own list the same way from its whole text.  The
out-of-place distance of the two adds up, over the document's list, how far each n-gram's rank is from its
rank in the profile; an n-gram the profile lacks costs the length of the profile.  The nearest profile wins.

Ties are broken the same way everywhere: n-grams of equal count by their code points, languages of equal
distance by name.

Profiles are fitted on all labelled documents that they are given, and predictions read every whole text.
Null texts and texts without a letter are ``und`` with score 0, as is everything when no labelled
text was given.  Null labels are not learned from.  Columns other than the named ones are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, tidy

UNKNOWN = "und"
PROFILE_SIZE = 300
_NGRAM_BITS = 21

PREDICTION = T.StructType(
    [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: is it a letter or a combining mark?"""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, each packed into one integer, ascending, and their counts."""
    own = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    own = np.concatenate([[0], np.where(letters()[own], own, 0), [0]])
    keep = own != 0
    keep[1:] |= keep[:-1]
    own = own[keep]  # one zero after each word
    if len(own) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.concatenate([[0], own])
    first, second = own[:-1], own[1:]
    two = (first << _NGRAM_BITS) | second
    three = ((two[:-1] << _NGRAM_BITS) | own[2:])[second[:-1] != 0]
    return np.unique(np.concatenate([own[own != 0], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent keys, ties by key."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))][:size]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Profiles:
    """Ranked n-grams of each language, ready for distances."""

    def __init__(self, by_language: dict[str, list[int]]):
        self.names = sorted(by_language)
        self.size = max(map(len, by_language.values()), default=0)
        self.keys = [np.asarray(by_language[n], np.int64) for n in self.names]
        self.order = [np.argsort(k) for k in self.keys]
        self.sorted = [k[o] for k, o in zip(self.keys, self.order, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        own = ranked(*ngram_counts(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        places = np.arange(len(own))
        sums = []
        for keys, order in zip(self.sorted, self.order, strict=True):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            cost = np.where(keys[at] == own, np.abs(order[at] - places), self.size)
            sums.append(int(cost.sum()))
        best = int(np.argmin(sums))
        return self.names[best], 1.0 - sums[best] / (self.size * len(own))


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, k, n): the n-grams of a language that a batch holds."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            found = [ngram_counts(t) for t in texts]
            keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "k": keys, "n": sums})


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of every language that ``docs`` labels, however many languages, from all labelled texts.

    Counting is distributed; the driver gets ``size`` integers a language.
    """
    grams = _labelled(docs, text_col, lang_col).mapInPandas(tidy(_partial_counts), "lang string, k long, n long")
    sums = grams.groupBy("lang", "k").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "k")
    top = sums.withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).select("lang", "k", "r")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.collect():
        found.setdefault(r["lang"], []).append((r["r"], r["k"]))
    return Profiles({name: [k for _, k in sorted(ks)] for name, ks in found.items()})


def _labelled(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) of the documents that have both."""
    own = small_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return own.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def low_scores(docs: DataFrame, profiles: Profiles, quantile: float, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language, a quantile of the scores of all its labelled documents that are recognized as it.

    Equal scores are counted first: they are fractions over ``size`` times a document's ranks, so their number has a bound for the task that orders a language's.
    """
    judged = _labelled(docs, text_col, lang_col).select("lang", predictor(profiles)(F.col("text")).alias("p")).where(F.col("p.lang_pred") == F.col("lang"))
    counts = judged.groupBy("lang", F.col("p.score").alias("score")).agg(F.count("*").alias("n"))
    return {r["lang"]: r["q"] for r in counts.groupBy("lang").agg(F.percentile("score", quantile, F.col("n")).alias("q")).collect()}


def predictor(profiles: Profiles):
    """A function of a text column that gives the predicted language and the score as a struct."""

    @F.pandas_udf(PREDICTION)
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([profiles.predict(t) for t in texts], columns=PREDICTION.names)
        give_back()
        return found

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the fit must not see: those whose id, as text, has a CRC-32 of remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", profiles: Profiles | None = None
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; profiles are fitted on the rows not held out."""
    if profiles is None:
        profiles = fit_profiles(docs.where(~held_out(id_col)), text_col, lang_col)
    out = small_batches(docs).select(F.col(id_col), held_out(id_col).alias("held_out"), predictor(profiles)(F.col(text_col)).alias("p"))
    return out.select(id_col, "held_out", "p.*")
