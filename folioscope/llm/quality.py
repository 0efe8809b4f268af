"""Quality rules as a bitmask ledger.

Each rule is evaluated once for each document.  The ledger row holds the measurements and one bit for each
failed rule.  A policy is a named, versioned set of rules; applying one is a bitwise AND, so a new policy
or an ablation reads the ledger only, never the texts.

Words are runs of characters other than space and the control characters 9 to 13.  Null text has no words.
A document fails ``few_words`` below 50 words, so empty and null texts fail.  Repeated rows are judged
alike, empty tables give empty results, and columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\v\f\r "

#: Measurements of a document.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (over the measurements) is true; ``bit`` is its place in the ledger."""

    bit: int
    name: str
    fails: str


#: Bits are never given to another rule; a changed rule gets a new one.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeat_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "dup_lines", "n_lines >= 10 AND 2 * n_dup_lines > n_lines"),
    Rule(4, "shouting", "10 * n_shouts > 3 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "short_words", "word_chars < 2 * n_words"),
)

#: Policies by version: the names of the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeat_words"),
    "web-1": tuple(r.name for r in RULES),
}

LEDGER_TYPE = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()  # on bytes: exactly the six characters of SPACES
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    shouts = text.count("!")
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        shouts,
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words that the text has twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    index: dict[tuple, int] = {}
    ids = [index.setdefault(w, len(index)) for w in windows]
    if len(index) == len(ids):
        return 0
    ids = np.asarray(ids)
    again = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


@F.pandas_udf(LEDGER_TYPE)
def _measure(texts: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")
    give_back()
    return found


def failure_bits(rules: Iterable[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def policy_mask(policy: str | Iterable[str]) -> int:
    names = set(POLICIES[policy] if isinstance(policy, str) else policy)
    unknown = names - {r.name for r in RULES}
    if unknown:
        raise ValueError(f"no such rules: {sorted(unknown)}")
    return sum(1 << r.bit for r in RULES if r.name in names)


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the measurements, and ``failed_bits``."""
    measured = small_batches(docs).select(F.col(id_col), _measure(F.col(text_col)).alias("m")).select(id_col, "m.*")
    return measured.withColumn("failed_bits", failure_bits())


def passes(policy: str | Iterable[str], bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def measured_quality(text: Column) -> Column:
    """The measurements of a text column as a struct, for filters that keep the row's own columns."""
    return _measure(text)


def ablations(ledger: DataFrame, policy: str | Iterable[str]) -> DataFrame:
    """For each rule of a policy: rows it fails, and rows that only it rejects.

    One scan and one row from each task: counts of bitwise tests.  An empty ledger gives zeros.
    """
    mask = policy_mask(policy)
    rules = [r for r in RULES if mask >> r.bit & 1]
    own = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    counts = [F.count("*").alias("rows"), F.count(F.when(own != 0, 1)).alias("rejected")]
    for r in rules:
        one = 1 << r.bit
        counts += [
            F.count(F.when(own.bitwiseAND(F.lit(one).cast("long")) != 0, 1)).alias(f"fails_{r.name}"),
            F.count(F.when(own == one, 1)).alias(f"only_{r.name}"),
        ]
    total = ledger.agg(*counts)
    rows = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.col(f"fails_{r.name}").alias("fails"),
                    F.col(f"only_{r.name}").alias("only"),
                    (F.col("rejected") - F.col(f"only_{r.name}")).alias("rejected_without"),
                )
                for r in rules
            )
        )
    )
    return total.select("rows", "rejected", rows.alias("r")).select("rows", "rejected", "r.*")
