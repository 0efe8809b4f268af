"""Helpers that the training-data operators share."""

from __future__ import annotations

import pandas as pd
import pytest

from folioscope.llm import common, quality


def test_batches_are_bounded_in_rows_and_bytes(spark):
    """A worker gets few rows at a time where texts are long, and every row arrives."""
    long = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('many words ', 100000) AS text")
    sizes = lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    found = [r.n for r in common.small_batches(long).mapInPandas(sizes, "n long").collect()]
    assert sum(found) == 40 and max(found) < 10
    assert quality.rule_ledger(long.withColumnRenamed("id", "doc_id")).where("n_words = 200000").count() == 40


def test_tidy_passes_all_batches_on():
    assert list(common.tidy(lambda xs: (x + 1 for x in xs))(iter([1, 2]))) == [2, 3]


def test_no_temporary_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
