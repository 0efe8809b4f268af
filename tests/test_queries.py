"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__
from folioscope.functions.text import SLUG_FILLER
from folioscope.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


def normal(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    got, names = df.collect(), df.columns
    rel = db.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(names)
    want = normal(rel.fetchall(), rel.columns, sorted(names))
    assert normal(got, names, sorted(names)) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["code", "impact", "documents", "nodes", "share"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_texts(spark, tmp_path):
    rows = [(0, "*" * 300 + " Keep the Alt Text of every figure", "fr"), (1, "word " * 100 + "End!", "en"), (2, "x" * 80 + " y", "de"), (3, None, "en"), (4, "b" * 50, "en"), (6, "c" * 70, None), (7, "Ask for the", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: QUERIES[f"q_{n}_whole"](spark, str(tmp_path)).collect() for n in ("norm_key", "lesson_slug", "capture_fixtures")}
    keys = {i: t if t is None else " ".join(re.sub(r"[^a-z0-9\s]", " ", t.lower()).split()) for i, t, _ in rows}
    assert {r.doc_id: r.norm_key for r in got["norm_key"]} == keys

    def slug(key):
        words = key.split(" ")[:8]
        while len(words) > 1 and len(" ".join(words)) > 60:
            words.pop()
        while len(words) > 1 and words[-1] in SLUG_FILLER:
            words.pop()
        return " ".join(words)

    assert {r.doc_id: r.slug for r in got["lesson_slug"] if r.doc_id != 3} == {i: slug(k) for i, k in keys.items() if k is not None}
    fixtures = {(r.session, r.agent, r.image): r.accepted_html for r in got["capture_fixtures"]}
    text = {i: t for i, t, _ in rows}
    assert fixtures == {(0, "fr", "0"): text[0], (0, "en", "1"): text[1], (0, "de", "0"): text[2], (1, "en", "1"): text[7]}


@pytest.mark.parametrize("name", ["q_coverage", "q_fixture_scores", "q_regression_gate"])
def test_candidate_is_missing(spark, tmp_path, name):
    """The text after is null, or no document comes after."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota"
    texts = {1: words, 2: None, 5: words, 9: words, 13: "too few", 16: None, 21: words, 22: "", 25: words, 26: words + " kappa", 33: words, 34: None}
    data = [(i, t, "en", f"s{i % 3}") for i, t in texts.items()]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, rel = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
    assert normal(df.collect(), df.columns, sorted(df.columns)) == normal(rel.fetchall(), rel.columns, sorted(df.columns))
