from __future__ import annotations

import json

from folioscope.config import Settings, expand_env, load
from folioscope.functions import udfs


def test_expand_env():
    unset: list[str] = []
    value = {"a": "${X}/${Y}", "b": ["${Y}", 3, {"c": "${X}${X}"}], "d": None}
    assert expand_env(value, {"X": "1"}, unset) == {"a": "1/", "b": ["", 3, {"c": "11"}], "d": None} and unset == ["Y"]


def test_settings():
    assert Settings.of({}) == Settings()
    assert Settings.of({"max_tokens": 0, "concurrency": "99", "max_concurrent_runs": -1, "review_iterations": "x"}) == Settings(32_000, 3, 16, 1)
    assert Settings.of({"max_tokens": " 12.9 ", "review_iterations": 0, "concurrency": None}) == Settings(12, 1, 5, 2)


def test_load(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"max_tokens": "${N}", "key": "${SECRET}"}))
    settings, raw, unset = load(str(tmp_path / "c.json"), {"N": "77"})
    assert settings.max_tokens == 77 and raw["key"] == "" and unset == ["SECRET"]


def test_pdf_links_in_sql(spark):
    udfs.register(spark)
    xml = '<a href="http://e/">e</a><page number="2"><a href="http://a/?x&amp;y"><b>T</b>  u</a>'
    got = spark.sql("SELECT l.* FROM VALUES (:x) AS t(xml), LATERAL pdf_link_rows(t.xml) AS l", args={"x": xml}).collect()
    assert [tuple(r) for r in got] == [(2, "T u", "http://a/?x&y")]
