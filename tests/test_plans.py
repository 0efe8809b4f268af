"""Plans at the store's hot spots: pruned scans, pushed filters, bounded sorts, no Python where none is needed."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from folioscope.operators import store
from folioscope.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: What needs a tree, a scanner or a fold.
PYTHON = {"q_flatten", "q_flatten_fragments", "q_lint_subset", "q_json_from_text", "q_entities", "q_image_sizes", "q_assemble", "q_in_flight_exact", "q_admitted", "q_queue_waits", "q_queue_waits_two_slots", "q_token_cache", "q_token_cache_bounded", "q_rate_decisions"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert name in PYTHON or not any(x in text for x in ("Python", "Pandas", "Arrow"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_keyset_filter_reaches_the_scan(spark, tmp_path):
    rows = [(f"{i:04}", i % 7, "queued", f"2024-01-{1 + i % 28:02}T00:00:00.000Z") for i in range(500)]
    spark.createDataFrame(rows, "session_id string, github_user_id long, status string, created_at string").write.parquet(f"{tmp_path}/s")
    df = store.list_sessions(spark.read.parquet(f"{tmp_path}/s"), 3, 20, cursor=("2024-01-10T00:00:00.000Z", "0100"))
    text = plan(df)
    assert "LessThanOrEqual(cre" in text and "EqualTo(github_user_id,3)" in text and "TakeOrderedAndProject" in text


def test_html_is_not_read_for_other_columns(spark):
    text = plan(spark.read.parquet(f"{SF}/pages.parquet").select(F.count("page_id")))
    assert "html" not in text


def test_the_rest_works_without_the_training_data_package(tmp_path):
    """A copy without that package and its pipeline imports and lists its queries."""
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text(open(f"{ROOT}/{name}").read())
    for folder, _, files in os.walk(f"{ROOT}/folioscope"):
        if "llm" in folder.split(os.sep) or "__pycache__" in folder:
            continue
        to = tmp_path / os.path.relpath(folder, ROOT)
        to.mkdir(parents=True, exist_ok=True)
        for f in files:
            (to / f).write_bytes(open(f"{folder}/{f}", "rb").read())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
