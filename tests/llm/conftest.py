from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or (id, text, lang), with columns whose names clash with those of results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        clashing = ("spans", "kept", "id", "text_", "n_tokens", "size", "rank", "score", "key", "license", "fingerprint", "component_id", "m", "p", "_text", "_id")
        for name in clashing:
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
