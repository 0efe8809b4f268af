"""Table schemas of the document-conversion store, its run log and its page tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    out = T.StructType()
    for item in spec.split(","):
        name, kind = item.split()
        out.add(name, kinds[kind.rstrip("!")], not kind.endswith("!"))
    return out


USERS = _struct("github_user_id long!, github_login string!, max_review_iterations long!, created_at string!")
SESSIONS = _struct(
    "session_id string!, github_user_id long!, status string!, phase string!, iterations_completed long!, iterations_max long!,"
    "image_count long!, error string, created_at string!, updated_at string!, first_completed_at string"
)
RUN_SIGNALS = _struct("session_id string!, code string!, impact string, count long!, recorded_at string!")
LOG_EVENT = _struct(
    "ts string, type string, phase string, agent string, model string, provider string, capability string, duration_ms long, ok boolean,"
    "error string, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, waited_ms long"
)
LINK = T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())])

#: Values of the status and phase columns.
STATUSES = ("queued", "running", "ready_for_review", "closed", "failed")
PHASES = ("extraction", "assembly", "review", "done")
#: Columns that only a store of an older kind has; such a store is refused.
LEGACY_USER_COLUMNS = ("github_token", "fork_repo")


class LegacySchemaError(ValueError):
    """A users table that still holds credentials."""


def refuse_legacy_users(columns: list[str]) -> None:
    """Raise before anything is written if a users table has legacy columns."""
    found = [c for c in LEGACY_USER_COLUMNS if c in columns]
    if found:
        raise LegacySchemaError(f"users has legacy columns {found}; start with a new store")
