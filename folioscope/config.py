"""Configuration: environment variables in values, and the numbers a run needs.  Plain Python, read once on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")


def expand_env(value: Any, env: Mapping[str, str] = os.environ, unset: list[str] | None = None) -> Any:
    """``value`` with ``${NAME}`` replaced in every string, however deep; a name that is not set gives nothing and is recorded."""

    def one(m: re.Match) -> str:
        if m[1] not in env and unset is not None and m[1] not in unset:
            unset.append(m[1])
        return env.get(m[1], "")

    if isinstance(value, str):
        return _VARIABLE.sub(one, value)
    if isinstance(value, Mapping):
        return {k: expand_env(v, env, unset) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [expand_env(v, env, unset) for v in value]
    return value


def whole(value: Any, default: int, least: int = 1, most: int | None = None, clamp: bool = True) -> int:
    """A whole number from a setting: unusable is the default; too small the least (or the default, without ``clamp``)."""
    try:
        n = float(str(value).strip())
        n = int(n // 1)
    except (ValueError, OverflowError):
        return default
    if n < least:
        return least if clamp else default
    return n if most is None else min(n, most)


@dataclass(frozen=True)
class Settings:
    max_tokens: int = 32_000
    review_iterations: int = 3
    concurrency: int = 5
    max_concurrent_runs: int = 2

    @classmethod
    def of(cls, raw: Mapping[str, Any]) -> Settings:
        rules = {
            "max_tokens": dict(clamp=False),
            "review_iterations": {},
            "concurrency": dict(most=16),
            "max_concurrent_runs": dict(most=32),
        }
        return cls(**{f.name: whole(raw.get(f.name), f.default, **rules[f.name]) for f in fields(cls)})


def load(path: str, env: Mapping[str, str] = os.environ) -> tuple[Settings, dict[str, Any], list[str]]:
    """Settings, the whole expanded file (JSON), and the names that were not set."""
    unset: list[str] = []
    with open(path, encoding="utf-8") as f:
        raw = expand_env(json.load(f), env, unset)
    return Settings.of(raw), raw, unset
