"""Secret scan: keyword automaton, anchored patterns near its hits, checksum validation.

One pass of an Aho-Corasick automaton over the lower-cased text finds every place where a credential
can begin.  Only there is an anchored pattern tried.  Credentials that carry a checksum in themselves
are reported only if it holds.  Runs of hexadecimal digits have no keyword; one linear pattern finds them.

Kinds, in the order used for ties:

``assign``  a credential word, ``:`` or ``=``, and a value of 12 or more characters
``access``  an access key id of 18 or more characters
``hex``     16 or more lower-case hexadecimal digits
``hosted``  a source-hosting token (``ghp_`` and its sisters) whose last six characters are the CRC-32 of
            the thirty before, in base 62
``package`` a package-registry token (``npm_``) with the same checksum

Null text counts as empty and gives no spans.  Empty tables give empty results.  Repeated rows are
scanned one by one.  Only the id and the text column are read; other columns, whatever their names, are
ignored.  Time is linear in the length of a text.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Span, give_back, sha256_hex, small_batches, span_text

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "hosted", "package")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HOSTED = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
PACKAGE = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN_MIN, ACCESS_MIN = 12, 18

CUES = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "hosted",
    "gho_": "hosted",
    "ghu_": "hosted",
    "ghs_": "hosted",
    "ghr_": "hosted",
    "npm_": "package",
}

SCAN_TYPE = T.StructType(
    [
        T.StructField("n_assign", T.LongType(), False),
        T.StructField("n_access", T.LongType(), False),
        T.StructField("n_hex", T.LongType(), False),
        T.StructField("base_sha256", T.StringType(), False),
        T.StructField("spans", T.StringType(), False),
    ]
)


SPANS_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in CUES.items():
        made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def checksum_holds(body: str) -> bool:
    return base62_crc(body[:30]) == body[30:]


def find_spans(text: str | None) -> list[Span]:
    """All spans of one whole text, as (kind, start, end) in code points, end exclusive."""
    if not text:
        return []
    # Only this letter changes its length in lower case; hits are checked against the text itself.
    low = (text.replace("İ", "i") if "İ" in text else text).lower()
    ends, spans = dict.fromkeys(KINDS, 0), []
    for start, kind in sorted((end - size + 1, kind) for end, (size, kind) in automaton().iter(low)):
        if start < ends[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and m.end(2) - m.start(2) >= ASSIGN_MIN
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and m.end() - start >= ACCESS_MIN
        else:
            m = (HOSTED if kind == "hosted" else PACKAGE).match(text, start)
            good = m and checksum_holds(m[1])
        if m:
            ends[kind] = m.end()
        if good:
            spans.append((kind, start, m.end()))
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def summary(spans: list[Span]) -> tuple:
    base = [s for s in spans if s[0] in BASE_KINDS]
    counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
    return (*counts, sha256_hex(span_text(base, KINDS)), span_text(spans, KINDS))


@F.pandas_udf(SCAN_TYPE)
def _scan(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([summary(find_spans(t)) for t in texts], columns=SCAN_TYPE.names)


@F.pandas_udf(SPANS_TYPE)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in texts], dtype=object)


def mask(text: str | None, filler: str = "[SECRET]") -> str | None:
    """``text`` with each stretch of touching or overlapping spans replaced by ``filler``; null stays null."""
    if text is None:
        return None
    parts, at = [], 0
    for start, end in merged(find_spans(text)):
        parts += [text[at:start], filler]
        at = end
    return "".join(parts) + text[at:]


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


@F.pandas_udf(T.StringType())
def masked(texts: pd.Series) -> pd.Series:
    found = pd.Series([mask(t) for t in texts], dtype=object)
    give_back()
    return found


def secret_spans(text: Column) -> Column:
    """The spans of a text column as ``array<struct<kind,start,end>>``."""
    return _spans(text)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts of the base kinds, their digest, and all spans."""
    found = small_batches(docs).select(F.col(id_col), _scan(F.col(text_col)).alias("found"))
    return found.select(id_col, "found.*")
