"""Personal data: an automaton finds anchors, local parsers expand each into exact boundaries.

An Aho-Corasick pass over the text stops at at-signs, scheme marks and identifier cues (digits, plus
signs).  From each stop a deterministic parser walks left and right to the boundary and validates what it
finds.  Each kind advances past what it has consumed, so time is linear in the text.

Kinds, in order: ``email``; ``ip`` (four parts of at most 255); ``card`` (16 to 19 digits that pass Luhn);
``phone`` (a plus and 8 to 15 digits); then those the method adds: ``login`` (user and password inside a
URL authority) and ``iban`` (an account number whose remainder by 97 is 1).

Null text counts as empty and gives no spans.  Empty tables give empty results.  Repeated rows are
scanned one by one.  Only the id and the text column are read; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Span, sha256_hex, small_batches, span_text_by_kind

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SEPARATED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RUN = re.compile(r"[\x20().0-9-]+")
LOGIN = re.compile(r"[^\x00-\x20/?#@:]+:[^\x00-\x20/?#@]+@")
#: How many characters an account number of a country has (fixed values of the public registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
ACCOUNT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

SCAN_TYPE = T.StructType(
    [
        *(T.StructField(f"n_{k}", T.LongType(), False) for k in BASE_KINDS),
        T.StructField("base_sha256", T.StringType(), False),
        T.StructField("spans", T.StringType(), False),
    ]
)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for cue, kind in {"@": "email", "+": "phone", "://": "login"}.items():
        made.add_word(cue, (len(cue), kind))
    for d in DIGITS:
        made.add_word(d, (1, "digit"))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_end(text: str, start: int) -> int:
    """Where the account number that begins at ``start`` ends, by the length of its country; -1 if there is none.

    A space may stand between groups of four.
    """
    compact, at = "", start
    for _ in range(IBAN_LENGTHS.get(text[start : start + 2], 0)):
        if text[at : at + 1] == " " and compact and len(compact) % 4 == 0:
            at += 1
        if text[at : at + 1] not in ACCOUNT:
            return -1
        compact += text[at]
        at += 1
    followed = text[at : at + 1]
    return at if compact and iban_holds(compact) and not (followed.isascii() and followed.isalnum()) else -1


def iban_holds(compact: str) -> bool:
    return compact[2:4].isdecimal() and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def small(part: str) -> bool:
    """A run of digits that is at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


class Parsers:
    """The parsers of one text; each remembers where it has got to."""

    def __init__(self, text: str):
        self.text, self.found = text, []
        self.mail = self.chain = self.card = self.phone = self.iban = 0

    def email(self, at: int) -> None:
        start, text = at, self.text
        if at < self.mail:
            return
        while start > self.mail and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        # Without a match, nothing left of this at-sign can begin a later address.
        self.mail = m.end() if m else at + 1
        if m:
            self.found.append(("email", start, m.end()))

    def digit(self, at: int) -> None:
        if at >= self.chain:
            m = CHAIN.match(self.text, at)
            self.chain = m.end()
            parts, pos = m[0].split("."), at
            for i in range(0, len(parts) - 3, 4):
                size = len(".".join(parts[i : i + 4]))
                if all(map(small, parts[i : i + 4])):
                    self.found.append(("ip", pos, pos + size))
                pos += size + 1
        if at >= self.card:
            m = SEPARATED.match(self.text, at)
            self.card = m.end() if m else at + 1
            if m and m.end() - at >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.found.append(("card", at, m.end()))
        if at >= self.iban and at >= 2 and self.text[at - 2 : at].isascii() and self.text[at - 2 : at].isupper():
            end = -1 if at > 2 and self.text[at - 3].isalnum() else iban_end(self.text, at - 2)
            if end > 0:
                self.found.append(("iban", at - 2, end))
                self.iban = end

    def phone_at(self, at: int) -> None:
        text = self.text
        if text[at + 1 : at + 2] not in DIGITS or at + 1 >= len(text):
            return
        m = PHONE_RUN.match(text, at + 2)
        if not m:
            return
        end = at + 2 + len(m[0].rstrip(" ().-"))
        if end >= at + 4 and 8 <= sum(c in DIGITS for c in text[at + 1 : end]) <= 15:
            self.found.append(("phone", at, end))

    def login(self, start: int, size: int) -> None:
        m = LOGIN.match(self.text, start + size)
        if m:
            self.found.append(("login", m.start(), m.end() - 1))


def find_spans(text: str | None) -> list[Span]:
    """All spans of one whole text, as (kind, start, end) in code points, end exclusive."""
    if not text:
        return []
    parsers = Parsers(text)
    for end, (size, kind) in automaton().iter(text):
        if kind == "digit":
            if end >= parsers.chain or end >= parsers.card:
                parsers.digit(end)
        elif kind == "email":
            parsers.email(end)
        elif kind == "phone":
            parsers.phone_at(end)
        else:
            parsers.login(end - size + 1, size)
    return parsers.found


def summary(spans: list[Span]) -> tuple:
    base = [s for s in spans if s[0] in BASE_KINDS]
    counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
    return (*counts, sha256_hex(span_text_by_kind(base, KINDS)), span_text_by_kind(spans, KINDS))


@F.pandas_udf(SCAN_TYPE)
def _scan(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([summary(find_spans(t)) for t in texts], columns=SCAN_TYPE.names)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, counts of the base kinds, their digest, and all spans."""
    return small_batches(docs).select(F.col(id_col), _scan(F.col(text_col)).alias("found")).select(id_col, "found.*")
