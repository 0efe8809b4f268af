"""Functions that need a tree or a scanner, as pandas UDFs, and their registration for SQL."""

from __future__ import annotations

import json
import re
import struct

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flatten as _flatten
from . import htmltree, lint

VIOLATIONS = T.ArrayType(
    T.StructType([T.StructField("id", T.StringType()), T.StructField("impact", T.StringType()), T.StructField("nodes", T.LongType())])
)
SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])

_PDF = re.compile(r'<page\b[^>]*\bnumber="([0-9]+)"|<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', re.S | re.I)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def balanced_object(text: str) -> str | None:
    """The first brace and what follows up to its match, strings and escapes minded."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def extract_json(text: str | None) -> str | None:
    """The JSON that a reply in prose holds, in canonical form: a fenced block, the whole, or its first object."""
    if text is None:
        return None
    fence = _FENCE.search(text)
    body = (fence[1] if fence else text).strip()
    for candidate in (body, balanced_object(body)):
        if candidate:
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
    return None


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, WebP or JPEG; none if unreadable or below 1."""
    found = None
    try:
        if not data:
            return None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            found = struct.unpack(">II", data[16:24])
        elif data[:6] in (b"GIF87a", b"GIF89a"):
            found = struct.unpack("<HH", data[6:10])
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            found = _webp(data)
        elif data[:2] == b"\xff\xd8":
            found = _jpeg(data)
    except (struct.error, IndexError):
        return None
    return found if found and min(found) >= 1 else None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = struct.unpack("<I", data[21:25])[0]
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(T.StringType())
def flatten_html(pages: pd.Series) -> pd.Series:
    return pages.map(_flatten.flatten)


@F.pandas_udf(T.StringType())
def decode_html_entities(texts: pd.Series) -> pd.Series:
    return pd.Series([htmltree.decode_entities(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def json_in_text(texts: pd.Series) -> pd.Series:
    return pd.Series([extract_json(t) for t in texts], dtype=object)


@F.pandas_udf(VIOLATIONS)
def lint_html(pages: pd.Series) -> pd.Series:
    return pd.Series([[{"id": i, "impact": m, "nodes": n} for i, m, n in lint.violations(p)] for p in pages], dtype=object)


@F.pandas_udf(SIZE)
def image_dimensions(images: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(x) or (None, None) for x in images], columns=["width", "height"]).astype("Int64")


@F.udtf(returnType="page: int, text: string, href: string")
class PdfLinkRows:
    """Links of one converted PDF as rows, for use in SQL; ``operators.links.pdf_links`` is the native form for tables."""

    def eval(self, xml: str):
        page = 0
        for m in _PDF.finditer(xml or ""):
            if m[1]:
                page = int(m[1])
            elif page:
                yield page, " ".join(htmltree.decode_entities(re.sub("<[^>]*>", "", m[3])).split()), htmltree.decode_entities(m[2]).strip()


REGISTERED = {
    "flatten_html": flatten_html,
    "decode_html_entities": decode_html_entities,
    "json_in_text": json_in_text,
    "lint_html": lint_html,
    "image_dimensions": image_dimensions,
}


def register(spark: SparkSession) -> None:
    """Make the functions callable in ``spark.sql``."""
    for name, f in REGISTERED.items():
        spark.udf.register(name, f)
    spark.udtf.register("pdf_link_rows", PdfLinkRows)
