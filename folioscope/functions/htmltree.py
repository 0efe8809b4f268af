"""HTML fragments as tokens and as a tree; pure Python, no Spark.

The tokenizer keeps source positions of attribute values, so ids and references can be rewritten in place and the rest of a
page stays byte for byte as it was.  The tree follows the common part of HTML's rules: void and raw-text elements, ends
that a following tag implies, a body inserted into tables.  What needs foster parenting or the adoption
agency is built as written and marked as not rewritable.  Nothing recurses, so depth is no limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: What a start tag ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
}
IN_TABLE = {
    "table": frozenset("caption colgroup col thead tbody tfoot tr script style template".split()),
    "thead": frozenset("tr script style template".split()),
    "tbody": frozenset("tr script style template".split()),
    "tfoot": frozenset("tr script style template".split()),
    "tr": frozenset("td th script style template".split()),
}
OPTIONAL_END = frozenset("p li dt dd option optgroup tr td th tbody thead tfoot colgroup caption".split())
MAX_NESTING = 500

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


@dataclass
class Attr:
    """An attribute: decoded value, and where its raw value stands in the source (nowhere if it has none)."""

    name: str
    value: str
    start: int = -1
    end: int = -1


@dataclass
class Token:
    kind: str  # text, start or end
    name: str = ""
    text: str = ""
    attrs: list[Attr] = field(default_factory=list)


def tokens(source: str) -> Iterator[Token]:
    """Text, start and end tags in order; comments and declarations are left out, text is decoded."""
    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        if m is None:
            break
        if m.start() > at:
            yield Token("text", text=html.unescape(source[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            yield Token("end", name)
            continue
        attrs: dict[str, Attr] = {}
        for a in _ATTR.finditer(source, m.start(3), m.end(3)):
            group = next((g for g in (2, 3, 4) if a[g] is not None), 0)
            value = html.unescape(a[group]) if group else ""
            attrs.setdefault(a[1].lower(), Attr(a[1].lower(), value, *(a.span(group) if group else (-1, -1))))
        yield Token("start", name, attrs=list(attrs.values()))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            raw = source[at : end.start() if end else len(source)]
            if raw:
                yield Token("text", text=html.unescape(raw) if name in ("textarea", "title") else raw)
            yield Token("end", name)
            at = end.end() if end else len(source)
    if at < len(source):
        yield Token("text", text=html.unescape(source[at:]))


class Element:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.name, self.attrs, self.parent = name, attrs or {}, parent
        self.children: list[Element | str] = []

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            x = stack.pop()
            yield x
            stack += [c for c in reversed(x.children) if isinstance(c, Element)]


@dataclass
class Page:
    body: Element
    depth: int
    rewritable: bool


def parse(source: str | None) -> Page:
    """A fragment as the children of a body."""
    body = Element("body")
    here, level, deepest, clean = body, 0, 0, True
    for t in tokens(source or ""):
        if t.kind == "text":
            if here.name in IN_TABLE and t.text.strip():
                clean = False
            here.children.append(t.text)
        elif t.kind == "start":
            if t.name in ("html", "body", "head"):
                body.attrs |= {a.name: a.value for a in t.attrs if t.name != "head" and a.name not in body.attrs}
                continue
            ends, stop = IMPLIED.get(t.name, ((), ()))
            if t.name in CLOSES_P:
                ends, stop = ("p",), ("table", "td", "th", "caption", "button", "object")
            x, up, found = here, 0, None
            while ends and x is not body and x.name not in stop:
                up += 1
                if x.name in ends:
                    found = (x.parent, up)
                x = x.parent
            if found:
                here, level = found[0], level - found[1]
            if t.name == "tr" and here.name == "table":
                made = Element("tbody", {}, here)
                here.children.append(made)
                here, level = made, level + 1
            if here.name in IN_TABLE and t.name not in IN_TABLE[here.name]:
                clean = False
            made = Element(t.name, {a.name: a.value for a in t.attrs}, here)
            here.children.append(made)
            if t.name not in VOID:
                here, level = made, level + 1
                deepest = max(deepest, level)
        else:
            x, up = here, 0
            while x is not body and x.name != t.name:
                up += 1
                x = x.parent
            if x is body:
                clean &= t.name in ("html", "body", "head", "p", "br")
                continue
            y = here
            while y is not x:
                clean &= y.name in OPTIONAL_END
                y = y.parent
            here, level = x.parent, level - up - 1
    while here is not body:
        clean &= here.name in OPTIONAL_END
        here = here.parent
    return Page(body, deepest, clean and deepest <= MAX_NESTING)


_ENTITY = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9A-Fa-f]+)|([A-Za-z]+));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _entity(m: re.Match) -> str:
    if m[3]:
        return _NAMED.get(m[3].lower(), m[0])
    digits, base = (m[1], 10) if m[1] else (m[2], 16)
    digits = digits.lstrip("0") or "0"
    code = int(digits, base) if len(digits) <= 8 else 0x110000
    return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]


def decode_entities(text: str | None) -> str | None:
    """Five named and all numeric references, in one pass; any other stays as written."""
    return None if text is None else _ENTITY.sub(_entity, text)
