"""A documented subset of accessibility rules; the full rule pack of a browser engine is not reproduced.

Each violation is (rule, impact, number of elements).
"""

from __future__ import annotations

from collections import Counter

from .flatten import inline, own_name
from .htmltree import Element, parse

RULES = {
    "duplicate-id": "minor",
    "image-alt": "critical",
    "label": "critical",
    "link-name": "serious",
    "empty-heading": "minor",
    "heading-order": "moderate",
    "table-header": "serious",
    "html-lang": "serious",
}


def named(e: Element) -> bool:
    """Is anything said for an element: by what it holds, or by a name of its own?"""
    return any(map(inline, e.children)) or bool(own_name(e))


def violations(source: str | None) -> list[tuple[str, str, int]]:
    found: Counter[str] = Counter()
    body = parse(source).body
    elements = list(body.elements())
    ids = Counter(e.get("id") for e in elements if e.get("id"))
    found["duplicate-id"] = sum(n > 1 for n in ids.values())
    labelled = {e.get("for") for e in elements if e.name == "label"}
    level = 0
    for e in elements:
        if e.name == "img":
            found["image-alt"] += e.get("alt") is None and not own_name(e)
        elif e.name in ("input", "select", "textarea") and (e.get("type") or "").lower() not in ("hidden", "submit", "button", "reset", "image"):
            up = e.parent
            while up is not None and up.name != "label":
                up = up.parent
            found["label"] += not (own_name(e) or e.get("aria-labelledby") or up is not None or (e.get("id") and e.get("id") in labelled))
        elif e.name == "a" and e.get("href") is not None:
            found["link-name"] += not named(e)
        elif len(e.name) == 2 and e.name[0] == "h" and e.name[1] in "123456":
            found["empty-heading"] += not named(e)
            found["heading-order"] += level > 0 and int(e.name[1]) > level + 1
            level = int(e.name[1])
        elif e.name == "table":
            cells = [c for c in e.elements() if c.name in ("td", "th")]
            found["table-header"] += bool(cells) and all(c.name == "td" for c in cells)
    if source and "<html" in source[:2000].lower():
        found["html-lang"] += not body.get("lang")
    return [(rule, RULES[rule], n) for rule, n in sorted(found.items()) if n]
