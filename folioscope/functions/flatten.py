"""What a screen reader would announce, line by line.

No text is lost, and everything that is added stands in square brackets.  Inline content joins the line of its block; a
block that opens before any text has been announced hands its marker down to its first block child.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .htmltree import Element, parse

# Fixed values of the announcement.
INLINE = frozenset(
    (
        "a",
        "abbr",
        "b",
        "bdi",
        "bdo",
        "br",
        "cite",
        "code",
        "data",
        "dfn",
        "em",
        "i",
        "img",
        "kbd",
        "mark",
        "q",
        "rp",
        "rt",
        "ruby",
        "s",
        "samp",
        "small",
        "span",
        "strong",
        "sub",
        "sup",
        "time",
        "u",
        "var",
        "wbr",
    )
)
FIELD = ("input", "textarea", "select", "button", "summary")
SILENT = ("style", "script", "template", "noscript")
MARKERS = {
    "li": "[List item]",
    "blockquote": "[Quote]",
    "label": "[Label]",
    "caption": "[Caption]",
    "figcaption": "[Caption]",
    "dt": "[Term]",
    "dd": "[Definition]",
    **{f"h{n}": f"[Heading {n}]" for n in range(1, 7)},
}
NAMES = ("alt", "aria-label", "title", "placeholder", "value")
SPAN_CAP = 1000
#: Below this depth pages are announced with their structure; deeper ones by words alone.
MAX_DEPTH = 4000

_SPACES = re.compile(r"\s+")


def squeeze(text: str) -> str:
    return _SPACES.sub(" ", text).strip()


def own_name(x: Element) -> str:
    return squeeze(x.get("aria-label") or x.get("title") or "")


def number(x: Element, attr: str) -> int:
    """A span of cells as browsers read it: the digits that the value begins with, from 1 to the cap."""
    digits = re.match(r"\s*([0-9]{0,6})", x.get(attr) or "")[1]
    return sorted((1, int(digits or 1), SPAN_CAP))[1]


# Inline content: what is said for an element, given what is said inside it


def _said_image(x: Element, inside: str) -> str:
    if x.get("alt") is None:
        return f"[Image alt] {own_name(x)}" if own_name(x) else "[Image] [alt missing]"
    return f"[Image alt] {x.get('alt')}" if x.get("alt").strip() else "[Image] [decorative, alt empty]"


def _said_field(x: Element, inside: str) -> str:
    return " ".join((f"[Field {squeeze(x.name + ' ' + (x.get('type') or ''))}]", own_name(x), x.get("placeholder") or "", x.get("value") or "", inside))


@dataclass(frozen=True)
class Kind:
    """How elements of a kind are said: of the element and its content, which content counts, and what stands between pieces of it."""

    say: Callable[[Element, str], str] = lambda x, inside: inside or own_name(x)
    content: type | tuple[type, ...] = (Element, str)
    between: str = " "


NOTHING = ()
KINDS = {
    **dict.fromkeys(FIELD, Kind(_said_field)),
    **dict.fromkeys((*SILENT, "br"), Kind(lambda x, inside: "", NOTHING)),
    "a": Kind(lambda x, inside: f"[Link] {inside or own_name(x)}"),
    "img": Kind(_said_image, NOTHING),
    "input": Kind(_said_field, NOTHING),
    "select": Kind(_said_field, Element, ", "),
}
PLAIN = Kind()


def inline(root: Element | str) -> str:
    """What is said for inline content, in one pass that leaves an element after its children and keeps its own stack."""
    said: list[list[str]] = [[]]
    ahead: list[tuple[Element | str, Kind | None]] = [(root, None)]
    while ahead:
        x, left = ahead.pop()
        if isinstance(x, Element) and left is None:
            kind = KINDS.get(x.name, PLAIN)
            said.append([])
            ahead.append((x, kind))
            ahead += [(c, None) for c in reversed(x.children) if isinstance(c, kind.content)]
            continue
        words = squeeze(left.say(x, left.between.join(said.pop())) if left else x)
        said[-1] += [words] if words else []
    return said[0][0] if said[0] else ""


def _of_table(x: Element) -> tuple[list[Element], Element | None]:
    """Rows and first caption of a table, without those of tables inside it."""
    parts, below = [], [x]
    while below:
        e = below.pop()
        parts.append(e)
        below += [c for c in reversed(e.children) if isinstance(c, Element) and c.name != "table"]
    return [e for e in parts if e.name == "tr"], next((e for e in parts if e.name == "caption"), None)


def cell(c: Element) -> str:
    wide, high = number(c, "colspan"), number(c, "rowspan")
    return squeeze(f"{inline(c) or '[empty]'} {f'[spans {wide} columns]' if wide > 1 else ''} {f'[spans {high} rows]' if high > 1 else ''}")


def table(x: Element) -> list[str]:
    rows, caption = _of_table(x)
    cells = [[c for c in r.children if isinstance(c, Element) and c.name in ("td", "th")] for r in rows]
    columns = max((sum(number(c, "colspan") for c in r) for r in cells), default=0)
    lines = [f"[Table] {inline(caption) if caption else '[no caption]'} [{len(rows)} rows, {columns} columns]"]
    for r in cells:
        lines.append(f"[{'Header row' if {c.name for c in r} == {'th'} else 'Row'}] {' | '.join(map(cell, r))}")
    return [squeeze(line) for line in lines]


class Announcer:
    def __init__(self):
        self.lines: list[str] = []

    # Blocks, with a stack of their own: [element, next child, marker not yet announced, inline pieces of the line]

    def end_line(self, frame: list) -> None:
        text = squeeze(" ".join(frame[3]))
        if frame[2] is not None:
            self.lines.append(squeeze(f"{frame[2]} {text}"))
        elif text:
            self.lines.append(text)
        frame[2], frame[3] = None, []

    def blocks(self, body: Element) -> None:
        stack: list[list] = [[body, 0, None, []]]
        while stack:
            frame = stack[-1]
            if frame[1] == len(frame[0].children):
                self.end_line(frame)
                stack.pop()
                continue
            x = frame[0].children[frame[1]]
            frame[1] += 1
            if isinstance(x, str) or x.name in INLINE:
                frame[3] += filter(None, [inline(x)])
            elif x.name in SILENT:
                continue
            elif x.name == "table" or x.name in FIELD:
                self.end_line(frame)
                self.lines += table(x) if x.name == "table" else [inline(x)]
            else:
                marker = MARKERS.get(x.name)
                if frame[2] is not None and not frame[3]:
                    marker, frame[2] = squeeze(f"{frame[2]} {marker or ''}"), None
                else:
                    self.end_line(frame)
                stack.append([x, 0, marker, []])

    def words_only(self, body: Element) -> None:
        stack: list[Element | str] = list(reversed(body.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                self.lines += filter(None, [squeeze(x)])
            elif x.name not in SILENT:
                self.lines += filter(None, (squeeze(x.get(a) or "") for a in NAMES))
                stack += reversed(x.children)


def flatten(source: str | None) -> str:
    """The announced lines of a fragment; null and empty give an empty string."""
    page, out = parse(source), Announcer()
    if page.depth > MAX_DEPTH:
        out.words_only(page.body)
    else:
        out.blocks(page.body)
    return "\n".join(out.lines)
