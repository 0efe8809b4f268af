"""Ids and references of page fragments, and their rewriting in place; pure Python, no Spark.

Values are replaced where they stand in the source, so the rest of a page stays byte for byte as it was.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from .htmltree import parse, tokens

# The attributes that refer to ids, besides href="#…".
REFERENCE_ATTRIBUTES = (
    "for",
    "form",
    "list",
    "headers",
    "aria-labelledby",
    "aria-describedby",
    "aria-details",
    "aria-errormessage",
    "aria-controls",
    "aria-owns",
    "aria-flowto",
    "aria-activedescendant",
)


def assigned(names: tuple[str, ...], value: str = "") -> str:
    """A pattern, for Python and Java, of an assignment to one of the attributes, of a value that begins with ``value``."""
    return rf"[^\w-](?:{'|'.join(names)})\s*=\s*{value}"


#: What a page with ids holds, and one with references.  A character reference may stand for a link's number sign.
ID_PATTERN = "(?i)" + assigned(("id",))
REFERENCE_PATTERN = "(?i)" + assigned(REFERENCE_ATTRIBUTES) + "|" + assigned(("href",), "[\"']?[&#]")

_MAY_HAVE_ID, _MAY_REFER = re.compile(ID_PATTERN), re.compile(REFERENCE_PATTERN)


def may_have_ids(source: str) -> bool:
    return _MAY_HAVE_ID.search(source) is not None


def may_have_references(source: str) -> bool:
    return _MAY_REFER.search(source) is not None


def page_ids(source: str) -> list[str]:
    """The ids of a page in order, repeats included."""
    return [a.value for t in tokens(source) if t.kind == "start" for a in t.attrs if a.name == "id" and a.value]


def page_references(source: str) -> list[tuple[str, str]]:
    """(attribute, id) of all references of a page in order."""
    out = []
    for t in tokens(source):
        for a in t.attrs:
            if a.name == "href" and a.value.startswith("#"):
                out.append(("href", a.value[1:]))
            elif a.name in REFERENCE_ATTRIBUTES:
                out += [(a.name, x) for x in a.value.split()]
    return out


def rewritten(source: str, new_id: Callable[[str], str], target: Callable[[str], str]) -> str:
    """``source`` with ids and references renamed; a value that stays the same is not touched."""
    parts, at = [], 0
    for t in tokens(source):
        for a in sorted(t.attrs, key=lambda a: a.start):
            if a.start < 0:
                continue
            if a.name == "id":
                value = new_id(a.value)
            elif a.name == "href" and a.value.startswith("#"):
                value = "#" + target(a.value[1:])
            elif a.name in REFERENCE_ATTRIBUTES:
                value = " ".join(map(target, a.value.split()))
            else:
                continue
            if value != a.value:
                bare = source[a.start - 1] not in "\"'"
                safe = html.escape(value, quote=True)
                parts += [source[at : a.start], f'"{safe}"' if bare and re.search(r"[\s=<>`]", safe) else safe]
                at = a.end
    return "".join([*parts, source[at:]])


def page_labels(orders: Iterable[int]) -> list[str]:
    """``p<order>`` of each page; a repeat gets ``_2``, ``_3`` and so on."""
    seen: dict[int, int] = {}
    out = []
    for o in orders:
        seen[o] = seen.get(o, 0) + 1
        out.append(f"p{o}" if seen[o] == 1 else f"p{o}_{seen[o]}")
    return out


def separator(ids: Iterable[str], labels: Iterable[str]) -> str:
    """The shortest run of hyphens that makes no prefix of a label the beginning of an id."""
    longest, names = 0, set(labels)
    for i in ids:
        for m in re.finditer("-+", i):
            if i[: m.start()] in names:
                longest = max(longest, len(m[0]))
    return "-" * (longest + 1)


@dataclass
class Assembly:
    pages: list[str]
    collisions: list[str] = field(default_factory=list)
    pinned: list[str] = field(default_factory=list)
    ambiguous: list[tuple[int, str]] = field(default_factory=list)
    skipped: list[int] = field(default_factory=list)


def namespace_pages(pages: list[tuple[int, str]]) -> Assembly:
    """Pages (order, source) of one document, in document order, with ids that several pages claim made unique.

    A page owns its copy of an id; a reference to an id that its page does not own goes to the first page that has it.
    Pages that cannot be rewritten safely stay as they are: their ids stay bare, and an id that only they refer to
    stays bare on its first owner.
    """
    sources = [s for _, s in pages]
    owned = [set(page_ids(s)) if may_have_ids(s) else set() for s in sources]
    owners: dict[str, list[int]] = {}
    for i, ids in enumerate(owned):
        for x in ids:
            owners.setdefault(x, []).append(i)
    shared = {x for x, pages_of in owners.items() if len(pages_of) > 1}
    result = Assembly(sources, sorted(shared))
    if not shared:
        return result
    labels = page_labels(o for o, _ in pages)
    sep = separator(owners, labels)
    foreign = [{t for _, t in page_references(s) if t in shared} - owned[i] if may_have_references(s) else set() for i, s in enumerate(sources)]
    busy = [i for i in range(len(pages)) if owned[i] & shared or foreign[i]]
    result.ambiguous = sorted((pages[i][0], t) for i in busy for t in foreign[i])
    frozen = {i for i in busy if not parse(sources[i]).rewritable}
    result.skipped = sorted(pages[i][0] for i in frozen)
    pinned = {t for i in frozen for t in foreign[i] if not frozen.intersection(owners[t])}
    result.pinned = sorted(pinned)

    def renamed(page: int, x: str) -> str:
        if x not in shared or page in frozen or (x in pinned and page == owners[x][0]):
            return x
        return f"{labels[page]}{sep}{x}"

    out = list(sources)
    for i in busy:
        if i not in frozen:
            mine = owned[i]
            out[i] = rewritten(
                sources[i],
                lambda x, i=i: renamed(i, x),
                lambda x, i=i, mine=mine: renamed(i if x in mine else owners[x][0], x) if x in shared else x,
            )
    result.pages = out
    return result
