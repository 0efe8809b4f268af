"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 280
SLUG_WORDS, SLUG_CHARS = 8, 60
#: Words that a slug does not end with (fixed values).
SLUG_FILLER = (
    "a",
    "an",
    "and",
    "as",
    "at",
    "but",
    "by",
    "for",
    "from",
    "in",
    "including",
    "into",
    "of",
    "on",
    "or",
    "so",
    "than",
    "that",
    "the",
    "to",
    "when",
    "which",
    "with",
)
CHUNK, OVERLAP = 24_000, 2_000
EXCERPT, SHORT_EXCERPT = 400, 200
DIFF_LINES = 80
QUOTE_CHARS = 500
MIN_COVERAGE_WORDS = 8


def squeeze(c: Column) -> Column:
    """Runs of white space, Unicode's too, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_key(c: Column) -> Column:
    """A lesson's key: lower case, anything but a-z and 0-9 a space, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def shortened(c: Column, size: int) -> Column:
    """The first ``size`` characters, with an ellipsis if there were more."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def snippet(c: Column) -> Column:
    return shortened(squeeze(c), SNIPPET)


def lesson_slug(c: Column) -> Column:
    """The first words of a key, at most 8 and 60 characters but one at least, without filler at the end.

    The key of the whole text is not made: its first words are the first runs of letters and digits, wherever they stand.  A lambda
    binds them, so that they are looked for once for a row.
    """
    head = F.regexp_extract(F.lower(c), rf"^[^a-z0-9]*+([a-z0-9]++(?:[^a-z0-9]++[a-z0-9]++){{0,{SLUG_WORDS - 1}}}+)?", 1)

    def slug(words: Column) -> Column:
        fit = F.size(F.filter(F.sequence(F.lit(1), F.size(words)), lambda n: F.length(F.array_join(F.slice(words, 1, n), " ")) <= SLUG_CHARS))
        kept = F.slice(words, 1, F.greatest(fit, F.lit(1)))
        last = F.array_max(F.transform(kept, lambda w, i: F.when((i == 0) | ~w.isin(*SLUG_FILLER), i + 1).otherwise(0)))
        return F.array_join(F.slice(kept, F.lit(1), last), " ")

    return F.get(F.transform(F.array(F.split(head, "[^a-z0-9]+")), slug), F.lit(0))


def chunks(c: Column, budget: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Overlapping pieces of a text; one that fits the budget is one piece, the empty text too."""
    stride = budget - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(stride))
    return F.when(F.length(c) <= budget, F.array(c)).otherwise(F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(budget))))


def excerpt(c: Column, size: int = EXCERPT) -> Column:
    return F.substring(squeeze(c), 1, size)


def content_words(flattened: Column) -> Column:
    """The distinct words of announced text: what stands in brackets is left out, as are words of one letter."""
    plain = F.lower(F.regexp_replace(flattened, r"\[[^\]]*\]", " "))
    return F.filter(F.array_distinct(F.split(plain, "[^a-z0-9]+")), lambda w: F.length(w) > 1)


def coverage(accepted: Column, candidate: Column) -> Column:
    """The share of accepted words that a candidate has; null if there are too few to judge.  A null candidate has no word.

    Both word lists are bound by a lambda, so that each is made once for a row.
    """

    def share(x: Column) -> Column:
        n = F.size(x["a"])
        return F.when(n >= MIN_COVERAGE_WORDS, F.size(F.array_intersect(x["a"], x["b"])) / n)

    words = F.struct(accepted.alias("a"), F.coalesce(candidate, F.array().cast("array<string>")).alias("b"))
    return F.get(F.transform(F.array(words), share), F.lit(0))


def diff_preview(before: Column, after: Column, limit: int = DIFF_LINES) -> Column:
    """Lines only one of two texts has, first those gone, then those new, and how many more there are."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    gone = F.transform(F.filter(a, lambda x: ~F.array_contains(b, x)), lambda x: F.concat(F.lit("- "), x))
    new = F.transform(F.filter(b, lambda x: ~F.array_contains(a, x)), lambda x: F.concat(F.lit("+ "), x))
    lines = F.concat(gone, new)
    more = F.concat(F.lit("… ("), (F.size(lines) - limit).cast("string"), F.lit(" more changed lines)"))
    shown = F.when(F.size(lines) > limit, F.concat(F.slice(lines, 1, limit), F.array(more))).otherwise(lines)
    return F.array_join(shown, "\n")


def fence_stripped(c: Column) -> Column:
    """What the first code fence holds, if there is one."""
    inner = F.regexp_extract(c, r"(?is)```(?:html)?\s*(.*?)```", 1)
    return F.regexp_replace(F.coalesce(F.nullif(inner, F.lit("")), c), r"^\s+|\s+$", "")


def quoted(c: Column, size: int = QUOTE_CHARS) -> Column:
    """Feedback as inline code: a fence one longer than any run of backticks in it."""
    text = shortened(squeeze(c), size)
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    return F.concat(fence, F.lit(" "), text, F.lit(" "), fence)


def unresolved_note(c: Column) -> Column:
    """Runs of hyphens, which would end an HTML comment, as a dash."""
    return F.regexp_replace(c, "--+", "—")


def file_stem(c: Column) -> Column:
    """A safe name from a path: no directory, no extension; ``document`` if nothing is left."""
    base = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    safe = F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_")
    return F.when(safe == "", F.lit("document")).otherwise(safe)


def converted_name(c: Column) -> Column:
    return F.concat(file_stem(c), F.lit("_converted.html"))


def type_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), r"\.md$", ""))


def list_block(items: Column) -> Column:
    """Lessons (array<struct<instruction, before, after>>) as a numbered list; empty without any."""

    def one(x: Column, i: Column) -> Column:
        shown = (F.coalesce(x["before"], F.lit("")) != "") & (F.coalesce(x["after"], F.lit("")) != "")
        example = F.concat(F.lit("\n   was: "), x["before"], F.lit("\n   fix: "), x["after"])
        return F.concat((i + 1).cast("string"), F.lit(". "), x["instruction"], F.when(shown, example).otherwise(F.lit("")))

    return F.array_join(F.transform(items, one), "\n")


def wrap_document(body: Column, title: Column, notes: Column) -> Column:
    """A body as a whole page; open issues stand in a comment at its end."""
    note = F.when(F.coalesce(notes, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("\n<!-- unresolved: "), unresolved_note(notes), F.lit(" -->")))
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"><title>'), title, F.lit("</title></head>\n<body>\n"))
    return F.concat(head, body, note, F.lit("\n</body>\n</html>"))
