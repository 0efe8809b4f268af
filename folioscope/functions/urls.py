"""URLs, references in HTML, and entities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINKS, MAX_LINK_TEXT = 40, 160
SAFE_SCHEME = r"(?i)^(https?|mailto|tel|ftps?):"
UNSAFE = r"[\"'<>`\s\x00-\x1f\x7f]"
_HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_PIECE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z]+);|[^&]+|&"


def decode_entities(c: Column) -> Column:
    """Five named and all numeric references, decoded in one pass over the pieces between them."""

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
        base = F.when(p.rlike("^&#[xX]"), 16).otherwise(10)
        short = F.regexp_replace(digits, "^0+", "")
        code = F.when(F.length(short) <= 8, F.when(base == 16, F.conv(short, 16, 10)).otherwise(short)).try_cast("long")
        good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        name = F.lower(p)
        return (
            F.when(~p.startswith("&") | (F.length(p) < 3), p)
            .when(name == "&amp;", "&")
            .when(name == "&lt;", "<")
            .when(name == "&gt;", ">")
            .when(name == "&quot;", '"')
            .when(name == "&apos;", "'")
            .when((digits != "") & good, char)
            .otherwise(p)
        )

    pieces = F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), one)
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def normalize_href(c: Column) -> Column:
    """Entities decoded, trimmed, the scheme in lower case, no slash at the end."""
    plain = F.trim(decode_entities(c))
    scheme = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.regexp_replace(F.concat(F.lower(scheme), F.substring(plain, F.length(scheme) + 1, F.length(plain))), "/+$", "")


def raw_hrefs(html: Column) -> Column:
    """All values of href attributes by a scan, in order, with repeats."""
    double, single, bare = (F.regexp_extract_all(html, F.lit(_HREF), F.lit(g)) for g in (1, 2, 3))
    return F.transform(double, lambda d, i: F.when(d != "", d).when(F.get(single, i) != "", F.get(single, i)).otherwise(F.coalesce(F.get(bare, i), F.lit(""))))


def hrefs(html: Column) -> Column:
    """The distinct normalized hrefs of a fragment."""
    return F.array_distinct(F.transform(raw_hrefs(html), normalize_href))


def is_absolute(c: Column) -> Column:
    return c.rlike(r"(?i)^[a-z][a-z0-9+.-]*:")


def absolute_hrefs(html: Column) -> Column:
    return F.filter(hrefs(html), is_absolute)


def dropped_hrefs(before: Column, after: Column) -> Column:
    """Absolute hrefs that a rewrite lost, sorted."""
    return F.sort_array(F.array_except(absolute_hrefs(before), hrefs(after)))


def repo_of(url: Column) -> Column:
    """struct<owner, repo> of a repository URL; null if it is none."""
    pattern = r"github\.com[/:]([^/]+)/([^/#?]+?)(?:\.git)?/?$"
    owner, repo = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.when(owner != "", F.struct(owner.alias("owner"), repo.alias("repo")))


def bearer_token(header: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(header, r"(?i)^Bearer\s+(.+)$", 1)), F.lit(""))


def client_key(token: Column, address: Column) -> Column:
    """A validated token's client by its digest, any other by address."""
    return F.when(token.isNotNull(), F.concat(F.lit("t:"), F.substring(F.sha2(token, 256), 1, 16))).otherwise(F.concat(F.lit("ip:"), address))
