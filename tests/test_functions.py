"""Scalar functions and trees on edge rows."""

from __future__ import annotations

import re
import struct

import pytest
from pyspark.sql import functions as F

from folioscope.functions import anchors, limits, text, udfs, urls
from folioscope.functions.flatten import MAX_DEPTH, SILENT, flatten
from folioscope.functions.htmltree import Element, decode_entities, parse
from folioscope.functions.lint import violations


def values(spark, column, rows, kind="string"):
    """A function of one column over rows, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, text.squeeze, ["  a \n b ", "", None]) == ["a b", "", None]
    assert values(spark, text.norm_key, ["Use ALT-text, please!", "…", ""]) == ["use alt text please", "", ""]
    long = "keep every single word of this rather long instruction about tables and the"
    assert values(spark, text.lesson_slug, [long, "a of the", "x" * 90, "fix the table for"]) == ["keep every single word of this rather long", "a", "x" * 90, "fix the table"]
    assert values(spark, text.snippet, ["a" * 281, "b" * 280]) == ["a" * 280 + "…", "b" * 280]
    got = values(spark, text.chunks, ["", "a" * 24_000, "b" * 24_001, "c" * 44_000])
    assert [[len(p) for p in c] for c in got] == [[0], [24_000], [24_000, 2_001], [24_000, 22_000]]
    assert values(spark, text.fence_stripped, ["x ```html\n<p>a</p>\n``` y", "plain", "``````"]) == ["<p>a</p>", "plain", "``````"]
    assert values(spark, text.quoted, ["a `b` ``c``", "plain"]) == ["``` a `b` ``c`` ```", "` plain `"]
    assert values(spark, text.file_stem, ["a/b c.pdf", "x\\y.tar.gz", ".pdf", "", "é.png"]) == ["b_c", "y.tar", "document", "document", "_"]
    assert values(spark, text.type_name, [" Table.md ", "chart", ".md"]) == ["Table", "chart", ""]
    assert values(spark, text.unresolved_note, ["a -- b --- c - d"]) == ["a — b — c - d"]


def test_slug_looks_at_a_text_once(spark):
    plan = spark.range(1).select(text.lesson_slug(F.col("id").cast("string")).alias("slug"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") == 1
    far = "! " * 200_000 + "Fix THE\ttable-for"
    assert values(spark, text.lesson_slug, [far, "é" * 50_000 + "a", "a " * 50_000, "", "!?", None]) == ["fix the table", "a", "a", "", "", None]


def test_coverage(spark):
    rows = [("one two three four five six seven eight nine", "nine eight seven six five four three two one more"), ("one two three four five six seven eight", "one two three four"), ("too few words here", "too few"),
            ("[Heading 1] one two three four five six seven eight", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.c for r in df.select(text.coverage(text.content_words(F.col("a")), text.content_words(F.col("b"))).alias("c")).collect()]
    assert got == [1.0, 0.5, None, 0.0]


def test_diff_preview(spark):
    df = spark.createDataFrame([("a\nb\nb\nc", "c\nd"), ("\n".join(f"x{i}" for i in range(100)), "")], "a string, b string")
    one, two = (r.d for r in df.select(text.diff_preview(F.col("a"), F.col("b")).alias("d")).collect())
    assert one == "- a\n- b\n- b\n+ d"
    assert two.split("\n")[-1] == "… (21 more changed lines)" and len(two.split("\n")) == 81


ENTITIES = ["&amp;lt;", "&#38;amp;", "&LT;&Quot;", "&#x1F600;", "&#0;", "&#xD800;", "&#1114112;", "&constructor;", "&", "&;", "a&b;c", "&#99999999999999999999;", "&#x;", "", "&apos", "&#00065;"]


def test_entities_in_one_pass(spark):
    want = [decode_entities(e) for e in ENTITIES]
    assert want[:8] == ["&lt;", "&amp;", '<"', "😀", "&#0;", "&#xD800;", "&#1114112;", "&constructor;"] and want[-1] == "A"
    assert values(spark, urls.decode_entities, ENTITIES) == want
    assert decode_entities(None) is None


def test_urls(spark):
    assert values(spark, urls.normalize_href, ["HTTPS://A.b/C//", " mailto:X@y ", "a&amp;b/", "#x"]) == ["https://A.b/C", "mailto:X@y", "a&b", "#x"]
    html = "<a href=\"HTTP://a/\">x</a><a HREF = 'b&amp;c'>y</a><a href=d>z</a><a data-href=\"e/\"></a><a href=\"\">w</a><a href=\"http://a\">v</a>"
    assert values(spark, urls.hrefs, [html, "", None]) == [["http://a", "b&c", "d", "e", ""], [], None]
    assert values(spark, urls.is_absolute, ["http:x", "MAILTO:a", "//x", "a/b:c", "1a:b"]) == [True, True, False, False, False]
    assert values(spark, urls.bearer_token, ["Bearer  abc ", "bearer x y", "Basic z", "", None]) == ["abc", "x y", None, None, None]
    assert values(spark, lambda c: urls.repo_of(c)["repo"], ["https://github.com/a/b.git", "git@github.com:a/c", "x"]) == ["b", "c", None]


def test_limits(spark):
    assert values(spark, limits.human_bytes, [1023, 1024, 1048575, 1048576, 5 * 1048576, 1572864, 1992294], "long") == ["0 KB", "1 KB", "1023 KB", "1 MB", "5 MB", "1.5 MB", "1.8 MB"]
    ids = ["claude-example-4-7", "claude-example-4.10", "claude-small-5", "claude-sample-4", "gpt-9", None]
    assert values(spark, limits.long_edge, ids) == [2576, 2576, 2576, 1568, 1568, 1568]
    assert values(spark, lambda c: limits.positive_int(c, 7), ["", "x", "0", "-1", "2.9", "NaN", "Infinity", None, " 4 "]) == [7, 7, 7, 7, 2, 7, 7, 7, 4]
    assert values(spark, limits.concurrency, ["0", "99", "x"]) == [1, 16, 5]
    assert values(spark, limits.raw_cap, [5 * 1024 * 1024], "long") == [3_932_160]
    assert values(spark, limits.media_type, ["a.JPG", "b.webp", "c", "d.tiff"]) == ["image/jpeg", "image/webp", "image/png", "image/png"]


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 30, 40) + b"\x01\0\0\0"
WEBP = b"RIFF\0\0\0\0WEBP"
IMAGES = {
    PNG: (640, 480),
    b"GIF89a" + struct.pack("<HH", 3, 5): (3, 5),
    JPEG: (40, 30),
    WEBP + b"VP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (19).to_bytes(3, "little"): (10, 20),
    WEBP + b"VP8L" + b"\0" * 4 + b"\x2f" + struct.pack("<I", 99 | 49 << 14): (100, 50),
    WEBP + b"VP8 " + b"\0" * 10 + struct.pack("<HH", 7, 8): (7, 8),
    PNG[:20]: None,
    b"GIF89a" + struct.pack("<HH", 0, 5): None,
    b"BM": None,
    b"": None,
}


def test_image_sizes(spark):
    assert {k: udfs.image_size(k) for k in IMAGES} == IMAGES
    got = values(spark, udfs.image_dimensions, [*map(bytearray, IMAGES), None], "binary")
    assert [tuple(r) if r and r[0] is not None else None for r in got] == [*IMAGES.values(), None]
    native = values(spark, limits.png_size, [bytearray(PNG), bytearray(PNG[:20]), bytearray(JPEG)], "binary")
    assert [r and tuple(r) for r in native] == [(640, 480), None, None]


def test_json_in_text():
    assert udfs.extract_json('say ```json\n{"a": "}"}\n``` end') == '{"a": "}"}'
    assert udfs.extract_json('x {"a": {"b": "\\"}"}} y {') == '{"a": {"b": "\\"}"}}'
    assert udfs.extract_json("[1, 2]") == "[1, 2]"
    for bad in ("none", "{open", '{bad} {"a": 1}', "", None):
        assert udfs.extract_json(bad) is None


def test_sql_registration(spark):
    udfs.register(spark)
    assert spark.sql("SELECT flatten_html('<p>a<b>b</b></p>') AS x, decode_html_entities('&lt;') AS y").first() == ("a b", "<")


# --- announcements

PAGES = {
    "<ol><li>Rivers <i>north</i><ol><li>Oder<li>Elbe</ol></ol>": "[List item] Rivers north\n[List item] Oder\n[List item] Elbe",
    "<ul><li><p>one <b>two</b></p></ul>": "[List item] one two",
    "<h2></h2>": "[Heading 2]",
    "<p>a<br>b <b>c</b></p>": "a b c",
    "<img src=x><img alt=''><img alt=' Cat '><img title=T>": "[Image] [alt missing] [Image] [decorative, alt empty] [Image alt] Cat [Image alt] T",
    "<a href=x><img alt=Logo></a><a href=y aria-label=Home></a>": "[Link] [Image alt] Logo [Link] Home",
    "<input type=email aria-label='Work email' value=v placeholder=p>": "[Field input email] Work email p v",
    "<select><option>A</option><option>B</option></select>": "[Field select] A, B",
    "<table><caption>Fees</caption><tr><th>a<th>b</tr><tr><td colspan=2>c</table>": "[Table] Fees [2 rows, 2 columns]\n[Header row] a | b\n[Row] c [spans 2 columns]",
    "<table><tr><td></td><td><table><tr><td>in</td></tr></table></td></tr></table>": "[Table] [no caption] [1 rows, 2 columns]\n[Row] [empty] | in",
    "<style>x</style><script>y</script>z": "z",
    "": "",
    "<blockquote><h3>Q</h3></blockquote>": "[Quote] [Heading 3] Q",
    "<p>a &amp; b</p>tail": "a & b\ntail",
}


@pytest.mark.parametrize("page", PAGES)
def test_flatten(page):
    assert flatten(page) == PAGES[page]


def words_of(page):
    """All words a page holds, from its tree and a wide list of attributes."""
    out, stack = set(), [parse(page).body]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out |= set(re.findall(r"\w+", x))
        elif isinstance(x, Element) and x.name not in SILENT:
            stack += x.children
    return out


def test_flatten_loses_no_word(spark):
    rows = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    nested = "<div>" * (MAX_DEPTH + 50) + "deep <p>word</p><img alt=pic>" + "</div>" * (MAX_DEPTH + 50)
    just = "<b>" * (MAX_DEPTH - 10) + "inner" + "</b>" * (MAX_DEPTH - 10)
    for page in [*rows, *PAGES, nested, just]:
        said = flatten(page)
        assert words_of(page) <= set(re.findall(r"\w+", said))
    assert flatten(nested).split("\n") == ["deep", "word", "pic"] and flatten(None) == ""


def test_lint():
    assert violations("<p id=a></p><p id=a></p><img src=x>") == [("duplicate-id", "minor", 1), ("image-alt", "critical", 1)]
    assert violations("<label for=q>x</label><input id=q><input type=hidden>") == []
    assert violations(None) == [] and violations("<html><body>x") == [("html-lang", "serious", 1)]


def test_lint_names_of_links_and_headings():
    silent = '<a href=x></a><a href=x> <b></b></a><a href=x><script>s</script></a><h1></h1><h2> <span> </span></h2>'
    assert violations(silent) == [("empty-heading", "minor", 2), ("link-name", "serious", 3)]
    named = '<a href=x>go</a><a href=x><img alt=pic></a><a href=x title=t></a><a name=x></a><h1><b>a</b></h1><h2 aria-label=n></h2>'
    assert violations(named) == []
    deep = "<a href=x>" + "<b>" * 5000 + "{}" + "</b>" * 5000 + "</a>"
    assert violations(deep.format("")) == [("link-name", "serious", 1)] and violations(deep.format("go")) == []


# --- anchors


def test_references_and_rewriting():
    page = "<label for=q1 id='l'>x</label><a href=\"#fn-1\">1</a><td headers=\"h1  h2\"></td><script>id='no'</script><!-- id=no --><p ID=Z id=y>"
    assert anchors.page_ids(page) == ["l", "Z"]
    assert anchors.page_references(page) == [("for", "q1"), ("href", "fn-1"), ("headers", "h1"), ("headers", "h2")]
    new = anchors.rewritten(page, lambda i: f"p-{i}", lambda t: f"p-{t}")
    assert new == "<label for=p-q1 id='p-l'>x</label><a href=\"#p-fn-1\">1</a><td headers=\"p-h1 p-h2\"></td><script>id='no'</script><!-- id=no --><p ID=p-Z id=y>"
    assert anchors.rewritten(page, lambda i: i, lambda t: t) == page.replace("h1  h2", "h1 h2")


def test_namespacing():
    note = lambda n: f'<p id="fn-1">n{n}</p><a href="#fn-1">r</a>'
    made = anchors.namespace_pages([(1, note(1)), (2, note(2)), (3, '<a href="#fn-1">far</a>')])
    assert made.collisions == ["fn-1"] and made.ambiguous == [(3, "fn-1")] and not made.skipped
    assert made.pages[1] == '<p id="p2-fn-1">n2</p><a href="#p2-fn-1">r</a>' and made.pages[2] == '<a href="#p1-fn-1">far</a>'
    same = [(1, '<p id="a"><i id="a"></i></p>'), (2, '<a href="#a">x</a>')]
    assert anchors.namespace_pages(same).pages == [s for _, s in same]
    taken = anchors.namespace_pages([(1, '<p id="x"></p><p id="p1-x">'), (1, '<p id="x">')])
    assert taken.pages == ['<p id="p1--x"></p><p id="p1-x">', '<p id="p1_2--x">']


def test_pages_that_can_not_be_rewritten():
    broken = '<table>loose<tr><td><a href="#q">x</a></td></tr></table>'
    made = anchors.namespace_pages([(1, '<p id="q">'), (2, '<p id="q">'), (3, broken)])
    assert made.skipped == [3] and made.pinned == ["q"] and made.pages == ['<p id="q">', '<p id="p2-q">', broken]
    owner = '<table>loose<tr id="q"></tr></table>'
    made = anchors.namespace_pages([(1, '<p id="q">'), (2, owner), (3, '<a href="#q">x</a>')])
    assert made.skipped == [2] and not made.pinned and made.pages == ['<p id="p1-q">', owner, '<a href="#p1-q">x</a>']
    deep = "<div>" * 501 + '<p id="q"></p>' + "</div>" * 501
    assert anchors.namespace_pages([(1, deep), (2, '<p id="q"></p>')]).skipped == [1]
