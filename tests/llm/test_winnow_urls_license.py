"""Winnowing, URL filters and licences against plain versions."""

from __future__ import annotations

import hashlib
import os
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import bloom, license, urlfilter, winnow

# --- winnowing


def char_value(c):
    h = xxhash.xxh64_intdigest(c.encode("utf-32-be"), seed=42)
    return h & (2**30 - 1)


def chosen(text, gram=winnow.GRAM, window=winnow.WINDOW):
    """(hash, -position) by the definition: each gram's polynomial afresh, each window's least, rightmost on ties."""
    values = [char_value(c) for c in text]
    values += [char_value("")] * (gram - len(values) if values else 0)
    hashes = []
    for i in range(len(values) - gram + 1 if values else 0):
        h = 0
        for v in values[i : i + gram]:
            h = (h * winnow.BASE + v) % winnow.MODULUS
        hashes.append((h, -(i + 1)))
    out = []
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        least = min(hashes[i : i + window])
        if least not in out:
            out.append(least)
    return out


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def digest(own):
    return hashlib.sha256(",".join(str(h * 2**31 + p) for h, p in own).encode()).hexdigest()


def check_winnow(rows, found):
    rows = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda r: (r[0], r[1].encode()))
    assert len(found) == len(rows)
    for k, ((i, text), r) in enumerate(zip(rows, sorted(found, key=lambda r: (r.doc_id, r.n_chars)), strict=True)):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.doc_id, r.n_chars) == (i, len(text))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (digest(chosen(text)), digest(chosen(edited)))
        assert r.near_edited == pytest.approx(like(chosen(text), chosen(edited))) and r.near_next == pytest.approx(like(chosen(text), chosen(after)))


def test_winnowing(docs):
    rnd = random.Random(4)
    ids = [0, 3, 255, 256, 257, 5000, 5001, 300_000, 300_001, 2_000_000_000, -7, -600]
    rows = [(i, " ".join(rnd.choice(["red", "blué", "日本", "x" * 30]) for _ in range(rnd.choice([0, 1, 2, 5, 60])))) for i in ids]
    rows += [(11, None), (12, ""), (13, " \n "), (14, "same text here again"), (15, "same text here again"), (16, "long text piece " * 9000)]
    check_winnow(rows, winnow.edit_likeness(docs(rows).repartition(3)).collect())


def test_winnowing_of_one_row_of_none_and_without_id(docs):
    check_winnow([(9, "a b c d e f g")], winnow.edit_likeness(docs([(9, "a b c d e f g")])).collect())
    assert winnow.edit_likeness(docs([])).count() == 0
    found = winnow.edit_likeness(docs([(None, "abcd"), (1, "x y z"), (1, "x y z")])).collect()
    assert len(found) == 3
    alone = next(r for r in found if r.doc_id is None)
    assert alone.edited_sha256 == hashlib.sha256(b"ab").hexdigest() and alone.near_next == 0.0


SCRIPTS = {"latin": (97, 123), "chinese": (0x4E00, 0x9FA5), "emoji": (0x1F600, 0x1F640), "thai": (0xE01, 0xE2F)}


def test_match_guarantee(docs):
    """A shared run of GRAM + WINDOW - 1 code points gives a common hash, at any offset and in any script."""
    rows = []
    for first, script in enumerate(sorted(SCRIPTS)):
        rnd = random.Random(script)
        some = lambda n: "".join(chr(rnd.randrange(*SCRIPTS[script])) for _ in range(n))  # noqa: B023, E731
        shared = some(winnow.GRAM + winnow.WINDOW - 1)
        rows += [(100 * first + k, some(11 * k % 293) + shared + some(7 * k % 31)) for k in range(40)]
    found = {r.doc_id: [(x.hash, -x.position) for x in r.fingerprint] for r in winnow.fingerprints(docs(rows)).collect()}
    for k, text in rows:
        assert found[k] == chosen(text)
        assert {h for h, _ in found[k - k % 100]} & {h for h, _ in found[k]}


def test_edits_at_any_length(docs):
    """Lengths around grams, windows, seams and blocks; repetitive texts give ties."""
    rnd = random.Random(9)
    lengths = [*range(70), 127, 128, 129, 157, 158, 159, 160, 255, 256, 257, 300]
    rows = [(i, "".join(rnd.choice(["ab", "abc", "😀", "x"][: 1 + i % 4]) for _ in range(n))[:n]) for i, n in enumerate(rnd.sample(lengths * 2, 2 * len(lengths)))]
    check_winnow(rows, winnow.edit_likeness(docs(rows)).collect())


def test_texts_are_dealt_out_once(spark):
    from folioscope.llm.queries import QUERIES

    plan = QUERIES["op7_winnowing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange" in x and "REPARTITION_BY_COL" in x]
    assert len(dealt) == 1 and "_range" in dealt[0]


def test_grams_and_windows_must_be_powers_of_four(docs):
    with pytest.raises(ValueError):
        winnow.fingerprints(docs([(1, "a")]), gram=16, window=8)


# --- URL filters


def judged(url, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda r: len(r[0]), default=(None, None))
    form = re.sub("^www\\.", "", host) + path.rstrip("/")
    return host, path, rule, verdict or ("block" if host and form in listed else "allow")


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com", "https://EXAMPLE.com/", "http://www.example.com/en/1", "http://a.www.example.com/en/1?x=/fr/", "http://example.com/en", "http://b.example.com/en/x#y",
    "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/1", "http://ads-x.net/de/1/", "http://www.ads-x.net/de/1", "http://ads-x.org?q=1", "ftp://u@h.org:80/p://q", "http://ÄB.org/É?",
    "http://İX.org/", "x://spam-a.org/p//",
]


def test_urls(spark):
    rows = [(i, u, "x", "x") for i, u in enumerate([*URLS, URLS[7], URLS[15]])]
    urls = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    listing = urlfilter.default_listing(urls)
    listed = {r.canonical for r in listing.collect()}
    assert listed == {"ads-x.net/de/1", "ads-x.org", "spam-a.org/p"}
    for blocks in (urlfilter.BLOCKS, 1):  # a filter of one block passes nearly all on to the join
        found = urlfilter.filter_urls(urls, listing, blocks=blocks).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r.host, r.path, r.rule, r.verdict) == judged(rows[r.page_id][1], listed)
    nulls = listing.union(spark.sql("SELECT cast(null AS string)"))
    assert urlfilter.filter_urls(urls.limit(0), nulls).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(urls, listing.limit(0)).collect() if r.rule is None} == {"allow"}


def test_bloom_filters_are_sized_by_their_keys():
    assert [bloom.blocks_for(n) for n in (0, 1, 4096, 4097, 10**6, 10**12)] == [1024, 1024, 1024, 2048, 1 << 18, bloom.MOST]
    assert all(64 * bloom.blocks_for(n) >= 16 * n for n in range(0, 4 * bloom.MOST, 9973))


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(0, 30_000, 3).withColumn("k", F.col("id").cast("string"))
    held = bloom.bloom_filter(keys, "k", 4096).scalar()
    own = spark.range(30_000).withColumn("hit", bloom.may_hold(held, F.col("id").cast("string"), 4096))
    hits = own.where("hit").count()
    assert own.where("hit AND id % 3 = 0").count() == 10_000 and hits < 11_500


def test_native_operators_run_no_python(spark):
    from folioscope.llm.queries import QUERIES

    for name in ("op2_license_scan", "op7_winnowing", "op10_url_filter"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct", "NestedLoop")), name


# --- licences


def test_licences(docs):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "prose\n" + mit, "a/x/1"), (2, mit, "a/x/LICENSE"), (3, "plain", "a/x/3"), (4, "plain", "a/x/deep/er/4"), (5, gpl, "a/COPYING"), (6, "none", "a/y/6"), (7, None, "b/7"), (8, "", None),
        (9, "license to drive", "b/9"), (10, "prose " * 40 + "\n" + gpl, "a/x/10"), (11, "top", "top"), (3, "plain", "a/x/3"), (12, gpl, "a/x/deep/Z"),
    ]
    paths = {i: p for i, _, p in rows}
    df = docs([(i, t) for i, t, _ in rows])
    path = F.try_element_at(F.create_map(*(x for i, p in paths.items() for x in (F.lit(i).cast("long"), F.lit(p)))), F.col("doc_id"))
    found = {r.doc_id: r for r in license.scan_licenses(df, path).collect()}
    assert len(found) == 12
    got = {i: (r.own_license, r.license, r.inherited_from) for i, r in found.items()}
    assert got == {
        1: ("MIT", "MIT", None), 2: ("MIT", "MIT", None), 3: (None, "MIT", "a/x/1"), 4: (None, "GPL-3.0", "a/x/deep/Z"), 5: ("GPL-3.0", "GPL-3.0", None), 6: (None, "GPL-3.0", "a/COPYING"), 7: (None, None, None),
        8: (None, None, None), 9: (None, None, None), 10: ("GPL-3.0", "GPL-3.0", None), 11: (None, None, None), 12: ("GPL-3.0", "GPL-3.0", None),
    }
    assert license.scan_licenses(docs([]), F.lit("a/b")).count() == 0


def test_licence_of_a_row_without_an_id(docs):
    df = docs([(None, "Released under the MIT License."), (1, "plain")])
    path = F.when(F.col("doc_id").isNull(), F.lit("a/LICENSE")).otherwise(F.lit("a/x"))
    assert {(r.doc_id, r.own_license, r.license) for r in license.scan_licenses(df, path).collect()} == {(None, "MIT", "MIT"), (1, None, "MIT")}


def test_templates_are_their_own_best_match(spark):
    lines = spark.createDataFrame([(n, t) for n, t in license.TEMPLATES.items()], "key string, unit string")
    found = {r.key: (r.license, r.score) for r in license.scored(lines).collect()}
    assert found == {n: (n.split("/")[0], 1.0) for n in license.TEMPLATES}


def test_licence_files(docs):
    body = license.TEMPLATES["MIT/file"].replace(", ", ",\n")
    df = docs([(1, body + "\nCopyright (c) Someone"), (2, "plain")])
    path = F.concat(F.lit("src/lib/"), F.col("doc_id").cast("string"))
    assert [(r.own_license, r.license, r.inherited_from) for r in license.scan_licenses(df, path).orderBy("doc_id").collect()] == [("MIT", "MIT", None), (None, "MIT", "src/lib/1")]


HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1-or-later",
}


def test_real_headers(docs):
    code = "\n\n" + "\n".join(f"x{i} = compute(y{i}, z{i})" for i in range(200))
    signs = [lambda t: re.sub("(?m)^", "# ", t), lambda t: "/*\n" + re.sub("(?m)^", " * ", t) + "\n */", lambda t: "/*\n" + t + "\n*/", lambda t: re.sub("(?m)^", "// ", t)]
    want = {}
    for n, text in HEADERS.items():
        want |= {len(want) + k: (n, sign("Copyright (C) 2020 Some Body\n\n" + text) + code) for k, sign in enumerate(signs)}
    found = license.scan_licenses(docs([(i, t) for i, (_, t) in want.items()]), F.concat(F.lit("a/"), F.col("doc_id"))).collect()
    assert {r.doc_id: r.own_license for r in found} == {i: n for i, (n, _) in want.items()}
    assert all(r.inherited_from is None for r in found)


COMMON = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files")
def test_real_licence_files(docs):
    texts = []
    for f in COMMON:
        with open(f"/usr/share/common-licenses/{f}") as file:
            texts.append("Copyright 2021 The Some Project Authors\n\n" + file.read())
    folder = F.concat(F.lit("d"), (F.col("doc_id") % 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    prose = " ".join(f"The garden{i} of the old house is open to all, and a path{i} leads to the river{i}." for i in range(300))
    df = docs([*enumerate(texts), *((100 + i, "plain") for i in range(len(texts))), (99, prose + " copyright")])
    found = {r.doc_id: r for r in license.scan_licenses(df, folder).collect()}
    for i, want in enumerate(COMMON.values()):
        assert (found[i].own_license, found[100 + i].license, found[100 + i].inherited_from) == (want, want, f"d{i}/{i}")
    assert found[99].license is None
