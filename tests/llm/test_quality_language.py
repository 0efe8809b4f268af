"""The rule ledger against a plain count, and language profiles."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import language, quality
from folioscope.llm.quality import measure


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures():
    rnd = random.Random(2)
    pieces = ["a", "b", "é", "\n", " ", "\n\n", "\x1c", "\u0085", "\xa0", "#", "|x", "\r\n", "\t", "!"]
    texts = [None, "", " \n", *("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 80))) for _ in range(2000))]
    for t in texts:
        assert measure(t)[:5] == brute(t), repr(t)


def test_ledger_and_ablations(docs):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, "x " * 100), (5, " ".join(f"w{i}###" for i in range(60))), (None, good)]
    ledger = quality.rule_ledger(docs(rows))
    kept = [(r.doc_id, r.ok) for r in ledger.select("doc_id", quality.passes("web-1").alias("ok")).collect()]
    assert Counter(kept) == Counter({(1, False): 1, (2, False): 1, (3, True): 2, (4, False): 1, (5, False): 1, (None, True): 1})
    found = {r.rule: r for r in quality.ablations(ledger, "web-1").collect()}
    assert found["symbols"].only == 1 and found["symbols"].rejected == 4 and found["symbols"].rejected_without == 3
    assert found["few_words"].fails == 2
    empty = quality.ablations(quality.rule_ledger(docs([])), "base-1").collect()
    assert {(r.rule, r.rows, r.fails) for r in empty} == {("few_words", 0, 0), ("repeat_words", 0, 0)}


WORDS = {"aa": ["kato", "kilo", "oka", "toko"], "bb": ["wern", "wurz", "zwen", "ruw"]}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(30)), lang) for i in range(n) for lang in [rnd.choice(sorted(WORDS))]]


def test_language(docs):
    rows = [*corpus(120), (1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "toko " * 40_000, None), (5, "kato", "aa"), (None, "wern wurz zwen", None)]
    found = language.identify_language(docs(rows)).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in corpus(120)}
    for r in found:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in truth and r.doc_id != 5:
            assert r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"]


def test_held_out_labels_and_columns_are_not_used(docs):
    rows = corpus(90)
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    plain = {tuple(r) for r in language.identify_language(docs(rows)).collect()}
    assert plain == {tuple(r) for r in language.identify_language(docs(turned)).collect()}


def test_language_without_labels(docs):
    found = language.identify_language(docs([(1, "some text", None), (2, "more", None)])).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    assert language.identify_language(docs([])).count() == 0


def test_out_of_place_distance_by_hand():
    profiles = language.Profiles({"a": [ord("x"), ord("y")], "b": [ord("y"), ord("x")]})
    # "xx y": x twice, y once, then grams with spaces; only the first two places of the document count.
    own = language.ranked(*language.ngram_counts("xx y"), 2)
    sums = [sum(abs(list(own).index(k) - p.index(k)) if k in list(own) else 2 for k in own if k in p) + 2 * sum(k not in p for k in own) for p in ([ord("x"), ord("y")], [ord("y"), ord("x")])]
    name, score = profiles.predict("xx y")
    assert name == ("a" if sums[0] <= sums[1] else "b") and abs(score - (1 - min(sums) / 4)) < 1e-9


def test_every_labelled_document_counts(docs):
    """Profiles and least scores are those of all labelled documents, not of some."""
    rnd = random.Random(9)
    words = {"aa": "kato kilo oka toko lak".split(), "bb": "wern wurz zwen ruw nerz".split()}
    rows = [(i, " ".join(rnd.choice(words[x]) + rnd.choice("abcdefghij") for _ in range(6)), x) for i in range(3000) for x in ["aa" if i % 5 else "bb"]]
    profiles = language.fit_profiles(docs(rows), size=60)
    for name, keys in zip(profiles.names, profiles.keys, strict=True):
        sums = Counter()
        for _, text, lang in rows:
            if lang == name:
                sums.update(dict(zip(*(x.tolist() for x in language.ngram_counts(text)), strict=True)))
        assert keys.tolist() == sorted(sums, key=lambda k: (-sums[k], k))[:60]
    said = [(x, *profiles.predict(t)) for _, t, x in rows]
    want = {x: np.percentile([s for y, p, s in said if x == y == p], 5) for x in words}
    assert language.low_scores(docs(rows), profiles, 0.05) == pytest.approx(want, abs=1e-12)


def test_more_than_five_hundred_languages(docs):
    rnd = random.Random(7)
    letter = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(2))
    rows = [(10 * k + j, f"{letter(k)} " * rnd.randrange(8, 12), f"l{k:03d}") for k in range(520) for j in range(8)]
    profiles = language.fit_profiles(docs(rows).where(~language.held_out()))
    assert len(profiles.names) == 520
    assert all(profiles.predict(f"{letter(k)} " * 9)[0] == f"l{k:03d}" for k in (0, 3, 250, 510, 519))
