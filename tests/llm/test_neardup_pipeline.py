"""Near-duplicates against all pairs, and the pipeline against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import language, neardup, quality, secrets

from .test_bpe_packing import check_packing

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[i : i + 4]) for i in range(len(w) - 3)])


def brute(rows):
    """Component of each id by comparing all pairs."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i, _ in rows}


def edited(words, rnd, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.random():.6f}"
    return words


def families(seed, n_families=6, size=14, length=80):
    """Groups of near copies whose distance to each other lies around the threshold, chains among them."""
    rnd, rows, i = random.Random(seed), [], 0
    for f in range(n_families):
        base = [f"w{f}_{rnd.randrange(400)}" for _ in range(length)]
        chain = base
        for k in range(size):
            chain = edited(chain, rnd, 1)
            own = base if k % 5 == 0 else edited(base, rnd, rnd.randrange(1, 6)) if k % 2 else chain
            rows.append((i, " ".join(own)))
            i += rnd.choice([1, 1, 7])
    rnd.shuffle(rows)
    return rows


def check(rows, found):
    want = brute([r for r in rows if r[0] is not None])
    sizes = Counter((i, len(shingles(t))) for i, t in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in found) == sizes
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])


@pytest.mark.parametrize("seed", [1, 2])
def test_families(docs, seed):
    rows = families(seed)
    check(rows, neardup.near_duplicates(docs(rows).repartition(3)).collect())


def test_edges(docs):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [
        (9, "a b c d e f g"), (2, "A b C d e f g"), (5, None), (6, ""), (7, " \n"), (8, "one"), (1, "ONE"), (3, "one two"), (4, "é b c d"), (10, "É b c d"), (11, long), (12, long + " end"), (9, "a b c d e f g"),
        (None, "a b c d e f g"), (None, None), (20, "x\u00a0y z w v"), (21, "x y z w v"),
    ]
    check(rows, neardup.near_duplicates(docs(rows)).collect())
    assert neardup.near_duplicates(docs([])).count() == 0


def test_rows_that_share_an_id_share_a_component(docs):
    rows = [(1, "a b c d e"), (2, "p q r s t"), (3, "a b c d e"), (3, "p q r s t"), (4, "u v w x y")]
    found = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs(rows)).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_components(spark):
    rnd = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    found = {r.node: r.component for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert neardup.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_sketches_and_bands_do_not_miss_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    worst, missed = 0, 0
    for _ in range(300):
        n = int(rng.integers(40, 400))
        both, own = rng.integers(0, 2**63, (2, n)).astype(np.uint64), max(1, n // 9)
        a, b = np.concatenate([both[0], both[1][:own]]), np.concatenate([both[0], both[1][own : 2 * own]])
        x, y = neardup.minhashes(np.unique(a)), neardup.minhashes(np.unique(b))
        missed += not (neardup.band_keys(x) == neardup.band_keys(y)).any()
        bits = np.unpackbits((neardup.odd_sketch(x) ^ neardup.odd_sketch(y)).view(np.uint8)).sum()
        worst = max(worst, int(bits))
    assert missed == 0 and worst <= neardup.MAX_ODD_BITS


def test_prefixes_drop_no_link_and_many_others(spark):
    rnd = random.Random(5)
    base = rnd.sample(range(10**9), 100)
    sets = [(i, sorted(rnd.sample(base, k := rnd.randrange(70, 100)) + [rnd.randrange(10**9, 2 * 10**9) for _ in range(100 - k)])) for i in range(60)]
    df = spark.createDataFrame([*sets, (99, [1]), (99, [2])], "id long, shingles array<long>")
    prefixes = neardup.rare_prefixes(df, 80).collect()
    assert {r.id for r in prefixes} == set(range(60)) and all(len(r.prefix) == 21 for r in prefixes)
    own = {i: set(s) for i, s in sets}
    x = spark.createDataFrame(prefixes).withColumn("n", F.lit(100))
    a, b = (x.select(*(F.col(c).alias(f"{c}_{k}") for c in x.columns)) for k in "xy")
    pairs = a.join(b, F.col("id_x") < F.col("id_y")).select("id_x", "id_y", neardup._may_share_enough("prefix_x", "prefix_y", "n_x", "n_y", 80).alias("may"))
    found = {(r.id_x, r.id_y): r.may for r in pairs.collect()}
    true = {p for p in found if 100 * len(own[p[0]] & own[p[1]]) >= 80 * len(own[p[0]] | own[p[1]])}
    kept = {p for p, may in found.items() if may}
    assert true and true <= kept and len(kept) < len(found) / 2


def test_prefixes_compare_whole_shingles(spark):
    """Shingles that agree in their low 32 bits are two, and a pair at the threshold is let through."""
    shared = [(k << 32) | (k // 2) for k in range(1, 81)]
    x, y = ([*shared, *((s << 40) | k for k in range(10))] for s in (1001, 1002))
    prefixes = neardup.rare_prefixes(spark.createDataFrame([(1, x), (2, y)], "id long, shingles array<long>"), 80).withColumn("n", F.lit(90))
    a, b = (prefixes.select(*(F.col(c).alias(f"{c}_{k}") for c in prefixes.columns)) for k in "xy")
    found = a.join(b, F.col("id_x") < F.col("id_y")).select(neardup._may_share_enough("prefix_x", "prefix_y", "n_x", "n_y", 80).alias("may")).collect()
    assert [r.may for r in found] == [True]


# --- the pipeline


def test_pipeline(spark, tmp_path):
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        words = [rnd.choice("kato kilo oka toko lak".split() if lang == "aa" else "wern wurz zwen ruw nerz".split()) + rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(90)]
        rows.append((i, " ".join(words), lang, "s", 7))
    rows[10] = (10, None, "aa", None, None)
    rows[11] = (11, "", None, "s", 0)
    rows[12] = (12, " ".join(f"w{i}###" for i in range(70)), "aa", "s", 1)
    rows[13] = (13, " ".join(str(10_000 + i) for i in range(70)), "aa", "s", 1)
    rows[21] = (21, rows[20][1] + " end", "bb", "s", 1)
    rows[31] = (31, rows[31][1] + " token = deadbeefdeadbeef77 " + rows[31][1][:40], "aa", "s", 1)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_pipeline.documents(spark, str(tmp_path))

    kept = [r for r in rows if not any(eval(rule.fails.replace(" AND ", " and "), dict(zip(quality.MEASURES, quality.measure(r[1]), strict=True))) for rule in quality.RULES)]
    one = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r[0] for r in kept} and not {10, 11, 12} & {r[0] for r in kept}

    profiles = language.fit_profiles(one.where(~language.held_out()))
    said = {r[0]: profiles.predict(r[1]) for r in kept}
    kept = [r for r in kept if said[r[0]][0] != "und" and said[r[0]][1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    two = corpus_pipeline.language_id(spark, one, str(tmp_path))
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {r[0] for r in kept} and 13 not in {r[0] for r in kept}

    component = brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if component[r[0]] == r[0]]
    three = corpus_pipeline.near_duplicates(spark, two, str(tmp_path))
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == {r[0] for r in kept} and 21 not in {r[0] for r in kept}

    four = corpus_pipeline.secret_scan(spark, three, str(tmp_path))
    texts = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns and {i: r.text for i, r in texts.items()} == {r[0]: secrets.mask(r[1]) for r in kept}
    assert "deadbeef" not in texts[31].text and texts[31].n_chars == len(texts[31].text) and texts[2].n_chars == 7

    final = [(i, r.text) for i, r in texts.items()]
    assert check_packing(final, corpus_pipeline.run(spark, str(tmp_path)).collect()) == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "secret_scan", "packing"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_rejects_gibberish_and_unlisted_languages(spark):
    rnd = random.Random(3)
    labelled = corpus_pipeline.documents(spark, "/root/testdata/sf0.01").where("length(text) >= 300 AND lang IS NOT NULL")
    letters = "abcdefghijklmnopqrstuvwxyz"
    strange = {
        -1: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 10))) for _ in range(200)),
        -2: " ".join("".join(rnd.choice("0123456789abcdef") for _ in range(8)) for _ in range(200)),
        -3: "zzzz qqqq xxxx " * 70,
        -4: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 6,
        -5: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 6,
    }
    other = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in strange.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id for r in corpus_pipeline.language_id(spark, labelled.select(*other.columns).unionByName(other), "").collect()}
    assert found == {r.doc_id for r in labelled.select("doc_id").collect()}
