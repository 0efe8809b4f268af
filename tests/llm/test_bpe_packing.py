"""Encoding against the tokenizer library, and packing against its rules."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioscope.llm import bpe, packing

PIECES = [" ", "  ", "\n", "\n\n", "'s", "'", "é", "à", "!", "!'", "12", "abc", "Def", "<|endoftext|>", "\t", "日本", "😀", "##", "|", "\r\n", "\x1c", "\u0085", "　", "x ", "Ω", "ing", " the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def random_texts(n, seed=5, size=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, size))) for _ in range(n)]


LONG = [" " * 70_000 + "a", "é" * 40_000, "ab" * 50_000, "\n " * 30_000, "^" * 70_000, "word and word, " * 20_000]


@pytest.mark.parametrize("size", [1, 64, bpe.FRAGMENT_BYTES])
def test_ids_equal_the_library(library, size):
    codec = bpe.ForcedBoundaryCodec(bpe.vocabulary_path(), size)
    texts = random_texts(2000) + (LONG if size > 1 else [])
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert ids.tolist() == want.ids
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_slow_path_equals_fast(library):
    codec = bpe.ForcedBoundaryCodec(bpe.vocabulary_path(), 1)
    codec.fast = None
    for text in random_texts(200):
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_at_pairs_in_no_token():
    codec = bpe.codec()
    raw = "It's a test, naïve café — 日本語\n\n  x".encode()
    for at in codec.boundaries(raw).tolist():
        assert not any(raw[at - 1 : at + 1] in t for t in codec.tokens)
        raw[:at].decode()


def test_decode_replaces_broken_bytes(library):
    ids = [i for i in range(200)]
    assert bpe.codec().decode(np.asarray(ids)) == library.decode(ids, skip_special_tokens=False)


def test_query(docs, library):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (None, "x"), (5, LONG[5])]
    found = bpe.round_trip_digests(docs(rows)).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, found)) == want
    assert bpe.round_trip_digests(docs([])).count() == 0


def test_general_interface(docs):
    rows = [(1, "Hello world"), (2, None)]
    ids = bpe.encode_ids(docs(rows))
    assert {r.doc_id: r.text for r in bpe.decode_ids(ids).collect()} == {1: "Hello world", 2: ""}


# --- packing


def check_packing(rows, found):
    """Pieces cover each document once, sequences are gapless and hold 2,048 at most; returns the padding."""
    codec, pieces, sequences = bpe.codec(), defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in rows:
        ids, at = np.append(codec.encode(text), np.asarray([1], "<u4")), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


@pytest.mark.parametrize("n", [1, 7, 300])
def test_packing_has_no_padding(docs, n):
    rnd = random.Random(n)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "é!", "x1"]) for _ in range(rnd.choice([0, 3, 40, 900, 5000])))) for i in range(n)]
    rows[0] = (0, None)
    assert check_packing(rows, packing.pack_documents(docs(rows).repartition(3)).collect()) == 0


def test_many_documents_of_one_length(docs):
    rows = [(i, "alpha beta " * 350) for i in range(60)]
    assert check_packing(rows, packing.pack_documents(docs(rows)).collect()) == 0


def test_packing_of_nothing_and_of_repeated_rows(docs):
    assert packing.pack_documents(docs([])).count() == 0
    found = packing.pack_documents(docs([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == {(1, 3): 2, (None, 2): 1}


def test_joined_crc():
    data = np.random.default_rng(0).integers(0, 50_000, 32 * 5).astype("<u4")
    parts = [zlib.crc32(data[i : i + 32].tobytes()) for i in range(0, len(data), 32)]
    assert packing.joined_crc(parts) == zlib.crc32(data.tobytes())
    assert packing.joined_crc(parts[1:3]) == zlib.crc32(data[32:96].tobytes())


def test_columns_meet_the_demand():
    histogram = {64: 90, 1500 - 1500 % 32: 40, 7: 300, 2016: 11, 31: 5, 2048: 3}
    plan = packing.make_plan(histogram)
    for i, s in enumerate(packing.SIZES):
        assert plan.covered[i] <= histogram.get(int(s), 0)
    assert all(int(c @ packing.SIZES) == 2048 for c, _ in plan.patterns)
    # The linear program's value can't be below the volume.
    some = np.flatnonzero(plan.demand)
    _, use = packing.generate_columns(packing.SIZES[some], plan.demand[some].astype(float))
    assert use.sum() >= (plan.demand @ packing.SIZES) / 2048 - 1e-6


def test_best_pattern_is_optimal():
    rnd = random.Random(1)
    for _ in range(20):
        sizes = np.asarray(sorted(rnd.sample(range(1, 15), 4)))
        values = np.asarray([rnd.random() for _ in sizes])
        value, counts = packing.best_pattern(sizes, values, 20)
        best = {0: 0.0}
        for room in range(1, 21):
            best[room] = max([best[room - 1], *(best[room - s] + v for s, v in zip(sizes, values, strict=True) if s <= room)])
        assert abs(value - best[20]) < 1e-9 and abs(counts @ values - value) < 1e-9 and counts @ sizes <= 20


def test_short_texts_are_cut_at_forced_boundaries(library):
    codec = bpe.ForcedBoundaryCodec(bpe.vocabulary_path())
    text = "naïve café — 日本語, l'été!"
    assert len(codec.fragments(text.encode())) == 1 + len(codec.boundaries(text.encode())) > 1
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_flat_histogram_reaches_the_optimum():
    rng = np.random.default_rng(4)
    demand = rng.integers(1, 2000, len(packing.SIZES)).astype(float)
    columns, use = packing.generate_columns(packing.SIZES, demand)
    prices = np.linalg.solve(columns.T.astype(float), np.ones(len(packing.SIZES)))
    value, _ = packing.best_pattern(packing.SIZES, prices)
    assert value <= 1 + 1e-6 and use.min() > -1e-3 * demand.max()
    assert (columns.T @ packing.SIZES <= packing.SEQUENCE).all()
