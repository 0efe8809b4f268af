"""Byte-pair encoding and decoding by forced-boundary splitting.

A merge can join two neighbouring bytes only into a vocabulary token that holds them side by side.  Where a
byte pair occurs inside no token, every encoding has a boundary.  Every text, short or long, is cut at all such places
into fragments, which are encoded on their own; their ids are concatenated.  Fragments that a worker has met lately
are not encoded again.

A cut must also leave the tokenizer's first split into words as it is.  So none is made after white space
(a run of it is split by what follows), before an apostrophe (which could begin a contraction) or inside a
character.  The strings of special tokens are cut out first, as the tokenizer does.

Null text counts as empty: no ids.  Empty tables give empty results; repeated rows are encoded alike.  Only
the id and the text column are read.  Texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sha256_hex, small_batches

#: The least bytes of a fragment: one, so that texts are cut at each forced boundary.
FRAGMENT_BYTES = 1
#: Bytes of memory for the ids of fragments that a worker keeps; it then begins anew.
MEMO_BYTES = 48_000_000

_SPACE_LEFT = [*range(9, 14), *range(28, 33)]
#: How the byte-level tokenizer first splits a text (fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Last and last but one byte of the white space outside ASCII.
_SPACE_LAST = [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]
_SPACE_BEFORE = [0xC2, 0x80, 0x81, 0x9A]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FragmentIds(dict):
    """The ids of fragments as little-endian bytes, encoded where they are missing."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.size = encode, 0

    def __missing__(self, raw: bytes) -> bytes:
        found = self.encode(raw)
        size = 200 + len(raw) + len(found)
        if self.size + size > MEMO_BYTES:
            self.clear()
            self.size = 0
        if size <= MEMO_BYTES:
            self[raw] = found
            self.size += size
        return found


class ForcedBoundaryCodec:
    def __init__(self, path: str, fragment_bytes: int = FRAGMENT_BYTES):
        self.fragment_bytes = fragment_bytes
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max(*spec["model"]["vocab"].values(), *special.values()))
        inside = np.zeros((256, 256), bool)
        for token, i in spec["model"]["vocab"].items():
            raw = token.encode() if token in special else bytes(letters[c] for c in token)
            self.tokens[i] = raw
            if token not in special:
                own = np.frombuffer(raw, np.uint8)
                inside[own[:-1], own[1:]] = True
        for token, i in special.items():
            self.tokens[i] = token.encode()
        allowed = ~inside
        allowed[_SPACE_LEFT, :] = False
        allowed[:, ord("'")] = False
        allowed[:, 0x80:0xC0] = False
        self.allowed = allowed.ravel()
        self.after_space = np.zeros((256, 256), bool)
        self.after_space[np.ix_(_SPACE_BEFORE, _SPACE_LAST)] = True
        self.after_space = self.after_space.ravel()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_ids = special
        self.fast = self._rank_encoder(spec["model"])
        self.memo = FragmentIds(self._encode_fragment)

    @cached_property
    def tokenizer(self):
        """The tokenizer library's own, for what the fast encoder does not take."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_padding()
        made.no_truncation()
        return made

    def boundaries(self, raw: bytes) -> np.ndarray:
        """All forced boundaries of ``raw`` (UTF-8) that leave the first split as it is, ascending."""
        b = np.frombuffer(raw, np.uint8).astype(np.uint16)
        pair = (b[:-1] << 8) | b[1:]
        cut = self.allowed[pair]
        cut[1:] &= ~self.after_space[pair[:-1]]
        return np.flatnonzero(cut) + 1

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at forced boundaries, each fragment of ``fragment_bytes`` at least."""
        if len(raw) <= max(1, self.fragment_bytes):
            return [raw]
        at, cuts = self.boundaries(raw), [0]
        if self.fragment_bytes <= 1:
            cuts += at.tolist()
            at = at[:0]
        while (i := int(np.searchsorted(at, cuts[-1] + self.fragment_bytes))) < len(at):
            cuts.append(int(at[i]))
        return [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)]

    def _rank_encoder(self, model: dict):
        """A faster encoder of the same vocabulary, where merges rank as their ids do; else none."""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        made = [model["vocab"][a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            return None
        import tiktoken

        ranks = {raw: i for i, raw in enumerate(self.tokens) if i not in self.special_ids.values()}
        return tiktoken.Encoding("fragments", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _encode_fragment(self, raw: bytes) -> bytes:
        if self.fast is not None:
            try:
                ids = self.fast.encode_ordinary(raw.decode())
                return struct.pack(f"<{len(ids)}I", *ids)
            except (ValueError, RuntimeError):  # its pattern gave up on a run without any boundary
                pass
        return np.asarray(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text."""
        out, text = [np.zeros(0, "<u4")], text or ""
        for i, piece in enumerate(self.special.split(text) if any(map(text.__contains__, self.special_ids)) else [text]):
            if i % 2:
                out.append(np.asarray([self.special_ids[piece]], "<u4"))
            elif piece:
                out.append(np.frombuffer(b"".join(map(self.memo.__getitem__, self.fragments(piece.encode()))), "<u4"))
        return np.concatenate(out)

    def encode_each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text, in order."""
        return map(self.encode, texts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens kept; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str | None = None) -> ForcedBoundaryCodec:
    """The codec of a vocabulary file, made once in each worker; without a path, of the default one."""
    return ForcedBoundaryCodec(path or vocabulary_path())


def encode_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([x.astype(np.int32) for x in own.encode_each(texts)], dtype=object)

    return small_batches(docs).select(F.col(id_col), ids(F.col(text_col)).alias("ids"))


def decode_ids(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids give null text."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([None if r is None else own.decode(np.asarray(r, np.int64)) for r in rows], dtype=object)

    return encoded.select(F.col(id_col), text(F.col(ids_col)).alias("text"))


DIGEST_TYPE = T.StructType(
    [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
    ]
)


def round_trip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every row is encoded and its ids decoded again.

    Both directions run in one pass, so ids are never shuffled or written.
    """

    @F.pandas_udf(DIGEST_TYPE)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for texts in batches:
            rows = []
            for ids in own.encode_each(texts):
                rows.append((len(ids), sha256_hex(ids.tobytes()), sha256_hex(own.decode(ids))))
            yield pd.DataFrame(rows, columns=DIGEST_TYPE.names)

    return small_batches(docs).select(F.col(id_col), digests(F.col(text_col)).alias("found")).select(id_col, "found.*")
