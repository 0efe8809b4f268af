"""Packing token streams into sequences of 2,048 by cutting-stock column generation.

1. Each document is encoded and cut into whole sequences, one piece of a multiple of 32 tokens, and one of
   fewer than 32.  So there are 95 lengths of pieces, however many documents.
2. The histogram of lengths (at most 95 numbers) goes to the driver.  A linear program chooses patterns, that
   is, sets of lengths that fill a sequence, for the fewest sequences.  Columns are generated: a knapsack over
   the dual prices finds the pattern that improves the program most, until none does.
3. Pattern counts are rounded down.  Pieces have a rank among those of their length; patterns take ranks in
   order, so the place of a piece follows from its length and rank alone.
4. Pieces that rounding left over, and those of patterns with waste, form one stream, longest first, cut at
   each 2,048 tokens; what is left at its end is cut at powers of two, which need no padding.

The rank is a number within the task that encoded the document plus the number of pieces of that length in
earlier tasks.  Pieces are never sorted, and those of one length never meet in one task.

Null text counts as empty; each document ends with the id ``end_id``, so it has one token at least.  Each input
row is a document of its own, also where ids repeat.  An empty table gives an empty result.  Only the id and
the text column are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import small_batches, stored, tidy

SEQUENCE = 2048
BLOCK = 32
END_ID = 1
#: Lengths that patterns are made of.
SIZES = np.asarray([*range(1, BLOCK), *range(BLOCK, SEQUENCE, BLOCK)])
#: Columns are generated until the lower bound of the linear program is as near as this share of its value.
GAP = 1e-7

PIECE_SCHEMA = "doc_id long, start long, size int, crc long, doc_tokens long, part int, local_rank long, blocks binary, ids binary"
PACKED_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- checksums of parts ------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """For each byte of a CRC-32, what it becomes when a block of tokens is appended."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    state = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(4 * BLOCK):
        state = (state >> 8) ^ step[state & 255]
    return state


def joined_crc(crcs: list[int]) -> int:
    """The CRC-32 of blocks of ``BLOCK`` tokens in a row, from the CRC-32 of each."""
    t, total = _shift_tables(), 0
    for i, c in enumerate(crcs):
        total = int(t[0, total & 255] ^ t[1, total >> 8 & 255] ^ t[2, total >> 16 & 255] ^ t[3, total >> 24]) ^ c if i else c
    return total


# --- patterns ----------------------------------------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int = SEQUENCE) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the greatest value that fits, by dynamic programming over the sizes.

    The best that some copies of a size add to what smaller sizes hold is a running maximum along the steps of that size.
    """
    tables = [np.zeros(room + 1)]
    for size, value in zip(sizes.tolist(), values.tolist(), strict=True):
        steps = -(-(room + 1) // size)
        held = np.full(steps * size, -np.inf)
        held[: room + 1] = tables[-1]
        paid = value * np.arange(steps)[:, None]
        tables.append((np.maximum.accumulate(held.reshape(steps, size) - paid, axis=0) + paid).ravel()[: room + 1])
    counts, c = np.zeros(len(sizes), int), room
    for i in range(len(sizes) - 1, -1, -1):
        copies = np.arange(c // int(sizes[i]) + 1)
        counts[i] = int((tables[i][c - copies * int(sizes[i])] + copies * values[i]).argmax())
        c -= counts[i] * int(sizes[i])
    return float(tables[-1][room]), counts


def generate_columns(sizes: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often to use each, for the fewest sequences: revised simplex with pricing.

    Starts from patterns of one size.  With the value of the best pattern at the present prices, the program's value divided by it is a
    lower bound; columns are generated until that bound is reached, however many it takes.  The demand is made a little
    larger, by another share for each size, so that no step leaves the value as it is and none repeats.
    """
    basis = np.diag(SEQUENCE // sizes).astype(float)
    spread = demand * (1 + 1e-6 * np.sqrt(np.arange(2, len(sizes) + 2))) + 1e-6 * np.sqrt(np.arange(2, len(sizes) + 2))
    while True:
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_pattern(sizes, prices)
        if value <= 1 + GAP:
            break
        use, step = np.linalg.solve(basis, np.stack([spread, column], 1)).T
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return np.rint(basis).astype(int), np.linalg.solve(basis, demand)


@dataclass
class Plan:
    """Where pieces go: patterns with their counts, then the stream of what is left."""

    whole: int = 0
    patterns: list[tuple[np.ndarray, int]] = field(default_factory=list)
    demand: np.ndarray = field(default_factory=lambda: np.zeros(len(SIZES), np.int64))

    def __post_init__(self):
        self.covered = np.zeros(len(SIZES), np.int64)
        self.ranges: list[list[tuple[int, int, int, int]]] = [[] for _ in SIZES]  # from rank, a time, first sequence, offset
        base = self.whole
        for column, times in self.patterns:
            offset = 0
            for i in np.flatnonzero(column)[::-1]:
                self.ranges[i].append((int(self.covered[i]), int(column[i]), base, offset))
                self.covered[i] += int(column[i]) * times
                offset += int(column[i]) * int(SIZES[i])
            base += times
        self.stream_base = base
        left = (self.demand - self.covered) * SIZES
        self.stream_at = np.cumsum(left[::-1])[::-1] - left  # longest first
        total = int(left.sum())
        tail, at = total % SEQUENCE, total - total % SEQUENCE
        self.tail_edges = [at]
        for power in (1 << b for b in reversed(range(SEQUENCE.bit_length()))):
            if tail & power:
                self.tail_edges.append(self.tail_edges[-1] + power)
        self.full_bins = at // SEQUENCE

    def bin_of(self, position: int) -> tuple[int, int, int]:
        """The sequence that holds a position of the stream, and its first and last position."""
        if position < self.tail_edges[0]:
            n = position // SEQUENCE
            return self.stream_base + n, n * SEQUENCE, (n + 1) * SEQUENCE
        n = int(np.searchsorted(self.tail_edges, position, "right")) - 1
        return self.stream_base + self.full_bins + n, self.tail_edges[n], self.tail_edges[n + 1]


def make_plan(histogram: dict[int, int]) -> Plan:
    """The plan for a histogram of piece lengths."""
    demand = np.asarray([histogram.get(int(s), 0) for s in SIZES], np.int64)
    some = np.flatnonzero(demand)
    patterns = []
    if len(some):
        columns, use = generate_columns(SIZES[some], demand[some].astype(float))
        left = demand[some].copy()
        for column, x in sorted(zip(columns.T.tolist(), use, strict=True)):
            column = np.asarray(column)
            times = int(x + 1e-6)
            held = column > 0
            if held.any():
                times = min(times, int((left[held] // column[held]).min()))
            if times > 0 and int(column @ SIZES[some]) == SEQUENCE:
                left -= column * times
                whole = np.zeros(len(SIZES), int)
                whole[some] = column
                patterns.append((whole, times))
    return Plan(histogram.get(SEQUENCE, 0), patterns, demand)


# --- pieces ------------------------------------------------------------------------------------------------------


def cut(ids: np.ndarray) -> Iterator[tuple[int, int, int, bytes | None, bytes | None]]:
    """The pieces of a document: start, size, CRC-32, CRC-32 of each block (for a middle piece), ids (for a short one)."""
    raw, n = ids.tobytes(), len(ids)
    whole, short = n - n % SEQUENCE, n - n % BLOCK
    for at in range(0, whole, SEQUENCE):
        yield at, SEQUENCE, zlib.crc32(raw[4 * at : 4 * (at + SEQUENCE)]), None, None
    if short > whole:
        blocks = [zlib.crc32(raw[4 * a : 4 * (a + BLOCK)]) for a in range(whole, short, BLOCK)]
        yield whole, short - whole, zlib.crc32(raw[4 * whole : 4 * short]), np.asarray(blocks, "<u4").tobytes(), None
    if n > short:
        yield short, n - short, zlib.crc32(raw[4 * short :]), None, raw[4 * short :]


def piece_rows(path: str | None, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part = codec(path), TaskContext.get().partitionId()
        seen = np.zeros(SEQUENCE + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].array, own.encode_each(batch["text"].array), strict=True):
                ids = np.append(ids, np.asarray([end_id], "<u4"))
                for start, size, crc, blocks, short in cut(ids):
                    rows.append((doc_id, start, size, crc, len(ids), part, int(seen[size]), blocks, short))
                    seen[size] += 1
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def placed(plan: Plan):
    """A function of batches of ranked pieces that gives their places."""

    def stream_parts(row) -> Iterator[tuple]:
        i = int(np.searchsorted(SIZES, row.size_))
        at = int(plan.stream_at[i] + (row.rank - plan.covered[i]) * row.size_)
        done = 0
        while done < row.size_:
            sequence, first, last = plan.bin_of(at + done)
            take = min(row.size_ - done, last - at - done)
            if take == row.size_:
                crc = row.crc
            elif row.ids is not None:
                crc = zlib.crc32(row.ids[4 * done : 4 * (done + take)])
            else:
                crc = joined_crc(np.frombuffer(row.blocks, "<u4")[done // BLOCK : (done + take) // BLOCK].tolist())
            yield row.doc_id, row.start + done, take, crc, row.doc_tokens, sequence, at + done - first
            done += take

    names = [f.split()[0] for f in PACKED_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size, rank = batch["size"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.where(size == SEQUENCE, rank, -1), np.zeros(len(batch), np.int64)
            for s in np.unique(size[size < SEQUENCE]):
                i = int(np.searchsorted(SIZES, s))
                if ranges := plan.ranges[i]:
                    rows = np.flatnonzero((size == s) & (rank < plan.covered[i]))
                    start, each, base, first = np.asarray(ranges, np.int64).T
                    p = np.searchsorted(start, rank[rows], "right") - 1
                    j = rank[rows] - start[p]
                    sequence[rows] = base[p] + j // each[p]
                    offset[rows] = first[p] + j % each[p] * s
            done = sequence >= 0
            fixed = batch[done]
            yield pd.DataFrame(
                {
                    "doc_id": fixed["doc_id"].astype("Int64"),
                    "start": fixed["start"],
                    "length": fixed["size"].astype("int64"),
                    "ids_crc32": fixed["crc"],
                    "doc_tokens": fixed["doc_tokens"],
                    "sequence_id": sequence[done],
                    "offset": offset[done],
                }
            )
            if not done.all():
                rest = batch[~done].rename(columns={"size": "size_"})
                out = pd.DataFrame([x for row in rest.itertuples(index=False) for x in stream_parts(row)], columns=names)
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return run


def pack_documents(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> DataFrame:
    """One row per piece: where in its document it begins, and where in which sequence it lies."""
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(own.mapInPandas(tidy(piece_rows(path, end_id)), PIECE_SCHEMA), "pieces")
    # Ranks begin at 0 in each task, so the greatest one counts a task's pieces of that length.
    counts = stored(pieces.groupBy("size", "part").agg((F.max("local_rank") + 1).alias("n")), "piece_counts")
    plan = make_plan({r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()})
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["size", "part"]).withColumn("rank", F.col("local_rank") + F.col("earlier"))
    return ranked.drop("part", "local_rank", "earlier").mapInPandas(tidy(placed(plan)), PACKED_SCHEMA)
