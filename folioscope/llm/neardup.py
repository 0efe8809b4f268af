"""Near-duplicates: MinHash bands find candidates, odd sketches sift them, whole sets confirm them.

A document's set holds its distinct shingles of ``SHINGLE`` words (with fewer words, the whole sequence as
one).  Two documents are linked if ``100 * intersection >= threshold * union``.  The result is one row per
input row with the smallest id of its connected component.

1.  One pass over the texts gives each document the size and digest of its set, ``BANDS`` band keys of
    ``ROWS`` MinHash values, and an odd sketch: the parity of MinHash samples that fall on each of 512 bits.
2.  Equal sets become one node, that of the smallest id, so copies cost one comparison.
3.  Each node is paired with the smallest node of each band bucket it is in.  Pairs whose sketches differ in
    more bits than ``MAX_ODD_BITS`` are dropped; the rest are compared on their whole sets.
4.  Components are taken.  In a bucket whose members are still in several components, each member outside the
    largest one is joined with members of other components.  Sketches are compared inside the join, and so are
    the rarest shingles of both sets, which bound the intersection exactly.  Only pairs that may be similar
    leave the join.  These are confirmed too, and components are taken again.

Members of one component need no further comparison, so a group of near copies costs a number of pairs
in proportion to its size.  There is no cap on buckets, partners or candidates.  A pair at the threshold of
0.8 shares no band with a probability of 5e-7; the sketch drops one with less than 1e-7.

Words are runs of characters other than space and control characters 9 to 13, with A-Z lower-cased.  Null
and empty texts have no shingles and are linked with nothing.  Ids identify documents: rows that repeat an id
get the same component.  A row without an id is linked with nothing, has no component and is kept.  Empty
tables give empty results.  Only the id and the text column are read.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import blocks_for, bloom_filter, may_hold
from .common import Scratch, small_batches, stored, tidy

SHINGLE = 4
THRESHOLD = 80
BANDS, ROWS = 48, 6
#: Samples that an odd sketch folds, its 64-bit words, and the most bits in which two sketches may differ.  With
#: 256 samples, similarity 0.8 gives 84 on average; 140 is over six standard deviations more.
ODD_SAMPLES, ODD_WORDS, MAX_ODD_BITS = 256, 8, 140
SEED = 20_240_731
#: Words whose hashes a worker keeps during a task.
WORD_TABLE = 150_000

SKETCH_SCHEMA = "id long, n_shingles long, k1 long, k2 long, bands array<long>, odd array<long>"
SET_SCHEMA = "id long, shingles array<long>"

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles of a whole text, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = mixed(total * _MIX + h[k : len(h) - width + 1 + k])
    return np.unique(total)


@lru_cache(maxsize=1)
def _hash_functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    odd = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd[:, None], rng.integers(0, 2**32, n, dtype=np.uint32)[:, None], rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    times, xor, _ = _hash_functions()
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(times), 2**32 - 1, np.uint32)
    for at in range(0, len(short), 1024):
        part = np.bitwise_xor(short[None, at : at + 1024], xor)
        part *= times
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    _, _, salt = _hash_functions()
    own = mixed(least.astype(np.uint64) + salt).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * _MIX + own[:, k])
    return keys.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    _, _, salt = _hash_functions()
    bits = mixed(least[:ODD_SAMPLES].astype(np.uint64) ^ salt[:ODD_SAMPLES]) % np.uint64(64 * ODD_WORDS)
    parity = (np.bincount(bits.astype(np.int64), minlength=64 * ODD_WORDS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def _sketches(size: int):
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"].array, batch["text"].array, strict=True):
                own = shingle_set(text, size)
                if len(own):
                    least = minhashes(own)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
                    rows.append((i, len(own), *digest, band_keys(least), odd_sketch(least)))
                else:
                    rows.append((i, 0, 0, 0, none, none))
            out = pd.DataFrame(rows, columns=["id", "n_shingles", "k1", "k2", "bands", "odd"])
            out["id"] = out["id"].astype("Int64")
            yield out
        _words.clear()

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, size).view(np.int64) for t in batch["text"].array]
            yield pd.DataFrame({"id": batch["id"], "shingles": pd.Series(sets, dtype=object)})
        _words.clear()

    return run


def odd_distance(a: str, b: str) -> Column:
    """The number of bits in which two sketches differ."""
    bits = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(ODD_WORDS)]
    return reduce(lambda x, y: x + y, bits)


def _similar_sizes(a: str, b: str, threshold: int) -> Column:
    return 100 * F.least(F.col(a), F.col(b)) >= threshold * F.greatest(F.col(a), F.col(b))


def shingle_sets(ids: DataFrame, docs: DataFrame, size: int, at_most: int) -> DataFrame:
    """(id, shingles) of the documents among ``ids``, of which there are ``at_most`` so many.

    A Bloom filter of the ids, of a size that this number gives, goes ahead of the join, so that texts of other documents are not shuffled.
    """
    blocks = blocks_for(at_most)
    likely = docs.where(may_hold(bloom_filter(ids, "id", blocks).scalar(), F.col("id"), blocks))
    return likely.join(ids, "id", "left_semi").mapInPandas(tidy(_sets(size)), SET_SCHEMA)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) of ids, those whose whole sets are similar enough; a set travels to each pair it is in."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= threshold * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def rare_prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(id, prefix): the rarest shingles of each set among these sets, as (count, shingle), ascending.

    So many that sets which are similar enough share some.  Ids with several rows are left out.
    """
    single = sets.groupBy("id").agg(F.count("*").alias("rows")).where("rows = 1").select("id")
    held = sets.join(single, "id", "left_semi").select("id", F.explode("shingles").alias("s"))
    counts = held.groupBy("s").agg(F.count("*").alias("n"))
    ranked = held.join(counts, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("all"))
    size = F.size("all") - F.ceil(F.size("all") * threshold / 100).cast("int") + 1
    return ranked.select("id", F.slice("all", F.lit(1), size).alias("prefix"))


def _may_share_enough(x: str, y: str, nx: str, ny: str, threshold: int) -> Column:
    """False only where prefixes show that two sets share too few shingles.

    Whole shingles are compared and put in order.  Up to the lower of the last places of both prefixes all shared ones are known; beyond it there are no
    more of them than either set has left.
    """
    last = F.least(F.element_at(x, -1), F.element_at(y, -1))
    left = F.least(*(F.col(n) - F.size(F.filter(p, lambda v: v <= last)) for p, n in ((x, nx), (y, ny))))
    most = F.size(F.array_intersect(F.col(x)["s"], F.col(y)["s"])) + left
    return F.coalesce((100 + threshold) * most >= threshold * (F.col(nx) + F.col(ny)), F.lit(True))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round hooks a node to its smallest smaller neighbour, shortens the paths to their roots, and puts roots
    in place of nodes in the edges, until no edge is left.  Rounds are written to the shared folder.
    """
    keep = Scratch(edges.sparkSession, "components")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = keep(edges.where("a <> b").select(*pair).distinct(), "edges")
    nodes = None
    while not left.isEmpty():
        roots = keep(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            longer = roots.join(up, "root")
            if longer.isEmpty():
                break
            jumped = roots.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            roots = keep(jumped, "hooks")
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(a, "a", "left").join(b, "b").select(F.coalesce("ra", "a").alias("a"), F.col("rb").alias("b"))
        left = keep(moved.where("a <> b").select(*pair).distinct(), "edges")
        if nodes is None:
            nodes = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            older = nodes.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            nodes = keep(older.unionByName(roots), "nodes")
    if nodes is None:
        nodes = left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    own = nodes.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct()
    named = stored(nodes.select("node", F.col("root").alias("component")).unionByName(own), "components", True)
    keep.drop()
    return named


def sifted(pairs: DataFrame, odd: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those of similar sizes and sketches; ``odd`` is (id, n_shingles, odd)."""
    a = odd.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("odd").alias("oa"))
    b = odd.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("odd").alias("ob"))
    near = pairs.join(a, "a").join(b, "b").where(_similar_sizes("na", "nb", threshold))
    return near.where(odd_distance("oa", "ob") <= MAX_ODD_BITS).select("a", "b")


def open_rows(grouped: DataFrame) -> DataFrame:
    """Members (key, id, center, component) of buckets that still hold several components, with the largest of these.

    The centre is left out: pairs with it have been compared.
    """
    sizes = grouped.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("n", "component")).alias("most"))
    several = largest.where("groups > 1").select("key", F.col("most.component").alias("largest"))
    return grouped.where("id <> center").join(several, "key").select("key", "id", "component", "largest")


def pairs_across(rest: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (a, b) of bucket members in different components that may be similar enough.

    Rows are (key, id, component, largest, n_shingles, odd, prefix).  Members of the largest component of a bucket are not
    paired with each other; the rest are paired once.
    """
    minor, known = F.col("component") != F.col("largest"), ("id", "component", "n_shingles", "odd", "prefix")
    x = rest.where(minor).select(F.col("key").alias("kx"), *(F.col(c).alias(f"{c}_x") for c in known))
    y = rest.select(F.col("key").alias("ky"), (~minor).alias("major_y"), *(F.col(c).alias(f"{c}_y") for c in known))
    across = (F.col("component_x") != F.col("component_y")) & (F.col("major_y") | (F.col("id_x") < F.col("id_y")))
    alike = _similar_sizes("n_shingles_x", "n_shingles_y", threshold) & (odd_distance("odd_x", "odd_y") <= MAX_ODD_BITS)
    possible = _may_share_enough("prefix_x", "prefix_y", "n_shingles_x", "n_shingles_y", threshold)
    found = x.join(y, (F.col("kx") == F.col("ky")) & across & alike & possible)
    return found.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def candidate_links(nodes: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Confirmed links (a, b) between nodes: enough of them that components come out as with all links."""
    keep = Scratch(nodes.sparkSession, "candidates")
    nodes = keep(nodes, "nodes")
    odd = nodes.select("id", "n_shingles", "odd")
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1").select("key", "center")
    members = keep(keyed.join(buckets, "key"), "members")
    pairs = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    star = keep(sifted(pairs, odd, threshold), "star")
    in_star = star.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = keep(confirmed(star, keep(shingle_sets(in_star, docs, size, 2 * star.count()), "sets"), threshold), "links")
    groups = connected_components(links).withColumnRenamed("node", "id")
    grouped = keep(members.join(groups, "id", "left").select("key", "id", "center", F.coalesce("component", "id").alias("component")), "grouped")
    rest = keep(open_rows(grouped), "rest")
    if not rest.isEmpty():
        sets = keep(shingle_sets(rest.select("id").distinct(), docs, size, rest.count()), "sets")
        known = rest.join(odd, "id").join(rare_prefixes(sets, threshold), "id", "left")
        others = keep(pairs_across(known, threshold), "others")
        links = links.unionByName(confirmed(others, sets, threshold))
    found = stored(links, "links", True)
    keep.drop()
    return found


def same_id_links(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id and differ in their sets; mostly there are none."""
    digest = F.struct("k1", "k2")
    several = sets.groupBy("id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low <> high").select("id")
    reps = sets.join(several, "id", "left_semi").join(classes, ["k1", "k2"]).select("id", "rep").distinct()
    first = reps.groupBy("id").agg(F.min("rep").alias("a"))
    return reps.join(first, "id").select("a", F.col("rep").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; kept is true for the smallest id of a component."""
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = stored(own.mapInPandas(tidy(_sketches(size)), SKETCH_SCHEMA), "sketches")
    sets = sketches.where("n_shingles > 0 AND id IS NOT NULL")
    # Written before they are joined: the plan can then split the rows of a digest that very many documents have.
    classes = stored(sets.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes", True)
    reps = classes.select(F.col("rep").alias("id"), "k1", "k2")
    nodes = sets.join(reps, ["id", "k1", "k2"], "left_semi").dropDuplicates(["id", "k1", "k2"])
    links = candidate_links(nodes.select("id", "n_shingles", "bands", "odd"), own, size, threshold)
    components = connected_components(links.unionByName(same_id_links(sets, classes)))
    named = classes.join(components, classes.rep == components.node, "left")
    named = stored(named.select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), "named", True)
    linked = sets.join(named, ["k1", "k2"]).select("id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
