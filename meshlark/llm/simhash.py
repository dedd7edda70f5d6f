"""Operator 6: SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most 3 of 64 bits differ in at most 3 of 8 bytes, so they share
at least 5 bytes at equal positions. Posting lists of single bytes would each hold a 256th of
all fingerprints; the index therefore keys on four positions at a time, for the 14 sets of
four positions whose numbers XOR to zero. Any three positions lie together in exactly one of
these sets, and each set's complement is one of them too, so two fingerprints that share 5
positions or more meet in at least one list. The steps after that are those of any inverted
index: pairs that meet in a list are candidates; the tally counts the shared positional bytes of
each, in the first list in which the pair meets, and drops pairs below the guaranteed 5; what is
retained is verified by its differing bits.

Rows are first reduced to distinct fingerprints, so copies cost one posting set. A posting list
longer than HEAVY is split by a fifth byte, one of the other four positions, which again must
agree in at least one; the tally of 5 then lies in the key. Only lists of near copies are long
even then. A split list longer than DENSE is linked without listing its pairs: its members differ
in three bytes at most, so there are at most 2^24 of them (128 MB) in one task, and one table over
those 24 bits tells whether any of the 2324 neighbours within 3 bits is a member. Its links come
as stars, one edge for each member but one of a connected part, which keeps every component as it
is. Work is linear in the list. Links form components by alternating large-star and small-star
rounds over tables in the shared folder.

Edge cases: null or empty text and text of white space have fingerprint 0 and link like any
other; repeated rows share a fingerprint and component; null ids are never the smallest id of
a component that has others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, shared_folder, slices, spread, written

SHINGLE, SEED, BITS = 3, 42, 3
SHARED = 8 - BITS
#: Sets of four byte positions, see above.
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
#: The 56 sets of five positions that hold one of them.
FINE = sorted({tuple(sorted((*s, p))) for s in BLOCKS for p in range(8) if p not in s})
#: Posting lists longer than this are split by a fifth byte; split lists longer than DENSE are linked by stars.
HEAVY, DENSE = 32, 64
HASHES = 1 << 16
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned SimHash of a whole text."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return 0
    one, total, counts = xxhash.xxh64_intdigest, max(1, len(words) - size + 1), np.zeros((8, 256), np.int64)
    for lo in range(0, total, HASHES):
        part = words[lo : lo + HASHES + size - 1]
        n = min(HASHES, total - lo)
        shingles = map(b" ".join, zip(*(part[k : k + n] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
        h = np.fromiter((one(s, SEED) for s in shingles), np.uint64, n).view(np.uint8).reshape(n, 8)
        for k in range(8):
            counts[k] += np.bincount(h[:, k], minlength=256)
    bits = (counts @ _BITS).ravel() * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, text_hash): the fingerprint's bits as a signed integer, and xxhash64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["doc_id", "fp", "text_hash"])

    return spread(documents(df, id_col, text_col)).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _byte(fp: Column, p: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))


def _key(fp: Column, tag: int, positions: tuple[int, ...]) -> Column:
    """tag and the bytes at the positions as one integer."""
    out = F.lit(tag).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8) + _byte(fp, p)
    return out


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(255 << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _postings(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    fp = F.col("fp")
    return fps.select("fp", F.posexplode(F.array(*(_key(fp, t, s) for t, s in enumerate(sets)))).alias("tag", "key"))


def candidates(postings: DataFrame) -> DataFrame:
    """(a, b, tag) with a < b for each pair of fingerprints in a list of postings (key, tag, fp)."""
    a, b = postings.alias("a"), postings.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), F.col("a.tag").alias("tag"))


def tallied(pairs: DataFrame, sets: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Candidates with SHARED or more shared positional bytes, each by the first of `sets` in which it meets."""
    x = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.when(_byte(x, p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))
    kept = pairs.withColumn("shared", shared).where(F.col("shared") >= SHARED)
    if sets is None:
        return kept
    first = F.when(F.lit(False), F.lit(-1))
    for tag, positions in enumerate(sets):
        first = first.when(x.bitwiseAND(F.lit(_mask(positions)).cast("long")) == 0, F.lit(tag))
    return kept.where(first == F.col("tag"))


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that differ in BITS bits or fewer."""
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")


def split_postings(heavy: DataFrame) -> DataFrame:
    """The postings of long lists in lists by a fifth byte."""
    # the 56 sets of five positions
    of_block = F.array(*(F.array(*(F.lit(FINE.index(tuple(sorted((*s, p))))) for p in range(8) if p not in s)) for s in BLOCKS))
    keys = F.array(*(_key(F.col("fp"), t, s) for t, s in enumerate(FINE)))
    return heavy.select("fp", F.explode(F.element_at(of_block, F.col("tag") + 1)).alias("tag")).distinct().select("tag", "fp", F.element_at(keys, F.col("tag") + 1).alias("key"))


def parts(codes: np.ndarray) -> np.ndarray:
    """The smallest position of each distinct 24-bit code's connected part, codes within BITS bits being linked.

    Every code looks up its neighbours in one table or, if there are fewer codes than neighbours,
    meets the other codes. Parts are joined by hooking each to the least that it meets; at least
    every second part that has a link goes away in a round.
    """
    n = len(codes)
    label = np.arange(n)
    masks = [sum(1 << b for b in bits) for k in range(1, BITS + 1) for bits in combinations(range(24), k)]
    if n > len(masks):
        place = np.full(1 << 24, -1, np.int32)
        place[codes] = np.arange(n, dtype=np.int32)

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if n <= len(masks):
            for k in range(1, n):
                i = np.flatnonzero(np.bitwise_count(codes[:-k] ^ codes[k:]) <= BITS)
                yield i, i + k
        else:
            for m in masks:
                j = place[codes ^ m]
                i = np.flatnonzero(j > np.arange(n))
                yield i, j[i]

    again = True
    while again:
        again, parent = False, np.arange(n)
        for i, j in links():
            a, b = label[i], label[j]
            differ = a != b
            if differ.any():
                again = True
                a, b = a[differ], b[differ]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]
    return label


def stars(postings: DataFrame) -> DataFrame:
    """Edges (a, b) of the connected parts of each list of postings (key, tag, fp) by five bytes: stars around each part's first."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        fp = np.unique(rows["fp"].to_numpy())
        free = [p for p in range(8) if p not in FINE[rows["tag"][0].as_py()]]
        codes = sum(((fp >> 8 * p) & 255) << 8 * k for k, p in enumerate(free))
        label = parts(codes)
        far = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[label[far]], "b": fp[far]})

    return postings.select("key", "tag", "fp").groupBy("key").applyInArrow(run, "a long, b long")


def links(fps: DataFrame, folder: str) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) at BITS or fewer differing bits; of dense lists, stars in their place."""
    postings = _postings(fps, BLOCKS)
    sizes = postings.groupBy("key").count().where(F.col("count") > 1)
    # lists of one fingerprint make no pair; long lists go to the finer index
    sized = written(postings.join(sizes, "key"), folder, "postings")
    light = verified(tallied(candidates(sized.where(F.col("count") <= HEAVY).select("key", "tag", "fp")), BLOCKS))
    fine = written(split_postings(sized.where(F.col("count") > HEAVY)), folder, "split")
    lengths = fine.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    fine = written(fine.join(lengths, "key"), folder, "split-sized")
    short = verified(tallied(candidates(fine.where(F.col("length") <= DENSE))))
    dense = stars(fine.where(F.col("length") > DENSE))
    # a pair may meet in a short list of one set and a long list of another
    return light.union(short).union(dense).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of edges (a, b): the smallest node reachable, by alternating stars."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), folder, "edges-0")
    state, k = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        e = written(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), folder, f"edges-{k + 1}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        k += 1
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash, component_id) of every row."""
    folder = shared_folder(df.sparkSession)
    rows = written(fingerprints(df, id_col, text_col), folder, "fingerprints")
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), folder, "groups")
    roots = components(links(groups.select("fp"), folder), folder)
    linked = groups.join(roots, groups.fp == roots.node).select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "root").select(F.col("fp").alias("linked_fp"), "component_id")
    known = groups.join(linked, groups.fp == linked.linked_fp, "left").select(groups.fp.alias("group_fp"), F.coalesce("component_id", "first_id").alias("component_id"))
    known = written(known, folder, "known")  # both sides are plain tables, so that the join can split a large group of copies
    return rows.join(known, rows.fp == known.group_fp).select("doc_id", "fp", "text_hash", "component_id")


def fingerprint_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the fingerprint as 16 lowercase hex digits."""
    return near_duplicates(df, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without those whose component has a smaller id; rows without an id stay."""
    found = near_duplicates(df, id_col, text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash")).distinct()
    gone = written(gone)  # the planner then knows its size: a small one is broadcast, and the texts stay where they are
    return df.join(gone, (df[id_col] == gone["__gone_id"]) & (F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))) == gone["__gone_hash"]), "left_anti")
