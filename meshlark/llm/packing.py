"""Operator 3: best-fit packing after a dominance reduction.

Only lengths matter for packing, and there are at most `capacity` of them, so the instance is
the histogram of piece lengths (at most 4096 rows, whatever the corpus). On it:

1. Reduction. The longest piece j leaves room r. If nothing fits beside it, {j} is a sequence.
   If the longest fitting piece a fills r exactly, or no two pieces fit together in r, {j, a}
   dominates every alternative. If at most two fit, {j, a} dominates where a is at least as
   long as any fitting pair together, and {j, a, b}, b the longest that fits beside a,
   dominates where each fitting pair's shorter piece is at most b or the pair is at most a.
   Such sets are fixed for as many copies as there are, and the instance shrinks; passes
   repeat until nothing more is fixed.
2. Best fit. What remains goes, longest first, each piece to the fullest sequence that can
   take it, many equal pieces at a time.

The plan is a table of (length, first rank, sequence, place) with a bound that depends on the
capacity alone, so it is sent to all tasks. A piece's rank among those of its length comes
from counts per block of rows and length; no group of equal lengths meets in one task.

Edge cases: null or empty text is the end id alone; repeated rows are pieces of their own;
null ids stay null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import coder
from .common import documents, partition_id, shared_folder, slices, spread, written

CAPACITY, END = 4096, 1
#: Rows of a block, within which a piece's rank is counted while tokenising.
BLOCK = 1 << 14
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, place long"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's pieces; only documents longer than the capacity are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, block, seen, ranks = coder(path), partition_id() << 32, 0, np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            rows, kept = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(c.encode(t), np.uint32(end_id))
                for p, lo in enumerate(range(0, len(ids), capacity)):
                    if seen == BLOCK:
                        block, seen = block + 1, 0
                        ranks[:] = 0
                    part = ids[lo : lo + capacity]
                    rows.append((i, p, lo, len(part), zlib.crc32(part.astype("<u4").tobytes()), block, int(ranks[len(part)])))
                    ranks[len(part)] += 1
                    seen += 1
                    if with_ids:
                        kept.append(part.astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * 7, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "place"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names + ["ids"] * with_ids)

    return spread(documents(df, id_col, text_col)).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def _fits(left: np.ndarray, room: int) -> int:
    """The longest length of which there is a piece, up to room; 0 if none."""
    found = np.flatnonzero(left[1 : room + 1]) if room > 0 else ()
    return int(found[-1]) + 1 if len(found) else 0


def _smallest(left: np.ndarray, n: int) -> list[int]:
    out: list[int] = []
    for s in np.flatnonzero(left)[:n].tolist():
        out += [s] * min(int(left[s]), n - len(out))
        if len(out) == n:
            break
    return out


def _dominating(left: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """The companions of one piece of length j (already taken out of left) in a set that dominates all others, or None."""
    room = capacity - j
    a = _fits(left, room)
    if not a:
        return ()
    few = _smallest(left, 3)
    if a == room or len(few) < 2 or few[0] + few[1] > room:
        return (a,)
    if len(few) == 3 and sum(few) <= room:
        return None
    left[a] -= 1
    b = _fits(left, room - a)
    left[a] += 1
    lengths = np.flatnonzero(left[: room + 1])
    longest_pair = shorter = 0  # over fitting pairs: their greatest sum; the greatest sum of those whose shorter piece is over b
    for y in lengths.tolist():
        left[y] -= 1
        x = _fits(left, room - y)
        left[y] += 1
        if x >= y:
            longest_pair = max(longest_pair, x + y)
            if y > b:
                shorter = max(shorter, x + y)
    if longest_pair <= a:
        return (a,)
    return (a, b) if b and shorter <= a else None


def reduce(counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Fixed (set as length -> copies, how many of such sequences) and the histogram that remains."""
    left, fixed, again = counts.copy(), [], True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while left[j]:
                left[j] -= 1
                more = _dominating(left, j, capacity)
                left[j] += 1
                if more is None:
                    break
                need: dict[int, int] = {}
                for s in (j, *more):
                    need[s] = need.get(s, 0) + 1
                n = min(int(left[s]) // q for s, q in need.items())
                for s, q in need.items():
                    left[s] -= n * q
                fixed.append((need, n))
                again = True
    return fixed, left


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram, equal pieces at a time."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, group: tuple[dict[int, int], int]) -> None:
        if group[1]:
            open_.setdefault(room, []).append(group)
            rooms[room] = True

    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            tight = np.flatnonzero(rooms[s:])
            if len(tight):
                room = s + int(tight[0])
                have, m = open_[room].pop()
                if not open_[room]:
                    rooms[room] = False
            else:
                room, have, m = capacity, {}, n
            most = room // s  # a sequence that took one piece is then the fullest that can take the next
            whole = min(m, n // most)
            put(room - most * s, (have | {s: most}, whole))
            n -= whole * most
            m -= whole
            if m and n and n < most:
                put(room - n * s, (have | {s: n}, 1))
                m, n = m - 1, 0
            if have:
                put(room, (have, m))
    return [g for groups in open_.values() for g in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """Sorted arrays (length and first rank as one key, first rank, first sequence, copies a sequence, offset)."""
    fixed, left = reduce(counts, capacity)
    rank, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for need, n in fixed + best_fit(left, capacity):
        offset = 0
        for s, q in need.items():
            rows.append(((s << 48) + int(rank[s]), int(rank[s]), sequence, q, offset))
            rank[s] += n * q
            offset += s * q
        sequence += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in (zip(*rows) if rows else [[]] * 5))


def packed(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids) of every piece."""
    rows = written(pieces(df, path, capacity, end_id, id_col, text_col, with_ids), shared_folder(df.sparkSession), "pieces")
    counts = rows.groupBy("block", "length").count()
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    keys, firsts, sequences, copies, offsets = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("block").alias("base_block"), F.col("length").alias("base_length"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = rows.join(bases, (rows.block == bases.base_block) & (rows.length == bases.base_length)).select(*names, (F.col("base") + F.col("place")).alias("rank"), *(["ids"] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            nth = rank - firsts[at]
            arrays = [*b.columns[:5], pa.array(sequences[at] + nth // copies[at]), pa.array(offsets[at] + nth % copies[at] * length)]
            yield pa.RecordBatch.from_arrays(arrays + b.columns[6:], [*names, "sequence_id", "offset"] + ["ids"] * with_ids)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences of packed(..., with_ids=True); a group holds at most `capacity` ids."""
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
