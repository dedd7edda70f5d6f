"""Operator 7: quality scores by a factorisation machine.

A text's inputs are its hashed words (log counts, scaled to unit length), statistics of its
structure and its size. The machine adds to the linear terms all pairwise interactions
through low-rank factors, computed in linear time: half the difference between the square of
the factor sums and the sums of squares. Labels, language, source and id are never inputs.

It learns from at most `bound` labelled rows, chosen by a hash of their id (a documented
bound; every text is scored). Only hashed features of these rows reach the driver, one row for
each id.

Edge cases: null or empty text has zero word features and is scored like any other; without
labels every score is 0.5; of several labels of one id the lowest counts, of several texts the one
with the least hash; null ids are scored,
are not held out and teach nothing; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations


import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, spread

WORDS, RANK = 4096, 8
#: Labelled rows that the machine learns from, at most.
BOUND = 4000
THRESHOLD = 0.3
STATS = 24
SIZE = WORDS + STATS
#: Texts scored at a time.
BLOCK = 256
#: Bytes of a text whose words are hashed at a time.
PIECE = 1 << 20
_WHITE = b"\t\n\x0b\x0c\r "
_SPACE = np.isin(np.arange(256), list(_WHITE))
# odd multiplier of a word's polynomial in 64 bits, its powers, and the final mixing (fixed values)
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(64)], np.uint64)
_VALUES = np.where(_SPACE, 0, np.arange(1, 257)).astype(np.uint64)


def _hashed(data: np.ndarray) -> np.ndarray:
    """Buckets of the words of some bytes."""
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(first):
        return np.zeros(0, np.int32)
    lengths = np.empty_like(first)
    lengths[:-1], lengths[-1] = first[1:] - first[:-1], len(data) - first[-1]
    place = np.arange(first[0], len(data)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_VALUES[data[first[0] :]] * _POWERS[place & 63], first - first[0])
    return ((sums * np.uint64(_MIX)) >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int32)


def buckets(text: str) -> np.ndarray:
    """The bucket of each word (between ASCII white space) of a whole text, by a polynomial in its bytes; of a word above PIECE, by CRC-32."""
    data, lo, out = text.encode("utf-8", "surrogatepass"), 0, []
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        if hi < len(data):
            hi = max(data.rfind(w, lo, hi) for w in _WHITE) + 1
            if hi <= lo:
                ends = [e for w in _WHITE if (e := data.find(w, lo)) >= 0]
                hi = min(ends, default=len(data))
                out.append(np.array([zlib.crc32(data[lo:hi]) % WORDS], np.int32))
                lo = hi
                continue
        out.append(_hashed(np.frombuffer(data, np.uint8, hi - lo, lo)))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def statistics(text: str, words: list[str], ids: np.ndarray, most: int) -> list[float]:
    """Structure and size of a text; `most`: the count of its most frequent bucket."""
    n, chars = len(words), len(text)
    if not n:
        return [1, np.log1p(chars) / 10, 1, *[0] * (STATS - 3)]
    lines = text.count("\n") + 1
    digits = sum(map(text.count, "0123456789"))
    return [
        1, np.log1p(chars) / 10, 0,
        *(min(text.count(c) / n, 2) for c in ".,!|#$%&*"),
        sum(map(str.isupper, words)) / n,
        min(digits / chars * 5, 2),
        len(set(words)) / n,
        np.count_nonzero(ids[1:] == ids[:-1]) / (len(ids) - 1) if len(ids) > 1 else 0,
        chars / n / 10,
        np.log1p(lines) / 5,
        min(n / lines / 50, 2),
        np.log1p(most) / np.log1p(n),
        sum(map(str.istitle, words)) / n,
        np.count_nonzero(ids[2:] == ids[:-2]) / (len(ids) - 2) if len(ids) > 2 else 0,
        min(max(map(len, words)) / 50, 3),
        len(set(text.split("\n"))) / lines,
    ]


def inputs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the inputs that are not zero, by row; every row has some. Takes time linear in the words."""
    rows, columns, values = [], [], []
    for k, text in enumerate(texts):
        words = text.split()
        ids = buckets(text)
        ordered = np.sort(ids)
        change = np.ones(len(ids) + 1, bool)
        change[1:-1] = ordered[1:] != ordered[:-1]
        ends = np.flatnonzero(change)
        first, counts = (ends[:-1], ends[1:] - ends[:-1]) if len(ids) else (ends[:0], ends[:0])
        logs = np.log1p(counts)
        stats = np.array(statistics(text, words, ids, int(counts.max(initial=0))))
        some = np.flatnonzero(stats)
        columns += [ordered[first], WORDS + some]
        values += [logs / np.sqrt(logs @ logs), stats[some]] if len(ids) else [logs, stats[some]]
        rows.append(np.full(len(first) + len(some), k))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns]).astype(np.int64), np.concatenate([none, *values]).astype(np.float32)


class Machine:
    """Weights of a factorisation machine; score() gives probabilities."""

    def __init__(self, bias: float = 0.0, linear: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias = bias
        self.linear = np.zeros(SIZE, np.float32) if linear is None else linear
        self.factors = np.zeros((SIZE, RANK), np.float32) if factors is None else factors

    def raw(self, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores before the logistic function; a pair of inputs adds its values' product times its factors' product."""
        if not len(row):
            return np.zeros(0)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        parts = value[:, None] * self.factors[column]
        sums = np.add.reduceat(parts, first)
        return self.bias + np.add.reduceat(value * self.linear[column], first) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((parts**2).sum(1), first))

    def score(self, texts: list[str]) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.raw(*inputs(texts[i : i + BLOCK])), -30, 30))) for i in range(0, len(texts), BLOCK)]
        return np.concatenate(out).astype(float) if out else np.zeros(0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 25, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Adam over the logistic loss; rows are (positions, values) of the inputs that are not zero. Few rows: they are made dense."""
    m = Machine()
    if not len(labels):
        return m
    r = np.random.default_rng(seed)
    m.factors = (r.normal(size=(SIZE, RANK)) * 0.01).astype(np.float32)
    share = np.clip(labels.mean(), 0.02, 0.98)
    m.bias = float(np.log(share / (1 - share)))
    first, second = [0.0, np.zeros(SIZE), np.zeros((SIZE, RANK))], [0.0, np.zeros(SIZE), np.zeros((SIZE, RANK))]
    dense = np.zeros((len(rows), SIZE), np.float32)
    for k, (at, values) in enumerate(rows):
        dense[k, at] = values
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(labels))
        for lo in range(0, len(order), 128):
            which = order[lo : lo + 128]
            x = dense[which]
            sums = x @ m.factors
            raw = m.bias + x @ m.linear + 0.5 * ((sums**2).sum(1) - (x * x) @ (m.factors**2).sum(1))
            gap = (labels[which] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) / len(which)
            grads = [gap.sum(), x.T @ gap - decay * m.linear, x.T @ (gap[:, None] * sums) - ((x * x).T @ gap)[:, None] * m.factors - decay * m.factors]
            step += 1
            moved = []
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                moved.append(rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8))
            m.bias += float(moved[0])
            m.linear += moved[1].astype(np.float32)
            m.factors += moved[2].astype(np.float32)
    return m


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """A machine from at most `bound` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    lab = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label")).where("label_id IS NOT NULL AND label IN (0, 1)").where(fold(F.col("label_id")) != 0)
    picked = lab.groupBy("label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(bound)
    texts = documents(docs, id_col, text_col)
    sample = texts.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(picked), texts.doc_id == picked.label_id).select("doc_id", "text", "label", "text_hash")  # `bound` rows at most are broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, column, value = inputs(b.column(1).to_pylist())
            first = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            at, values = (pa.ListArray.from_arrays(first, pa.array(x, k)) for x, k in ((column, pa.int32()), (value, pa.float32())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), at, values], ["doc_id", "label", "text_hash", "at", "value"])

    # of several rows of an id the text with the least hash, so that `bound` rows at most reach the driver
    kept = sample.mapInArrow(run, "doc_id long, label int, text_hash long, at array<int>, value array<float>").groupBy("doc_id", "label").agg(F.min_by(F.struct("at", "value"), "text_hash").alias("x"))
    got = kept.select("doc_id", "label", "x.at", "x.value").toArrow().sort_by("doc_id")
    rows = [(np.array(a, np.int32), np.array(v, np.float32)) for a, v in zip(got["at"].to_pylist(), got["value"].to_pylist())]
    return fit(rows, np.array(got["label"].to_pylist(), np.float64))


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(machine.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    out = spread(documents(docs, id_col, text_col)).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least the threshold, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(machine.score(texts.tolist()))

    return spread(docs).where(score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) >= threshold)
