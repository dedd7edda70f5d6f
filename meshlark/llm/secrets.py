"""Operator 9: secrets by fixed patterns and character Markov models.

Base spans come from the three patterns. Two first-order Markov models over characters, one
trained from labelled samples of random strings and one from ordinary identifiers and words,
add spans: a run of key characters is a secret if its log-likelihood ratio per character
exceeds the threshold. A key may be attached to ordinary text by "/", "_", "-" or "=", so in a run
that is none as a whole the best stretches are sought (at least SHORTEST characters whose ratios
exceed the threshold by MARGIN in sum) and widened to the separators around them. A word that an
access key or hexadecimal run of the base is only a part of is scored as a whole, so an added span
may overlap base spans; masking covers their union. Runs and stretches below SHORTEST = 16 characters are not scored: too few to tell a key from a word.

Edge cases: null or empty text has no spans (counts 0, digest of no bytes, empty spans); other parts
of a run are scored between its base spans, in time linear in the text; repeated rows give repeated
results; null ids stay null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, spread
from .pii import joined

KINDS = ("assign", "access", "hex", "random")
# Fixed patterns of the base; a run of hexadecimal digits shorter than 32 can hold no match.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Mean log-likelihood ratio per character from which a run counts as random.
THRESHOLD = 0.5
#: Characters of a run or stretch at least, by how much a stretch exceeds the threshold in sum, and the fall that ends it.
SHORTEST, MARGIN, FALL = 16, 10.0, 8.0
#: Characters from which a run may count as random as a whole, by its mean.
WHOLE = 20
SEPARATORS = "/_-="
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET) - 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def samples(n: int = 3000, seed: int = 5) -> tuple[list[str], list[str]]:
    """Labelled samples by a rule from a seed: (random strings, ordinary identifiers and words)."""
    r = random.Random(seed)
    sets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], "0123456789abcdef", ALPHABET[:26] + "0123456789", ALPHABET[:62] + "_-"]
    strings = ["".join(r.choice(s) for _ in range(r.randint(20, 48))) for s in (r.choice(sets) for _ in range(n))]
    # frequent pieces of English, French, German and Spanish words
    pieces = "the and ing ion tion ent ation for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat le de es en re nt on er ou ai eau eux aux ment que elle qui pa vi ch sch ein ich der und ung gen keit heit lich zu ver be ge ach auf mit ción ado ada mente que los las del por con para una ente ar ez ll rr os as do mi ga co ja st nd an in it is of to at or wh sh ha he ti ea ly ble ed ou id key user name value count index list map file path data get set is has max min num buffer string config test main node".split()
    piece = lambda: r.choice(pieces).encode("ascii", "ignore").decode()
    word = lambda: "".join(piece() for _ in range(r.randint(1, 4)))
    forms = [
        lambda: "".join(word() for _ in range(3)),
        lambda: "_".join(word() for _ in range(r.randint(2, 5))),
        lambda: "-".join(word() for _ in range(r.randint(2, 5))),
        lambda: "/".join(word() for _ in range(r.randint(2, 6))),
        lambda: "".join(word().capitalize() for _ in range(r.randint(2, 5))),
        lambda: "_".join(word() for _ in range(3)).upper(),
        lambda: "".join(word() for _ in range(3)).upper(),
        lambda: word() + r.choice("-_") + "".join(r.choice("0123456789") for _ in range(r.randint(1, 6))) + r.choice("-_") + word(),
        lambda: "".join(r.choice("0123456789") for _ in range(r.randint(20, 40))),
        lambda: r.choice("=-_+/") * r.randint(20, 60),
        lambda: "-".join("".join(r.choice("0123456789") for _ in range(r.choice([2, 4]))) for _ in range(8)),
        lambda: word() * r.randint(3, 8),
    ]
    return strings, [f() for f in (r.choice(forms) for _ in range(2 * n))]


def chain(strings: list[str], smooth: float = 0.2) -> np.ndarray:
    """Log-probabilities of each character given the one before."""
    k = len(ALPHABET)
    counts = np.full((k, k), smooth)
    for s in strings:
        c = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


@lru_cache(1)
def ratios() -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, random against ordinary."""
    strings, ordinary = samples()
    return chain(strings) - chain(ordinary)


def ratio(run: str) -> float:
    """Mean log-likelihood ratio of a run of key characters."""
    c = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
    return float(ratios()[c[:-1], c[1:]].mean())


def widened(run: str, cut: list[int], top: int, end: int) -> tuple[int, int]:
    """A stretch (first, last character) made to end at separators: a word at its end is left out if less than half of it is inside."""
    while top < end and run[top] in SEPARATORS:
        top += 1
    while end > top and run[end] in SEPARATORS:
        end -= 1
    k = bisect_left(cut, top)  # cut[k - 1] and cut[k] enclose the first word
    top = cut[k] + 1 if cut[k] < end and 2 * (cut[k] - top) < cut[k] - cut[k - 1] - 1 else cut[k - 1] + 1
    k = bisect_left(cut, end)
    end = cut[k - 1] - 1 if cut[k - 1] > top and 2 * (end - cut[k - 1]) < cut[k] - cut[k - 1] - 1 else cut[k] - 1
    return top, end


def stretches(run: str) -> list[tuple[int, int]]:
    """(start, end) of the random parts of a run of key characters: the whole run, or its best stretches."""
    c = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
    over = ratios()[c[:-1], c[1:]] - THRESHOLD
    if len(run) >= WHOLE and over.sum() > 0:
        return [(0, len(run))]
    sums = [0.0, *over.cumsum().tolist()]
    out: list[tuple[int, int]] = []
    cut = [-1, *(k for k, x in enumerate(run) if x in SEPARATORS), len(run)]
    first = 0
    while first + SHORTEST <= len(run):
        low, best, top, end = first, MARGIN, 0, -1
        for at in range(first + SHORTEST - 1, len(run)):  # a stretch is of the characters low to at
            back = at - SHORTEST + 1
            if sums[back] < sums[low] and end < 0:
                low = back
            gain = sums[at] - sums[low]
            if gain > best:
                best, top, end = gain, low, at
            elif end >= 0 and gain < best - FALL:
                break
        if end < 0:
            break
        first = end + 1  # what was read beyond the end rises by less than MARGIN, so no character is read three times
        top, end = widened(run, cut, top, end)
        top = max(top, out[-1][1] if out else 0)
        if top <= end:
            out.append((top, end + 1))
        first = max(first, end + 1)
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """The union of spans (sorted) as (start, end, whether an access key or hexadecimal run is in it)."""
    out: list[list] = []
    for lo, kind, hi in spans:
        if out and lo < out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
            out[-1][2] |= kind in (1, 2)
        else:
            out.append([lo, hi, kind in (1, 2)])
    return [tuple(x) for x in out]


def between(text: str, held: list[tuple[int, int, bool]]) -> Iterator[tuple[int, int, list[tuple[int, int, bool]]]]:
    """Each run of key characters with the stretches of `held` in it; one pass over both."""
    k = 0
    for m in _RUN.finditer(text):
        lo, hi = m.span()
        while k < len(held) and held[k][1] <= lo:
            k += 1
        inside = []
        while k < len(held) and held[k][0] < hi:
            inside.append(held[k])
            if held[k][1] > hi:
                break
            k += 1
        yield lo, hi, inside


def grown(text: str, held: list[tuple[int, int, bool]]) -> list[tuple[int, int, int]]:
    """Words of key characters that a base key is only a part of, if they are random as a whole."""
    out = []
    for lo, hi, inside in between(text, held):
        for n, (a, b, key) in enumerate(inside):
            if key:
                least, most = inside[n - 1][1] if n else lo, inside[n + 1][0] if n + 1 < len(inside) else hi
                left = max(text.rfind(c, least, a) for c in SEPARATORS) + 1 or least
                right = min((x for c in SEPARATORS if (x := text.find(c, b, most)) >= 0), default=max(b, most))
                left = min(left, a)
                if (left < a or right > b) and ratio(text[left:right]) > THRESHOLD:
                    out.append((left, 3, right))
    return out


def random_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the models add: words that a base key is a part of, and random parts of runs outside all of these."""
    held = merged(base)
    out = grown(text, held) if held else []
    for lo, hi, inside in between(text, merged(sorted(base + out)) if out else held):
        at = lo
        for a, b, _ in [*inside, (hi, hi, False)]:
            if a - at >= SHORTEST:
                out += [(at + x, 3, at + y) for x, y in stretches(text[at:a])]
            at = max(at, b)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches that pass their checks, sorted."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    added = random_spans(text, base)
    return base, sorted(base + added) if added else base


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans and all spans of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for b in slices(batches):
            found = [all_spans(t) for t in b.column(1).to_pylist()]
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(3)]
            sha = [hashlib.sha256(joined(base, KINDS).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([joined(s, KINDS) for _, s in found], pa.string())], names)

    return spread(documents(df, id_col, text_col)).mapInArrow(run, RESULT)


def mask(text: str, mark: str = "[SECRET]") -> str:
    """The text with each secret replaced; overlapping spans become one mark."""
    spans = all_spans(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(df: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """df with secrets in its texts replaced by a mark, and the number of characters to match; null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask, na_action="ignore")

    clean = spread(df).withColumn(text_col, masked(F.col(text_col)))
    if size_col in df.columns:
        kind = df.schema[size_col].dataType
        clean = clean.withColumn(size_col, F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(kind))
    return clean.select(df.columns)
