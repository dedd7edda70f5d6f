"""Operator 1: BPE encoding and decoding by tree concatenation.

A text is cut into leaves of LEAF characters, wherever the cuts fall. Each leaf is encoded by
itself; neighbours are then joined pairwise up a tree. At each join a window around the seam, a
few pre-tokens of both sides, is encoded again and grows until its outer pre-tokens are those that
both sides had there; what lies outside the window then stands. This is exact: pre-tokens are found
by a scan from left to right that remembers nothing and looks at most three characters ahead, so a
start of a pre-token four of them before a seam is a start in the whole text too, and from the
first start that the window's scan shares with the right side's, both scans are the same.

Pre-tokens of a leaf or a window are words, and a word's ids come from a bounded table. Words that
it lacks are merged by tiktoken's core over the same vocabulary, with the byte 0xFF (never part of
UTF-8) as the mark of a word's end. Both engines take the same steps if each token's own text
encodes to that token: whatever happens inside two neighbouring tokens' span happens as it would in
the span alone, and there the last step is the listed merge. Tokens of which that is not so are
never made by the library, so they are taken out of the core's vocabulary when loading; if
the vocabulary's order is not that of its merges, the library's own model does this work. A word of
more than LONG_UNIT bytes, which the pre-tokenizer cannot split, becomes a tree of its own: its
leaves are encoded by the library's threads in parallel, and at each join the window is one of
tokens and grows until its outer tokens equal what both sides had there; the ids outside the window
then stand, since a BPE sequence is the encoding of its text exactly if each neighbouring pair is
the encoding of its own text, and every pair lies wholly in one of the three encodings.

Texts with characters from U+0250 on, odd controls or special tokens are normalised and split by the
library in one piece; only their long words become trees.

Edge cases: null or empty text gives no ids (n_tokens 0, digests of no bytes); repeated rows
give repeated results; null ids stay null; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, slices, spread

#: Characters of a text's leaf, and pre-tokens of each side in the first window of a join (4 at least, see above).
LEAF, WORDS = 1024, 4
#: Words of more bytes than this become trees of their own; their leaves have this many bytes at most.
LONG_UNIT, UNIT_LEAF = 1024, 512
#: Outer pre-tokens or tokens that must agree on each side of a window; tokens of each side in the first window of a long word.
AGREE, WINDOW = 2, 8
#: Entries of the table from units to ids; it is emptied when full.
TABLE = 200_000
#: Below this code point no character composes with another, so NFC changes nothing.
PLAIN = 0x250


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from U+0100 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(keep)]
    return [chr(b) if b in set(keep) else chr(256 + rest.index(b)) for b in range(256)]


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)


class _Table(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, unit):
        if len(self) >= TABLE:
            self.clear()
        ids = self[unit] = self.make(unit)
        return ids


class _Words(_Table):
    """The table of plain words: what it lacks goes to the core with as few calls as possible.

    Longer words are not kept, and one of more than LONG_UNIT bytes has no ids (None) before it is whole.
    """

    def __init__(self, core, mark: bytes, make):
        super().__init__(make)
        self.core, self.mark = core, mark

    def __missing__(self, word):
        if len(word) > LONG_UNIT // 4:  # may be over the limit in bytes
            data = word.encode()
            return self.make(data) if len(data) <= LONG_UNIT else None
        if len(self) >= TABLE:
            self.clear()
        if self.core is None:
            ids = self.make(word.encode())
        else:
            ids = array("I", self.core(word.encode() + self.mark)).tobytes()
        self[word] = ids
        return ids


class Coder:
    """Encodes and decodes as the tokenizers library does with the file at `path`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], json.dumps(spec.get("pre_tokenizer"))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or None
        self.last = Tokenizer(BPE(model["vocab"], merges, **({"end_of_word_suffix": suffix} if suffix else {})))
        self.inner = Tokenizer(BPE(model["vocab"], merges)) if suffix else self.last
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]
        size = 1 + max(*model["vocab"].values(), *(x["id"] for x in spec.get("added_tokens", [])), 0)
        self.tokens = [""] * size
        for t, i in chain(model["vocab"].items(), ((x["content"], x["id"]) for x in spec.get("added_tokens", []))):
            self.tokens[i] = t
        self.suffix = suffix or ""
        self.spaced = spec.get("decoder") is None
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.joins = self.windows = 0  # joins of texts, and the windows that they took
        self.core = self._core(model["vocab"], merges)
        self.mark = b"\xff" if suffix else b""
        # packed ids (little-endian, 32 bits each) by unit in byte letters, and by word
        self.units = _Table(lambda u: self.packed(bytes(map(self.bytes_of.__getitem__, u)), u))
        self.words = _Words(self.core, self.mark, self.packed)
        lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        letter, number = _class("L"), _class("N")
        # letters come first for speed: none of the endings begins with one, so the order changes no match
        ends = "'s|'t|'re|'ve|'m|'ll|'d"
        if lower and '"Split"' in pre and '"Removed"' in pre:
            self.fast, self.lower = re.compile(f"[{letter}]+|[{number}]|{ends}|[^\\s{letter}{number}]+"), True
        elif spec.get("normalizer") is None and '"ByteLevel"' in pre and '"use_regex": true' in pre and '"Split"' not in pre:
            self.fast, self.lower = re.compile(f" ?[{letter}]+|{ends}| ?[{number}]+| ?[^\\s{letter}{number}]+|\\s+(?!\\S)|\\s+"), False
        else:
            self.fast, self.lower = None, False
        # characters for which the plain pattern is known to equal the library's: no odd controls, and lowered to one plain character
        plain = [c for c in map(chr, range(PLAIN)) if (c in "\t\n\r" or unicodedata.category(c) != "Cc") and len(c.lower()) == 1 and ord(c.lower()) < PLAIN]
        self.odd = re.compile(f"[^{''.join(map(re.escape, plain))}]")

    def _core(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        """tiktoken's core if it provably merges as the library does, else None."""
        try:
            import tiktoken
        except ImportError:
            return None
        plain = {t: i for t, i in vocab.items() if t not in self.specials}
        singles = {t for t in plain if len(t.removesuffix(self.suffix) or t) == 1}
        order = [plain.get(a + b) for a, b in merges]
        if len(singles) < 256 or None in order or sorted(order) != order or order and max(plain[t] for t in singles) >= order[0] or len(singles) + len(merges) != len(plain):
            return None
        ranks = {}
        for t, i in plain.items():
            ends = bool(self.suffix) and t.endswith(self.suffix)
            own = self.last if ends or not self.suffix else self.inner
            if t in singles or len(own.model.tokenize(t[: len(t) - len(self.suffix)] if ends else t)) == 1:
                ranks[bytes(map(self.bytes_of.__getitem__, t[: len(t) - len(self.suffix)] if ends else t)) + (b"\xff" if ends else b"")] = i
        try:
            return tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        except (AttributeError, ValueError):
            return None

    def packed(self, word: bytes, unit: str | None = None) -> bytes:
        """Ids of one unit, as bytes."""
        if self.core is not None and len(word) <= LONG_UNIT:
            return array("I", self.core(word + self.mark)).tobytes()
        return array("I", self.unit_ids(unit if unit is not None else "".join(map(self.letters.__getitem__, word)))).tobytes()

    def unit_ids(self, unit: str) -> list[int]:
        """Ids of one unit, given in byte letters."""
        if len(unit) > LONG_UNIT:
            return self.tree(unit)
        return [x.id for x in self.last.model.tokenize(unit)]

    def tree(self, unit: str, leaf: int = UNIT_LEAF) -> list[int]:
        """Ids of one long unit: leaves in parallel, then joins up a tree."""
        parts = [unit[i : i + leaf] for i in range(0, len(unit), leaf)]
        level = [x.ids for x in self.inner.encode_batch(parts[:-1], add_special_tokens=False)] if len(parts) > 1 else []
        level.append(self.last.encode(parts[-1], add_special_tokens=False).ids)
        while len(level) > 1:
            pairs = [self.join(level[i], level[i + 1], i + 2 >= len(level)) for i in range(0, len(level) - 1, 2)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0]

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of two encodings' joined text; `ends`: right holds the unit's end."""
        k = WINDOW
        while True:
            a, b = left[-k:], right[:k]
            whole_l, whole_r = k >= len(left), k >= len(right)
            text = "".join(map(self.tokens.__getitem__, a + b))
            if ends and whole_r:
                seam = self.last.encode(text[: len(text) - len(self.suffix)], add_special_tokens=False).ids
            else:
                seam = self.inner.encode(text, add_special_tokens=False).ids
            if (whole_l or seam[:AGREE] == a[:AGREE]) and (whole_r or seam[-AGREE:] == b[-AGREE:]) and (len(seam) >= 2 * AGREE or whole_l and whole_r):
                return left[:-k] + seam + right[k:] if not whole_l else seam + right[k:]
            k *= 2

    def leaf(self, text: str, lo: int, hi: int) -> tuple[list[str], list[bytes]]:
        """The pre-tokens of text[lo:hi] taken by itself, and the packed ids of each."""
        words = self.fast.findall(text, lo, hi)
        return words, list(map(self.words.__getitem__, words))

    def text_tree(self, text: str, leaf: int = LEAF) -> list[bytes]:
        """Packed ids of each pre-token of a whole text: leaves, then joins up a tree; long words last."""
        level = [(lo, *self.leaf(text, lo, min(lo + leaf, len(text)))) for lo in range(0, len(text), leaf)]
        while len(level) > 1:
            ends = [part[0] for part in level[2::2]] + [len(text)]
            pairs = [(left[0], *self.text_join(text, left, right, end)) for left, right, end in zip(level[::2], level[1::2], ends)]
            level = pairs + level[len(pairs) * 2 :]
        _, words, ids = level[0]
        return [i if i is not None else self.packed(w.encode()) for w, i in zip(words, ids)] if None in ids else ids

    def text_join(self, text: str, left: tuple, right: tuple, end: int) -> tuple[list[str], list[bytes]]:
        """The encoding of text[left's start:end] from those of its two parts; the left one's lists take it."""
        (lo, left_words, left_ids), (seam, right_words, right_ids) = left, right
        start, stop, near, far = seam, seam, 0, 0  # the window, and how many pre-tokens of each side it takes
        k = WORDS
        while True:
            # between neighbouring pre-tokens there is nothing, or white space that no pre-token holds
            for w in reversed(left_words[-k : len(left_words) - near]):
                start = text.rfind(w, lo, start)
            for w in right_words[far:k]:
                stop = text.find(w, stop) + len(w)
            near, far = min(k, len(left_words)), min(k, len(right_words))
            whole_l, whole_r = near == len(left_words), far == len(right_words)
            words, ids = self.leaf(text, lo if whole_l else start, end if whole_r else stop)
            self.windows += 1
            if (whole_l or words[:AGREE] == left_words[-k:][:AGREE]) and (whole_r or words[-AGREE:] == right_words[k - AGREE : k]) and (len(words) >= 2 * AGREE or whole_l or whole_r):
                self.joins += 1
                left_words[len(left_words) - near :], left_ids[len(left_ids) - near :] = words, ids
                left_words += right_words[far:]
                left_ids += right_ids[far:]
                return left_words, left_ids
            k *= 2

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers."""
        if not text:
            return np.empty(0, np.uint32)
        if any(s in text for s in self.specials):
            ids: list[int] = self.library.encode(text, add_special_tokens=False).ids
        elif self.fast is not None and not self.odd.search(text):
            return np.frombuffer(b"".join(self.text_tree(text.lower() if self.lower else text)), "<u4")
        else:
            norm, pre = self.library.normalizer, self.library.pre_tokenizer
            units = pre.pre_tokenize_str(norm.normalize_str(text) if norm is not None else text)
            return np.frombuffer(b"".join(self.units[u] for u, _ in units), "<u4")
        return np.array(ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.spaced:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(4)
def coder(path: str) -> Coder:
    """One coder per worker process and file."""
    return Coder(path)


def sha256_ids(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in slices(batches):
            rows = [c.encode(t).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(documents(df, id_col, text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the decoded text of (doc_id, ids); null ids decode as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in slices(batches):
            rows = [c.decode(np.array(x or [], np.uint32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in slices(batches):
            n, ids_sha, out_sha = [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                ids_sha.append(sha256_ids(ids))
                out_sha.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(out_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(documents(df, id_col, text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
