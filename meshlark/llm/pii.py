"""Operator 4: personal data by fixed patterns and a linear-chain conditional random field.

Base spans come from the four patterns and their checks. The field adds spans that the patterns
miss: numbers without a country code, addresses with a written-out at sign or dots, cards in
other groupings or beside other numbers. Its tokens are the words between white space; its
features describe the shape of the word's core (what is left without outer punctuation) and
whether the core passes a kind's check, for the word itself and for two words on each side, and
the digits of the run of number words around it; some words of context are known by name. Its
states are outside, begin and inside of the four kinds. It is trained here, by gradient ascent on
the exact likelihood (forward-backward), from a small labelled table of sentences, once on the
driver, and shipped with the task.

A whole text is one chain. Every word is scored, in numpy batches. A word is outside in every best
path if no run of other states through it can win over being outside, which a bound on each word's
part tells for all words at once; the chain falls apart there exactly, and Viterbi runs over the
stretches between such words, again in numpy batches, of stretches of equal length. No stretch is cut. A span of the
field counts if it holds a character that no base span holds.

Edge cases: null or empty text has no spans (counts 0, digest of no bytes, empty spans);
repeated rows give repeated results; null ids stay null; an empty table gives an empty table;
other columns are ignored. Patterns and decoding take time linear in the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, slices, spread

KINDS = ("email", "ip", "card", "phone")
STATES = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
# Fixed patterns of the base. The look-behind skips starts inside a run of digits whose first start has failed.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
#: Words scored at a time, and characters of the texts decoded together.
BLOCK, CHARS = 1 << 16, 4 << 20
#: Weight of each word's likelihood by itself beside the chain's: it makes words tell their state without their neighbours' states.
ALONE = 0.3
#: Words whose rows a worker remembers.
TABLE = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each "@" outwards."""
    out, over, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            over = m.end()
        at = text.find("@", max(at + 1, over))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches that pass their checks, sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(map(octet, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


class _Shapes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        s = self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return s


_SHAPE = _Shapes()
_RUN = re.compile(r"(.)\1*", re.S)
_OUTER = ".,;:!?\"'`*&%$#|<>~^"
_MARKS = frozenset("=:@./_-+()[]{}<>")
_AT = re.compile(r"[\[({<_](?:at|arroba)[\])}>_]", re.I)
_DOT = re.compile(r"[\[({<_](?:dot|\.|punkt|punto)[\])}>_]", re.I)
#: Words of context that the field knows by name.
CONTEXT = frozenset(
    "phone telephone tel call mobile cell fax ring text dial number reach telefon handy anrufen rufnummer téléphone appelez teléfono llame móvil "
    "email e-mail mail write contact address correo courriel schreiben escriba "
    "card cards visa mastercard amex credit debit carte tarjeta karte kreditkarte "
    "ip host server port gateway ping dns from adresse dirección "
    "order invoice isbn version page pages ref id serial tracking total price account part model ticket "
    "at dot com org net edu punkt punto arroba".split()
)
SENTINEL = ""


def core_of(word: str) -> tuple[int, int]:
    """Where a word's core begins and ends: without outer punctuation and unpaired brackets."""
    lo, hi = len(word) - len(word.lstrip(_OUTER)), len(word.rstrip(_OUTER))
    if lo >= hi:
        return 0, 0
    for open_, close in ("()", "[]", "{}"):
        if word[lo] == open_ and word.find(close, lo, hi) < 0:
            lo += 1
        elif word[hi - 1] == close and (word.find(open_, lo, hi) < 0 or word[lo] == open_ and word.find(close, lo, hi) == hi - 1 and hi - lo > 12):
            lo, hi = lo + (word[lo] == open_), hi - 1
        if lo >= hi:
            return 0, 0
    return lo, hi


def numeric(word: str) -> bool:
    """Whether a word is of digits and the marks inside phone and card numbers; punctuation may follow."""
    core = word.rstrip(",.;:!?")
    return not core.strip("0123456789+-()") and any("0" <= c <= "9" for c in core)


def features(word: str) -> tuple[str, ...]:
    """Features of one word by itself: its shape, length, checks and, if it is known, its name."""
    if word == SENTINEL:
        return ("edge",)
    lo, hi = core_of(word)
    core, after = word[lo:hi], word[hi:][:1]
    name = core.lower() if len(core) < 20 else ""
    named = ("name=" + name,) if name in CONTEXT else ()
    after = "after=" + (after if after in ",.;:" else "x" if after else "")
    if core.isalpha():
        return ("letters", "case=" + ("a" if core.islower() else "A" if core.isupper() else "Aa"), after, *named)
    shape = core.translate(_SHAPE)
    short = _RUN.sub(r"\1", shape)
    digits = shape.count("0")
    out = ["all=" + _RUN.sub(lambda m: m[1] + (str(min(len(m[0]), 20)) if m[1] == "0" else ""), shape), "short=" + short, f"digits={min(digits, 20)}", f"dots={min(shape.count('.'), 5)}", "ends=" + shape[:1] + shape[-1:], after, *named]
    marks = "".join(sorted(set(core) & _MARKS))
    out.append("marks=" + marks)
    swaps = min(len(re.findall("0a|a0|0A|A0", short)), 4)
    if swaps > 1:
        out.append(f"swaps={swaps}{marks}")
    if "@" in core:
        out.append(f"at={bool(emails(core)) and emails(core)[0] == (0, len(core))}")
    if _AT.search(core):
        out.append(f"written-at={_AT.fullmatch(core) is not None}")
    if _DOT.search(core):
        out.append(f"written-dot={_DOT.fullmatch(core) is not None}")
    if digits:
        if core[0] == "0" and digits > 1:
            out.append("starts with 0")
        bare = core if len(core) <= 24 else ""
        if 14 <= digits <= 19 and not bare.strip("0123456789-./_"):
            out.append(f"luhn={luhn(''.join(filter(str.isdigit, bare)) if bare.isascii() else '1')}")
        parts = _DOT.sub(".", bare).split(".")
        if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
            out.append(f"octets={all(map(octet, parts))}")
        if bare.count(":") > 1 and not bare.strip("0123456789abcdefABCDEF:"):
            groups = bare.split(":")
            out.append(f"colons={min(len(groups), 8)}{'::' in bare}{max(map(len, groups)) > 2}")
        if short.strip("a0"):
            out.append("letters and digits" if "a" in short or "A" in short else "digits only")
    return tuple(out)


def run_feature(digits: int, words: int, valid: bool) -> int:
    """Number of the feature of a run of number words: its digits in bands, one word or several, and the card's check."""
    band = 0 if digits < 7 else 1 if digits < 10 else 2 if digits < 14 else 3 if digits < 20 else 4
    return 1 + band * 4 + 2 * (words > 1) + valid


RUNS = 21


def number_runs(words: list[str], known: np.ndarray) -> np.ndarray:
    """The run feature of each word, 0 where it is no number; `known`: which words are numbers. Punctuation after a word ends a run."""
    out = np.zeros(len(words), np.int64)
    at = np.flatnonzero(known).tolist()
    lo, count, held = 0, 0, []
    for k, i in enumerate(at):
        w = words[i]
        d = "".join(c for c in w if "0" <= c <= "9")
        count += len(d)
        if count < 20:
            held.append(d)
        if w[-1] in ",.;:!?" or k + 1 == len(at) or at[k + 1] != i + 1:  # the run ends
            first = at[lo]
            out[first : i + 1] = run_feature(count, i + 1 - first, 14 <= count <= 19 and luhn("".join(held)))
            lo, count, held = k + 1, 0, []
    return out


def samples(n: int = 2000, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences of (words, states), drawn by a rule from a seed."""
    r = random.Random(seed)
    syllables = ["an", "be", "ci", "do", "er", "fo", "ga", "hi", "in", "ka", "lo", "men", "no", "or", "pa", "re", "sta", "tion", "un", "ve"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    pick = lambda text: r.choice(text.split())

    def card(valid: bool = True) -> str:
        d = r.choice("3456") + digits(14)
        return next(d + c for c in r.sample("0123456789", 10) if luhn(d + c) == valid)

    def email() -> list[str]:
        name = r.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}"])
        top = pick("com org net de fr es edu io")
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("(AT)", "(DOT)"), ("[at]", "[.]"), ("_at_", "_dot_")])
        form = r.randrange(8)
        if form < 2:
            return [f"{name}@{word()}.{top}"]
        if form < 4:
            return [f"{name}{at}{word()}.{top}"]
        if form == 4:
            return [f"{name}{at}{word()}{dot}{top}"]
        if form == 5:
            return [name, at, word(), dot, top]
        if form == 6:
            return [name, at, f"{word()}.{top}"]
        return [*([word(), "dot"] if r.random() < 0.3 else []), word(), "at", word(), "dot", pick("com org net edu com org")]

    def ip() -> list[str]:
        parts = [str(r.choice([r.randint(0, 255), r.randint(0, 9), 10, 192, 168])) for _ in range(4)]
        form = r.randrange(6)
        if form < 2:
            return [".".join(parts)]
        if form == 2:
            return [r.choice(["[.]", "(.)", "[dot]", "(dot)"]).join(parts)]
        if form == 3:
            return [f"{parts[0]}.{parts[1]}.{parts[2]}[.]{parts[3]}"]
        groups = [hexes(r.choice([4, 4, 4, 3, 1])) for _ in range(8)]
        return [":".join(groups)] if form == 4 else [":".join(groups[: r.randint(2, 4)]) + "::" + ":".join(groups[: r.randint(1, 2)])]

    def card_words() -> list[str]:
        c = card()
        fours = [c[i : i + 4] for i in range(0, 16, 4)]
        return r.choice([[c], fours, ["-".join(fours)], [".".join(fours)], ["/".join(fours)], ["_".join(fours)]])

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        form = r.randrange(12)
        return [
            ["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a}){b}-{c}"],
            [f"+{digits(2)}", a, b, c], [f"00{digits(2)}", digits(2), c, digits(4)], [f"0{digits(3)}", b, c], [f"0{digits(2)}", c, digits(4)],
            [f"0{digits(3)}/{digits(7)}"], [f"0{digits(1)}", digits(2), digits(2), digits(2), digits(2)],
        ][form]

    leads = {
        "email": "email e-mail mail write contact address correo courriel schreiben escriba", "ip": "ip host server gateway ping dns from adresse dirección address",
        "card": "card visa mastercard amex credit debit carte tarjeta karte kreditkarte number", "phone": "phone telephone tel call mobile cell fax ring dial number reach telefon handy anrufen teléfono llame móvil appelez",
    }
    makers = {"email": email, "ip": ip, "card": card_words, "phone": phone}

    def plain() -> list[str]:
        if r.random() < 0.1:  # a row of a table
            k = r.randint(1, 4)
            return [digits(k if r.random() < 0.7 else r.randint(1, 4)) + r.choice(["", "", "", ","]) for _ in range(r.randint(3, 12))]
        return r.choice([
            [digits(r.randint(1, 8))], [f"{digits(1)}.{digits(r.randint(1, 3))}"], [f"{digits(2)}%"], [f"${digits(3)}"], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{digits(2)}/{digits(2)}/{digits(4)}"], [f"{digits(2)}:{digits(2)}"], [f"{digits(2)}:{digits(2)}:{digits(2)}"], [f"v{digits(1)}.{digits(1)}.{digits(1)}"], [f"{digits(1)}.{digits(1)}.{digits(2)}"],
            [f"{word()}{digits(2)}"], [f"{word()}-{digits(3)}"], [f"@{word()}"], [f"{digits(3)},{digits(3)}"], [hexes(r.choice([8, 16, 32, 40]))], [digits(r.randint(9, 13))], [card(False)], [digits(r.randint(20, 26))], [f"{digits(4)}/{digits(2)}"], [f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"],
            ["isbn", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"], ["order", digits(4), digits(4)], ["order", f"{digits(3)}-{digits(7)}-{digits(7)}"], ["invoice", f"{digits(4)}-{digits(4)}-{digits(4)}"], ["tracking", digits(4), digits(4), digits(4)], ["ref", f"{digits(3)}-{digits(2)}-{digits(4)}"], ["version", f"{digits(1)}.{digits(2)}.{digits(1)}"], [digits(2), digits(2), digits(3)], [digits(4), digits(4), digits(4), digits(4), digits(4), digits(4)],
            ["at", digits(2)], ["at", "the", word()], ["dot"], ["(at", word() + ")"], [":".join(hexes(2) for _ in range(6))], [f"{word()}.{word()}"], [f"{word()}.{pick('com org net de')}"], [f"{word()}/{word()}"], [f"({word()})"], [f"({digits(4)})"], [f"({digits(1)})"], [pick(" ".join(leads.values()))], [pick(" ".join(leads.values()))], [f"{digits(2)}.{digits(2)}.{digits(4)}"], [f"{digits(1)}:{digits(1)}"], [f"[{digits(2)}]"], [digits(4), "-", digits(4)], ["+", digits(2)], [f"+{digits(2)}%"], [f"{digits(3)}.{digits(3)}"],
            ["=", f'"{hexes(r.choice([32, 40, 64]))}"'], ["token", "=", f'"{hexes(40)}"'], [word(), "=", f'"{word()}"'], ["=", digits(3)], [word(), *["at"] * r.randint(1, 12), word()], ["dot"] * r.randint(1, 3), ["|", word(), "|"], ["-"], ["--", word()], [f"<{word()}>"], [f"http://{word()}.{pick('com org net')}/{word()}"], [f"{word()}'s"], [f"{word()}-{word()}"], [f"{word()}_{word()}"], [f"{word()}={digits(2)}"], [f"#{digits(4)}"], [card(False), card(False)],
            [f"{word()}={hexes(r.choice([8, 16, 18, 32]))}"], [mixed(r.randint(12, 40))], ["AKIA" + mixed(16).upper()], [f"{word()}:{mixed(20)}"], [f"{word().upper()}.{word().upper()}"], [f"{word().capitalize()}.{word()}"] * r.randint(1, 6), [word()] * r.randint(2, 6), [word().upper()],
            [word().upper() + "!!", r.choice(["at", "AT", "At"]) + "!!", word().upper() + "!!"], [word(), "at", word(), r.choice(["the", "dot", "com"])], [f"{r.choice(['key', 'password', 'token', 'id', word()])}={hexes(r.randint(8, 24))}"], [f"{word()}={mixed(r.randint(8, 24))}"], [hexes(r.randint(6, 40))],
            [pick("de es la en io fr the of con se")] * r.randint(1, 6),
        ])

    out = []
    for _ in range(n):
        words, states = [], []
        for _ in range(r.randint(1, 2)):
            for _ in range(r.randint(0, 3)):
                words.append(r.choice([word(), word(), word().capitalize(), pick("the of and to from is on or der la le")]) + r.choice(["", "", "", "", ",", "."]))
                states.append("O")
            x = r.random()
            if x < 0.5:
                k = r.choice(KINDS)
                got = makers[k]()
                written = k == "email" and "at" in got  # words alone make an address only if the sentence says so
                if r.random() < 0.35 or written:
                    lead = [pick(leads[k]) + r.choice(["", "", ":"])] + ([r.choice(["to", "me", "at", "is", "us"])] if r.random() < 0.3 and not written else [])
                    words += lead
                    states += ["O"] * len(lead)
                words += got
                states += [f"B-{k}"] + [f"I-{k}"] * (len(got) - 1)
                if k == "card" and len(got) == 1 and r.random() < 0.3:  # the only entities that touch
                    words.append(card())
                    states.append("B-card")
                mark = r.choice(["", "", ",", ".", ".", ";", "!!", ")"])
                words[-1] += mark
                if not mark or mark == ")":
                    words.append(word())
                    states.append("O")
            else:
                got = plain()
                words += got
                states += ["O"] * len(got)
                if r.random() < 0.5 and x < 0.9:
                    words[-1] += r.choice([",", ".", ";"])
                else:
                    words.append(word())
                    states.append("O")
        out.append((words, states))
    return out


class Field:
    """A trained field: a weight per (place, feature, state) and per (run feature, state), and transitions."""

    #: Places whose words are seen from a word, and the sentinels around each text.
    PLACES, EDGE = (0, -1, 1, -2, 2), 3

    def __init__(self, table: list[tuple[list[str], list[str]]], steps: int = 100, rate: float = 0.2, decay: float = 2e-4):
        k, n = len(STATES), len(table)
        length = max(len(words) for words, _ in table) + 2  # with a sentinel on each side
        count: dict[str, int] = defaultdict(int)
        seen = {w: features(w) for words, _ in table for w in [*words, SENTINEL]}
        for words, _ in table:
            for w in words:
                for f in seen[w]:
                    count[f] += 1
        self.index = {f: i for i, f in enumerate(sorted({"edge", *(f for f, c in count.items() if c >= 2)}))}
        self.weights = np.zeros((len(self.PLACES), len(self.index), k))
        self.runs, self.moves = np.zeros((RUNS, k)), np.zeros((k, k))
        kinds = {f: i for i, f in enumerate(dict.fromkeys(seen.values()))}  # distinct rows of features
        has = np.zeros((len(kinds), len(self.index)))
        for fs, i in kinds.items():
            has[i, [self.index[f] for f in fs if f in self.index]] = 1
        x = np.full((n, length + 4), kinds[seen[SENTINEL]])
        y, run = np.zeros((n, length), np.int64), np.zeros((n, length), np.int64)
        for i, (words, states) in enumerate(table):
            x[i, self.EDGE : self.EDGE + len(words)] = [kinds[seen[w]] for w in words]
            y[i, 1 : 1 + len(words)] = [STATES.index(s) for s in states]
            run[i, 1 : 1 + len(words)] = number_runs(words, np.array([numeric(w) for w in words], bool))
        at = [x[:, 2 + place : 2 + place + length].ravel() for place in self.PLACES]
        run, fixed, gold = run.ravel(), at[0] == kinds[seen[SENTINEL]], np.eye(k)[y.ravel()]
        pairs = np.zeros((k, k))
        np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        params = [self.weights, self.runs, self.moves]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        tally = lambda which, values, size: np.stack([np.bincount(which, values[:, s], size) for s in range(k)], 1)
        for step in range(1, steps + 1):
            e = self.runs[run] + sum((has @ w)[a] for w, a in zip(self.weights, at))
            e[fixed, 1:] = -1e4
            marginal, moved = self._marginals(e.reshape(n, length, k))
            alone = np.exp(e - e.max(1, keepdims=True))
            alone /= alone.sum(1, keepdims=True)
            gap = np.where(fixed[:, None], 0, gold - marginal.reshape(-1, k) + ALONE * (gold - alone))
            grads = [np.stack([has.T @ tally(a, gap, len(kinds)) for a in at]), tally(run, gap, RUNS), pairs - moved]
            for p, g, m, v in zip(params, grads, first, second):
                g = g / n - decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self._forget()

    def __getstate__(self) -> dict:
        return {"index": self.index, "weights": self.weights, "runs": self.runs, "moves": self.moves}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        """Empties what is remembered about words; the sentinel is number 0."""
        self.words: dict[str, int] = {}
        self.kinds: dict[tuple[int, ...], int] = {}
        self.rows = np.zeros((64, len(self.PLACES), len(STATES)), np.float32)
        self.number = np.zeros(64, bool)
        self.know(SENTINEL)

    def know(self, word: str) -> int:
        """The number of the word's kind: its known features, and whether it is a number."""
        got = self.words.get(word)
        if got is None:
            known = tuple(sorted(self.index[f] for f in features(word) if f in self.index))
            key = (numeric(word), known)
            got = self.kinds.get(key)
            if got is None:
                got = self.kinds[key] = len(self.kinds)
                if got >= len(self.rows):
                    self.rows, self.number = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.number, np.zeros_like(self.number)])
                self.rows[got] = self.weights[:, list(known)].sum(1)
                self.number[got] = key[0]
            if len(word) <= 64:
                self.words[word] = got
        return got

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of states and expected counts of transitions, by scaled forward and backward sums."""
        n, length, k = e.shape
        p, move = np.exp(e - e.max(2, keepdims=True)), np.exp(self.moves)
        alpha, beta, moved = np.empty_like(p), np.ones_like(p), np.zeros((k, k))
        alpha[:, 0] = p[:, 0]
        for t in range(1, length):
            a = (alpha[:, t - 1] @ move) * p[:, t]
            alpha[:, t] = a / a.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b = (beta[:, t + 1] * p[:, t + 1]) @ move.T
            beta[:, t] = b / b.sum(1, keepdims=True)
        both = alpha * beta
        for t in range(1, length):
            after = p[:, t] * beta[:, t]
            total = ((alpha[:, t - 1] @ move) * after).sum(1, keepdims=True)
            moved += alpha[:, t - 1].T @ (after / total) * move
        return both / both.sum(2, keepdims=True), moved

    def known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The kind and the run feature of each word of a stream that begins and ends with EDGE sentinels."""
        if len(self.words) > TABLE or len(self.kinds) > TABLE:
            self._forget()
        words_ = self.words
        ids = np.fromiter([i if (i := words_.get(w)) is not None else self.know(w) for w in words], np.int64, len(words))
        return ids, number_runs(words, self.number[ids])

    def emissions(self, ids: np.ndarray, runs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of each state at the places `at`."""
        e = self.runs.astype(np.float32)[runs[at]]
        for p, place in enumerate(self.PLACES):
            e += np.ascontiguousarray(self.rows[: len(self.kinds), p])[ids[at + place]]
        e[ids[at] == 0, 1:] = -1e4
        return e

    def open_places(self, ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """Places that may be other than outside in a best path.

        Over being outside, a run of other states wins at most its first word's bound, those of its
        further words and `last`; a place is open if the best run through it may win.
        """
        t = self.moves - self.moves[0, 0]
        first, next_, last = t[0, 1:].astype(np.float32), t[1:, 1:].max(0).astype(np.float32), float(t[1:, 0].max())
        begin, more = np.full(len(ids), -1e4), np.full(len(ids), -1e4)
        for lo in range(self.EDGE, len(ids) - self.EDGE, BLOCK):
            e = self.emissions(ids, runs, np.arange(lo, min(lo + BLOCK, len(ids) - self.EDGE)))
            gain = e[:, 1:] - e[:, :1]
            begin[lo : lo + len(e)], more[lo : lo + len(e)] = (gain + first).max(1), (gain + next_).max(1)
        sums = np.cumsum(more)
        up_to = sums + np.maximum.accumulate(begin - sums)  # the best run as far as here
        after = np.maximum.accumulate(sums[::-1])[::-1] - sums  # and what it may win beyond
        return np.flatnonzero((up_to + after + last > -1e-3) & (ids != 0))

    def decode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places, states) of the words that the best path of the whole chain puts into a span."""
        ids, runs = self.known(words)
        at = self.open_places(ids, runs)
        if not len(at):
            return at, at
        states = self.viterbi(self.emissions(ids, runs, at), np.flatnonzero(np.diff(at, prepend=-2) > 1))
        return at[states > 0], states[states > 0]

    def viterbi(self, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The best states of stretches that lie one after another; each stands between words that are outside."""
        lengths = np.diff(np.append(starts, len(e)))
        out, t = np.zeros(len(e), np.int64), self.moves.astype(np.float32)
        for length in np.unique(lengths).tolist():
            first = starts[lengths == length]
            back = np.empty((length - 1, len(first), len(STATES)), np.uint8)
            best = t[0] + e[first]
            for k in range(1, length):
                through = best[:, :, None] + t
                back[k - 1] = through.argmax(1)
                best = through.max(1) + e[first + k]
                best -= best.max(1, keepdims=True)  # keeps the sums of long stretches small
            state = (best + t[:, 0]).argmax(1)
            out[first + length - 1] = state
            for k in range(length - 2, -1, -1):
                state = back[k][np.arange(len(first)), state]
                out[first + k] = state
        return out


@lru_cache(1)
def field() -> Field:
    """The field, trained once per process from the fixed table (the same everywhere)."""
    return Field(samples())


def covered(spans: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each of `added` (sorted) lies wholly inside the union of `spans` (sorted); one pass over both."""
    union: list[list[int]] = []
    for s, _, e in spans:
        if union and s <= union[-1][1]:
            union[-1][1] = max(union[-1][1], e)
        else:
            union.append([s, e])
    out, k = [], 0
    for s, _, e in added:
        while k < len(union) and union[k][1] < e and union[k][1] <= s:
            k += 1
        out.append(k < len(union) and union[k][0] <= s and e <= union[k][1])
    return out


def found_by(model: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) of the spans of the field in each text, sorted."""
    edge = [SENTINEL] * Field.EDGE
    stream, firsts = edge.copy(), []
    for t in texts:
        firsts.append(len(stream))
        stream += t.split()
        stream += edge
    places, states = model.decode(stream)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(places):
        return out
    begins = np.flatnonzero((states % 2 == 1) | (np.diff(places, prepend=-2) > 1) | (np.diff((states + 1) // 2, prepend=0) != 0))
    lasts = np.append(begins[1:], len(places)) - 1
    owners = np.searchsorted(firsts, places[begins], "right") - 1
    for k in np.unique(owners).tolist():
        mine = np.flatnonzero(owners == k)
        need = places[lasts[mine[-1]]] - firsts[k] + 1
        at = [m.span() for m in islice(_WORD.finditer(texts[k]), int(need))]
        for b, e in zip(begins[mine].tolist(), lasts[mine].tolist()):
            i, j = int(places[b]), int(places[e])
            lo, hi = at[i - firsts[k]][0], at[j - firsts[k]][1]
            left, right = core_of(stream[i])[0], len(stream[j]) - core_of(stream[j])[1]
            if lo + left < hi - right:
                out[k].append((lo + left, (int(states[b]) - 1) // 2, hi - right))
    return out


def all_spans(texts: list[str], model: Field | None = None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text."""
    model = model or field()
    out, lo = [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHARS):
            size += len(texts[hi])
            hi += 1
        for t, added in zip(texts[lo:hi], found_by(model, texts[lo:hi])):
            base = base_spans(t) if _MAYBE.search(t) else []
            if base and added:
                added = [a for a, inside in zip(added, covered(base, added)) if not inside]
            out.append((base, sorted(base + added) if added else base))
        lo = hi
    return out


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the base spans and all spans of every whole text; no shuffle."""
    model = field()  # some hundred KB, shipped with the task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for b in slices(batches):
            found = all_spans(b.column(1).to_pylist(), model)
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([joined(s) for _, s in found], pa.string())], names)

    return spread(documents(df, id_col, text_col)).mapInArrow(run, RESULT)
