"""Counter-based random numbers: a draw depends on (seed, step, component, row) alone.

Draws do not depend on partitioning, so a task that runs again draws the same numbers. Seed, step
and component give, through a cryptographic hash, the constants of a stream's own function; a row's
64 bits enter it in three parts with a multiplier each. Streams are therefore no shifts of
each other, and rows beyond 2**31 do not repeat.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prime modulus of draws, the bits of a row's lower parts and the rounds of mixing (fixed values).
MODULUS, PART_BITS, ROUNDS = 2147483647, 30, 3


def constants(seed: int, step: int, comp: int, n: int) -> list[int]:
    """n numbers in [1, MODULUS) of one stream."""
    key = f"{seed}:{step}:{comp}:".encode()
    return [int.from_bytes(hashlib.blake2b(key + b"%d" % k, digest_size=16).digest(), "big") % (MODULUS - 1) + 1 for k in range(n)]


def draw(seed: int, step: int, row: Column | list[Column], comp: int = 0) -> Column:
    """An integer in [0, MODULUS) for a row, or for several columns that name one together.

    Products stay below 2**62 and sums below 2**63, so any engine with 64-bit integers computes the same.
    """
    rows = row if isinstance(row, list) else [row]
    keys = iter(constants(seed, step, comp, 3 * len(rows) + 2 * ROUNDS))
    m, x = F.lit(MODULUS).cast("bigint"), F.lit(0).cast("bigint")
    for r in rows:
        r = r.cast("bigint")
        low = F.lit((1 << PART_BITS) - 1).cast("bigint")
        for part in (r.bitwiseAND(low), F.shiftright(r, PART_BITS).bitwiseAND(low), F.pmod(F.shiftright(r, 2 * PART_BITS), m)):
            x = x + part * F.lit(next(keys)).cast("bigint") % m
    for _ in range(ROUNDS):
        x = (x % m * F.lit(next(keys)).cast("bigint") + F.lit(next(keys)).cast("bigint")) % m
        x = x * (x % F.lit(65536) + F.lit(1)) % m
    return x


def uniform(seed: int, step: int, row: Column, comp: int = 0) -> Column:
    """In [0, 1)."""
    return draw(seed, step, row, comp).cast("double") / F.lit(float(MODULUS))


def normal(seed: int, step: int, row: Column, comp: int = 0, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """By Box and Muller's transform of two uniform draws."""
    u = (draw(seed, step, row, 2 * comp).cast("double") + F.lit(1.0)) / F.lit(float(MODULUS) + 1.0)
    v = uniform(seed, step, row, 2 * comp + 1)
    return F.lit(mean) + F.lit(sigma) * F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


class Source:
    """A source of random Columns; subclasses or `of` give the function."""

    ncomp = 1

    def at(self, row: Column, comp: int = 0) -> Column:
        raise NotImplementedError

    @staticmethod
    def of(function: Callable[[Column, int], Column], ncomp: int = 1) -> "Source":
        s = Source()
        s.ncomp, s.at = ncomp, lambda row, comp=0: function(row, comp)
        return s


class Uniform(Source):
    def __init__(self, seed: int, step: int = 0, ncomp: int = 1):
        self.seed, self.step, self.ncomp = seed, step, ncomp

    def at(self, row: Column, comp: int = 0) -> Column:
        return uniform(self.seed, self.step, row, comp)


class Null(Source):
    """Zeros."""

    def at(self, row: Column, comp: int = 0) -> Column:
        return F.lit(0.0)


class Tuple(Source):
    """Several sources side by side; component k is the k-th source's first."""

    def __init__(self, *sources: Source):
        self.sources, self.ncomp = sources, len(sources)

    def at(self, row: Column, comp: int = 0) -> Column:
        return self.sources[comp].at(row, 0)


class Pool(Source):
    """A shared pool of n draws, taken by ordinal: beyond it draws are 0 and not ok."""

    def __init__(self, seed: int, n: int):
        self.seed, self.n = seed, n

    def at(self, ordinal: Column, comp: int = 0) -> Column:
        return F.when(ordinal < self.n, uniform(self.seed, 0, ordinal)).otherwise(F.lit(0.0))

    def ok(self, ordinal: Column) -> Column:
        return ordinal < self.n
