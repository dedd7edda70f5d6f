"""Scalar functions as Columns, under one name each, and small fixed-size linear algebra."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

minimum, maximum = F.least, F.greatest
absolute, sqrt, exp, power = F.abs, F.sqrt, F.exp, F.pow
sin, cos, tan, atan2 = F.sin, F.cos, F.tan, F.atan2
log, log2, log10 = F.log, F.log2, F.log10


def rsqrt(x: Column) -> Column:
    """1/sqrt(x); infinite at zero, as IEEE division gives."""
    return F.when(x == 0, F.lit(math.inf)).otherwise(F.lit(1.0) / F.sqrt(x))


def fmod(x: Column, y: Column) -> Column:
    return x % y


def fma(a: Column, b: Column, c: Column) -> Column:
    return a * b + c


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def round_away(x: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + F.lit(0.5)).cast("double")


def sincos(x: Column) -> tuple[Column, Column]:
    return F.sin(x), F.cos(x)


# Lanczos coefficients for g = 7 and nine terms (fixed values of the approximation)
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def tgamma(x: Column) -> Column:
    """The gamma function by Lanczos' approximation, reflected below one half."""

    def right(z: Column) -> Column:
        y = z - F.lit(1.0)
        s = reduce(lambda a, k: a + F.lit(_LANCZOS[k]) / (y + F.lit(float(k))), range(1, 9), F.lit(_LANCZOS[0]))
        t = y + F.lit(7.5)
        return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, y + F.lit(0.5)) * F.exp(-t) * s

    return F.when(x >= 0.5, right(F.greatest(x, F.lit(0.5)))).otherwise(F.lit(math.pi) / (F.sin(F.lit(math.pi) * x) * right(F.lit(1.0) - F.least(x, F.lit(0.5)))))


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, (p * q for p, q in zip(a, b)))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3] for k in range(3)]


def determinant(m: list[list[Column]]) -> Column:
    """By expansion along the first row."""
    if len(m) == 1:
        return m[0][0]
    terms = [(m[0][k] if k % 2 == 0 else -m[0][k]) * determinant([r[:k] + r[k + 1 :] for r in m[1:]]) for k in range(len(m))]
    return reduce(lambda x, y: x + y, terms)


def inverse(m: list[list[Column]]) -> list[list[Column]]:
    """Inverse of a small matrix by cofactors; null where it is singular."""
    n, det = len(m), determinant(m)
    minor = lambda i, j: determinant([r[:j] + r[j + 1 :] for k, r in enumerate(m) if k != i])
    return [[F.try_divide(minor(j, i) if (i + j) % 2 == 0 else -minor(j, i), det) for j in range(n)] for i in range(n)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def invert_matrix(flat: pd.Series) -> pd.Series:
    """Inverse of an N x N matrix given row by row; null where it is singular. For N beyond four."""

    def one(values):
        n = math.isqrt(len(values))
        try:
            return np.linalg.inv(np.reshape(values, (n, n))).ravel()
        except np.linalg.LinAlgError:
            return None

    return flat.map(one, na_action="ignore")


def div_round_up(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("bigint")


def next_multiple(a: Column, b: Column) -> Column:
    return div_round_up(a, b) * b


def is_power_of_two(a: Column) -> Column:
    return (a > 0) & (F.bit_count(a) == 1)


def decomp_1d(n_parts: int, n: int, rank: Column) -> tuple[Column, Column]:
    """[start, end) of a part when n items are dealt evenly, the first parts taking one more."""
    base, extra = divmod(n, n_parts)
    start = rank * F.lit(base) + F.least(rank, F.lit(extra))
    return start, start + F.lit(base) + F.when(rank < extra, 1).otherwise(0)


def nd_index(index: list[Column], shape: list[int]) -> Column:
    """Linear index of an N-dimensional one, the last index fastest."""
    out = F.lit(0).cast("bigint")
    for i, n in zip(index, shape):
        out = out * F.lit(n) + i
    return out
