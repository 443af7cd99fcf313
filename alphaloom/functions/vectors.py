"""Small linear algebra as column expressions."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse2(a: Column, b: Column, d: Column) -> tuple[Column, Column, Column]:
    """Of the symmetric matrix [[a, b], [b, d]]: its three different entries."""
    det = a * d - b * b
    return d / det, -b / det, a / det


def inverse3(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> list[Column]:
    """Of the symmetric matrix [[a, b, c], [b, d, e], [c, e, f]]: its six different entries in the same order."""
    p, q, r = d * f - e * e, c * e - b * f, b * e - c * d
    det = a * p + b * q + c * r
    return [p / det, q / det, r / det, (a * f - c * c) / det, (b * c - a * e) / det, (a * d - b * b) / det]


def mat_vec3(m: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    """A symmetric matrix, as its six entries, times a vector."""
    a, b, c, d, e, f = m
    x, y, z = v
    return [a * x + b * y + c * z, b * x + d * y + e * z, c * x + e * y + f * z]


def vec_vec_dot(a: Column, b: Column) -> Column:
    """Of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mat_vec_dot(m: Column, v: Column) -> Column:
    """An array of rows times an array."""
    return F.transform(m, lambda row: vec_vec_dot(row, v))


def vec_vec_outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def kernel_matrix(x: Column, weight: Column) -> Column:
    """exp(-sum(weight (a - b)^2)) of all pairs of rows of an array of arrays."""
    gap = lambda a, b: F.aggregate(F.zip_with(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), weight, lambda d, w: d * w), F.lit(0.0), lambda s, t: s + t)
    return F.transform(x, lambda a: F.transform(x, lambda b: F.exp(-gap(a, b))))


def div_round_up(x: Column | int, n: int) -> Column | int:
    return -(-x // n) if isinstance(x, int) else F.ceil(x / n).cast("long")


def isiterable(obj: object) -> bool:
    try:
        iter(obj)  # type: ignore[call-overload]
    except TypeError:
        return False
    return True


class Timer:
    """stop() gives the seconds since the last stop, and prints them with a message."""

    def __init__(self) -> None:
        self.last = time.perf_counter()

    def stop(self, message: str | None = None) -> float:
        now = time.perf_counter()
        gone, self.last = now - self.last, now
        if message is not None:
            print(f"{gone:.3f} s - {message}")
        return gone
