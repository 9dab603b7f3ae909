"""Distances between vectors as Column expressions. For all of them smaller is closer.

Elements are compared in double precision. Vectors of unequal length give null: callers check
dimensions once, instead of each row's distance being cut to the shorter vector.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(StrEnum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot"
    MANHATTAN = "manhattan"
    HAMMING = "hamming"


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: x * x)))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """1 - cos; 0 if either vector is all zeros. Norms known beforehand save work."""
    length = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return F.when(length == 0, F.lit(0.0)).otherwise(1 - dot_product(a, b) / F.nullif(length, F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def negated_dot(a: Column, b: Column) -> Column:
    return -dot_product(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def hamming(a: Column, b: Column) -> Column:
    """Share of places that differ. 0.0 and -0.0 differ, as their strings do; NaN equals NaN."""
    differ = F.zip_with(as_double(a), as_double(b), lambda x, y: (x.cast("string") != y.cast("string")).cast("double"))
    return F.when(F.size(a) == 0, F.lit(float("nan"))).otherwise(_sum(differ) / F.nullif(F.size(a), F.lit(0)))


Distance = Callable[[Column, Column], Column]

_REGISTERED: dict[str, Distance] = {
    Metric.COSINE: cosine,
    Metric.EUCLIDEAN: euclidean,
    Metric.DOT: negated_dot,
    Metric.MANHATTAN: manhattan,
    Metric.HAMMING: hamming,
}


def register(name: str, distance: Distance) -> None:
    """Makes a distance of your own available by name."""
    _REGISTERED[name] = distance


def distance(metric: str | Distance, a: Column, b: Column) -> Column:
    if callable(metric):
        return metric(a, b)
    if metric not in _REGISTERED:
        raise ValueError(f"unknown metric {metric!r}; known are {sorted(map(str, _REGISTERED))}")
    return _REGISTERED[metric](a, b)
