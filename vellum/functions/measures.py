"""Boxes, vectors and histograms as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.numbers import once


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of integer boxes [x1, y1, x2, y2]; 0 for null or empty ones."""
    at = lambda box, i: F.get(box, F.lit(i)).cast("bigint")
    area = lambda box: F.greatest(at(box, 2) - at(box, 0), F.lit(0)) * F.greatest(at(box, 3) - at(box, 1), F.lit(0))
    wide = F.greatest(F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0)), F.lit(0))
    high = F.greatest(F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1)), F.lit(0))
    union = area(a) + area(b) - wide * high
    return F.coalesce(F.when(union > 0, wide * high / union), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    product = lambda x, y: x.cast("double") * y.cast("double")
    return F.aggregate(F.zip_with(a, b, product), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def l2_normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _unit(h: Column) -> Column:
    """A histogram as shares; its sum is taken once."""
    return once(F.aggregate(h, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(h, lambda x: x / total))


def wasserstein1(a: Column, b: Column) -> Column:
    """Sum of the differences of the cumulative shares of two histograms over the same bins."""
    delta = F.zip_with(_unit(a), _unit(b), lambda x, y: x - y)
    step = lambda acc, d: F.struct((acc["run"] + d).alias("run"), (acc["sum"] + F.abs(acc["run"] + d)).alias("sum"))
    return F.aggregate(delta, F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def chi_square(a: Column, b: Column, eps: float = 1e-10) -> Column:
    part = lambda x, y: F.pow(x - y, 2) / (x + y + eps)
    return F.aggregate(F.zip_with(_unit(a), _unit(b), part), F.lit(0.0), lambda s, x: s + x) / 2
