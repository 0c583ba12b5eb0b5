"""Vector scores as column expressions, in DOUBLE."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric names and whether a higher score is better.
HIGHER_IS_BETTER = {"Cosine": True, "Dot": True, "Euclid": False, "Manhattan": False}


def check_metric(metric: str) -> str:
    if metric not in HIGHER_IS_BETTER:
        raise ValueError(f"invalid distance: {metric}")
    return metric


def _double(x: Column) -> Column:
    return x.cast("double")


def _sum_of(a: Column, b: Column, term) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(_double(x), _double(y)))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum_of(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + _double(x) * _double(x)))


def score(a: Column, b: Column, metric: str) -> Column:
    """Score of two vector columns; NULL for different lengths, cosine 0 for a zero vector."""
    check_metric(metric)
    if metric == "Euclid":
        return F.sqrt(_sum_of(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "Manhattan":
        return _sum_of(a, b, lambda x, y: F.abs(x - y))
    if metric == "Dot":
        return _dot(a, b)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(_dot(a, b), norm(a) * norm(b)), F.lit(0.0)))


def score_literal(vector: Column, query: Sequence[float], metric: str) -> Column:
    """Score against one literal query, whose norm is taken here and not per row.

    (Writing the products out one by one is slower: the method gets too large
    for the JVM to compile.)
    """
    values = [float(q) for q in query]
    if check_metric(metric) != "Cosine":
        return score(vector, F.lit(values), metric)
    length = math.sqrt(sum(v * v for v in values))
    unit = F.lit([v / length for v in values] if length else values)
    return F.when(F.size(vector) == len(values), F.coalesce(F.try_divide(_dot(vector, unit), norm(vector)), F.lit(0.0)))


def best_first(score_col: str, metric: str) -> Column:
    """Ordering of a score column, best first."""
    return F.col(score_col).desc() if HIGHER_IS_BETTER[check_metric(metric)] else F.col(score_col).asc()


def passes_threshold(score_col: Column, threshold: float | Column, metric: str) -> Column:
    """Keep ``>= threshold`` for similarities and ``<= threshold`` for distances."""
    return score_col >= threshold if HIGHER_IS_BETTER[check_metric(metric)] else score_col <= threshold
