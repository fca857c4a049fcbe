"""Distances of vectors, computed in doubles."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.expr import Expr, asc, call, col


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def _l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


def _l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def _cosine(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


#: By name; lower is nearer with each, so the inner product is negated.
METRICS = {"cosine": _cosine, "l2": _l2, "euclidean": _l2, "inner_product": lambda a, b: -_dot(a, b), "dot": lambda a, b: -_dot(a, b), "l1": _l1, "manhattan": _l1}


def _vector(v: Any) -> Any:
    return Expr(lambda s: F.array(*[F.lit(float(x)) for x in v]), frozenset(), f"vector{tuple(v)}") if isinstance(v, (list, tuple)) else v


def vector_distance(metric: str, a: Any, b: Any) -> Expr:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return call(f"distance:{metric}", METRICS[metric], _vector(a), _vector(b))


def cosine_distance(a: Any, b: Any) -> Expr:
    return vector_distance("cosine", a, b)


def l2_distance(a: Any, b: Any) -> Expr:
    return vector_distance("l2", a, b)


def inner_product(a: Any, b: Any) -> Expr:
    """Negated, so that lower is nearer."""
    return vector_distance("inner_product", a, b)


def l1_distance(a: Any, b: Any) -> Expr:
    return vector_distance("l1", a, b)


euclidean_distance, dot_product, manhattan_distance = l2_distance, inner_product, l1_distance


def vector_match(query: Any, column: str, vector: list[float], k: int, metric: str = "l2") -> Any:
    """The query's k rows whose vectors are nearest, nearest first, ties by the primary key: exact, without an index."""
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("k is a whole number from 1")
    near = vector_distance(metric, col(column if "." in column else f"{query.alias}.{column}"), vector)
    return query.order_by(asc(near), asc(col(f"{query.alias}.{query.definition.key}"))).limit(k)
