"""Distances, scores and other scalar functions of vectors, as Column expressions.

All arithmetic is DOUBLE. Vectors are ARRAY<FLOAT> or ARRAY<DOUBLE>.
"""

from __future__ import annotations

from enum import IntEnum
from math import isfinite, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


class DistanceMetric(IntEnum):
    COSINE = 0
    DOT_PRODUCT = 1
    EUCLIDEAN = 2
    MANHATTAN = 3


#: The spellings of metric names that clients may send, in lower case.
ALIASES = {
    "cosine": DistanceMetric.COSINE,
    "dotproduct": DistanceMetric.DOT_PRODUCT,
    "dot_product": DistanceMetric.DOT_PRODUCT,
    "dot": DistanceMetric.DOT_PRODUCT,
    "euclidean": DistanceMetric.EUCLIDEAN,
    "euclid": DistanceMetric.EUCLIDEAN,
    "l2": DistanceMetric.EUCLIDEAN,
    "manhattan": DistanceMetric.MANHATTAN,
    "taxicab": DistanceMetric.MANHATTAN,
    "cityblock": DistanceMetric.MANHATTAN,
    "l1": DistanceMetric.MANHATTAN,
}

#: The names under which metrics are reported.
NAMES = {
    DistanceMetric.COSINE: "Cosine",
    DistanceMetric.DOT_PRODUCT: "DotProduct",
    DistanceMetric.EUCLIDEAN: "Euclidean",
    DistanceMetric.MANHATTAN: "Manhattan",
}


def parse_metric(name: str | None) -> DistanceMetric:
    """The metric a client means; unknown and missing names mean Cosine."""
    return ALIASES.get((name or "").lower(), DistanceMetric.COSINE)


def metric_of(name: Column) -> Column:
    """parse_metric for a column; INT."""
    out = None
    for metric in (DistanceMetric.DOT_PRODUCT, DistanceMetric.EUCLIDEAN, DistanceMetric.MANHATTAN):
        hit = F.lower(name).isin([a for a, m in ALIASES.items() if m == metric])
        out = F.when(hit, int(metric)) if out is None else out.when(hit, int(metric))
    return out.otherwise(int(DistanceMetric.COSINE))


def metric_name(name: Column) -> Column:
    """The reported name of the metric that a client's spelling means."""
    code = metric_of(name)
    out = F.lit(NAMES[DistanceMetric.COSINE])
    for metric in (DistanceMetric.DOT_PRODUCT, DistanceMetric.EUCLIDEAN, DistanceMetric.MANHATTAN):
        out = F.when(code == int(metric), NAMES[metric]).otherwise(out)
    return out


def is_higher_better(metric: DistanceMetric) -> bool:
    return metric not in (DistanceMetric.EUCLIDEAN, DistanceMetric.MANHATTAN)


def vector_literal(values: list[float]) -> Column:
    """ARRAY<DOUBLE> constant, made in one call."""
    parts = (f"{float(x)!r}D" if isfinite(x) else f"double('{float(x)}')" for x in values)
    return F.expr(f"array({', '.join(parts)})") if len(values) else F.array().cast("array<double>")


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot_product(a: Column, b: Column) -> Column:
    """Sum of products; 0 if the lengths differ."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(_fold(F.zip_with(_d(a), _d(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(_d(v), lambda x: x * x)))


def cosine_with_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity from known norms; 0 for a zero norm, -1 if the lengths differ."""
    dot = _fold(F.zip_with(_d(a), _d(b), lambda x, y: x * y))
    return (
        F.when(F.size(a) != F.size(b), -1.0)
        .when((norm_a == 0) | (norm_b == 0), 0.0)
        .otherwise(dot / F.nullif(norm_a * norm_b, F.lit(0.0)))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    return cosine_with_norms(a, b, norm(a), norm(b))


def cosine_normalized(a: Column, b: Column) -> Column:
    """Cosine similarity of unit vectors; -1 if the lengths differ."""
    return F.when(F.size(a) != F.size(b), -1.0).otherwise(dot_product(a, b))


def euclidean(a: Column, b: Column) -> Column:
    """Infinite if the lengths differ."""
    total = _fold(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(F.sqrt(total))


def manhattan(a: Column, b: Column) -> Column:
    """Infinite if the lengths differ."""
    total = _fold(F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)))
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(total)


DISTANCES = {
    DistanceMetric.COSINE: cosine_similarity,
    DistanceMetric.DOT_PRODUCT: dot_product,
    DistanceMetric.EUCLIDEAN: euclidean,
    DistanceMetric.MANHATTAN: manhattan,
}


def distance_function(metric):
    """The Column function of a metric, or a function of two Columns as it is; ValueError if there is none."""
    if callable(metric) and not isinstance(metric, DistanceMetric):
        return metric
    try:
        return DISTANCES[DistanceMetric(metric)]
    except (KeyError, ValueError):
        raise ValueError(f"unsupported distance metric: {metric!r}") from None


def distance_to(v: Column, query: list[float], metric: DistanceMetric) -> Column:
    """Distance of a column to one known vector, whose norm is not computed by row."""
    q = vector_literal(query)
    if metric == DistanceMetric.COSINE:
        return cosine_with_norms(v, q, norm(v), F.lit(sqrt(sum(float(x) * float(x) for x in query))))
    return distance_function(metric)(v, q)


def normalize(v: Column) -> Column:
    """v over its L2 norm; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_d(v), lambda x: x / F.nullif(n, F.lit(0.0)))).otherwise(_d(v))


def normalized_score(distance: Column, metric: DistanceMetric | None) -> Column:
    """Score in [0, 1]; 0.5 for an unknown metric."""
    if metric == DistanceMetric.COSINE:
        return (distance + 1) / 2
    if metric == DistanceMetric.DOT_PRODUCT:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance))
    if metric == DistanceMetric.EUCLIDEAN:
        return F.exp(-distance)
    if metric == DistanceMetric.MANHATTAN:
        return F.exp(-distance * 0.5)
    return F.lit(0.5)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of MAP<INT, FLOAT> vectors: only indices in both count."""
    shared = F.filter(F.map_keys(a), lambda k: F.map_contains_key(b, k))
    return _fold(F.transform(shared, lambda k: F.element_at(a, k).cast("double") * F.element_at(b, k).cast("double")))


def sparse_norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(F.map_values(a), lambda x: x.cast("double") * x.cast("double"))))


def sparse_distance(a: Column, b: Column, metric: DistanceMetric) -> Column:
    """Distance of MAP<INT, FLOAT> vectors, whose missing indices are zeros."""
    if metric == DistanceMetric.DOT_PRODUCT:
        return sparse_dot(a, b)
    if metric == DistanceMetric.COSINE:
        n = sparse_norm(a) * sparse_norm(b)
        return F.when(n == 0, 0.0).otherwise(sparse_dot(a, b) / F.nullif(n, F.lit(0.0)))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k).cast("double"), F.lit(0.0))
    gaps = F.transform(F.array_union(F.map_keys(a), F.map_keys(b)), lambda k: at(a, k) - at(b, k))
    if metric == DistanceMetric.EUCLIDEAN:
        return F.sqrt(_fold(F.transform(gaps, lambda x: x * x)))
    return _fold(F.transform(gaps, F.abs))


def to_sparse(indices: Column, values: Column) -> Column:
    return F.map_from_arrays(indices, values)
