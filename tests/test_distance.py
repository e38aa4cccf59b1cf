import math

import pytest
from pyspark.sql import functions as F

from vecledger.functions import distance as d
from vecledger.functions.distance import DistanceMetric

A, B, ZERO, SHORT = [1.0, 2.0, 2.0], [2.0, 0.0, 1.0], [0.0, 0.0, 0.0], [1.0]


def array(values):
    return F.array(*map(F.lit, values))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("f", "x", "y", "expected"),
    [
        (d.cosine_similarity, A, B, 4 / (3 * math.sqrt(5))), (d.cosine_similarity, A, ZERO, 0), (d.cosine_similarity, A, SHORT, -1),
        (d.dot_product, A, B, 4), (d.dot_product, A, SHORT, 0), (d.euclidean, A, B, math.sqrt(6)), (d.euclidean, A, SHORT, math.inf),
        (d.manhattan, A, B, 4), (d.manhattan, A, SHORT, math.inf), (d.cosine_normalized, A, SHORT, -1),
    ],
)
def test_distances(spark, f, x, y, expected):
    assert value(spark, f(array(x), array(y))) == pytest.approx(expected)


def test_scores_and_directions(spark):
    score = lambda m, x: value(spark, d.normalized_score(F.lit(x), m))
    assert score(DistanceMetric.COSINE, 0.5) == 0.75
    assert [score(DistanceMetric.DOT_PRODUCT, x) for x in (-1.0, 0.3, 7.0)] == [0, 0.3, 1]
    assert score(DistanceMetric.EUCLIDEAN, 1.0) == pytest.approx(math.exp(-1))
    assert score(DistanceMetric.MANHATTAN, 1.0) == pytest.approx(math.exp(-0.5))
    assert score(None, 1.0) == 0.5
    assert [d.is_higher_better(m) for m in DistanceMetric] == [True, True, False, False]
    with pytest.raises(ValueError):
        d.distance_function(9)


def test_metric_names(spark):
    names = ["COSINE", "dot", "DotProduct", "L2", "euclid", "taxicab", "l1", "hamming", None]
    expected = ["Cosine", "DotProduct", "DotProduct", "Euclidean", "Euclidean", "Manhattan", "Manhattan", "Cosine", "Cosine"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    assert [r[0] for r in rows.select(d.metric_name(F.col("n"))).collect()] == expected
    assert [d.NAMES[d.parse_metric(n)] for n in names] == expected


def test_normalize(spark):
    assert value(spark, d.normalize(array(A))) == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    assert value(spark, d.normalize(array(ZERO))) == [0, 0, 0]
    sparse = lambda keys, values: d.to_sparse(array(keys), array(values))
    assert value(spark, d.sparse_dot(sparse([1, 5], [2.0, 3.0]), sparse([5, 9], [4.0, 1.0]))) == 12
