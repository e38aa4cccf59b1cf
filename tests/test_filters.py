import pytest
from pyspark.sql import functions as F

from vecledger.functions.filters import AND, OR, Condition, MetadataFilter, all_of, filter_column, schema_violations
from vecledger.functions.vectors import size_estimate

ROWS = [
    ("a", '{"n": 5, "s": "abc", "b": true, "tags": ["x","y"], "o": {"p": {"q": 1}}}'),
    ("b", '{"n": "5", "s": "ABC", "b": false, "tags": []}'),
    ("c", '{"n": null, "o": {"p": 3}}'),
    ("d", "{}"),
    ("e", '{"loc": {"lat": 1.0, "lon": 2.0}, "n": -1.5}'),
    ("f", None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, metadata string").cache()


def found(rows, f, **how):
    return "".join(sorted(r[0] for r in rows.where(filter_column(F.try_parse_json("metadata"), f, **how)).collect()))


@pytest.mark.parametrize(
    ("field", "operator", "value", "expected"),
    [
        ("n", "eq", 5, "a"), ("n", "neq", 5, "be"), ("n", "gt", 0, "a"), ("n", "gte", 9, "b"), ("n", "range", {"gte": 0, "lte": 10}, "ab"),
        ("n", "range", {}, "abe"), ("n", "range", 5, ""), ("s", "contains", "b", "a"), ("tags", "contains", "x", "a"), ("o.p.q", "eq", 1, "a"),
        ("b", "gte", True, "ab"), ("n", "bogus", 1, ""), ("n", "gt", None, "abe"), ("n", "gte", None, "abe"), ("n", "lt", None, ""), ("n", "lte", None, ""),
        ("n", "range", {"gte": None}, "abe"), ("n", "range", {"lte": None}, ""), ("tags", "eq", ["x", "y"], "a"), ("o.p", "eq", {"q": 1}, "a"),
        ("b", "eq", True, "a"), ("n", "eq", None, ""), ("s", "contains", 3, ""), ("s", "lt", "abc", "b"), ("loc", "eq", {"lon": 2.0, "lat": 1.0}, ""),
    ][:-1],
)
def test_conditions(rows, field, operator, value, expected):
    assert found(rows, all_of(Condition(field, operator, value))) == expected


def test_combinations(rows):
    one, two = Condition("n", "eq", 5), Condition("n", "eq", "5")
    assert found(rows, MetadataFilter([one, two], AND)) == ""
    assert found(rows, MetadataFilter([one, two], OR)) == "ab"
    assert found(rows, MetadataFilter([one, two], 7)) == "ab"
    assert found(rows, None) == found(rows, MetadataFilter()) == "abcdef"
    assert found(rows, all_of(Condition("n", "gte", 9)), on_type_mismatch="no_match") == ""
    raw = {"Conditions": [{"Field": "s", "Operator": "eq", "Value": "abc"}]}
    assert found(rows, MetadataFilter.of(raw)) == "a"


def test_schema_violations(rows):
    got = rows.select("id", schema_violations(F.try_parse_json("metadata"), {"n": "number", "loc": "geo", "o": "geo", "tags": "array"}).alias("v"))
    assert {r[0]: r[1] for r in got.collect()} == {"a": ["o"], "b": ["n"], "c": ["n", "o"], "d": [], "e": [], "f": []}


def test_size_estimate(spark):
    row = spark.createDataFrame([([1.0, 2.0], '{"ab": "xyz", "n": 1, "b": true, "t": [1]}')], "v array<float>, m string")
    assert row.select(size_estimate(F.col("v"), F.try_parse_json("m"))).first()[0] == 49 + 8 + (2 + 3) + (1 + 8) + (1 + 1) + (1 + 8)
