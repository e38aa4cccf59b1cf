import pytest
from pyspark.sql import functions as F

from vecledger.functions.distance import DistanceMetric
from vecledger.operators.collection import Conflict, Engine, NotFound, recommended
from vecledger.operators.knn import batch_knn, knn
from vecledger.plans.request import QueryRequest, RecommendParams, ScrollParams, SearchParams, SearchStrategy
from vecledger.sources.binary import InvalidFormat, deserialized, pack, serialized, unpack

SAMPLE = [
    ("v1", [1.0, 0.0, 0.0], "electronics"), ("v2", [0.0, 1.0, 0.0], "electronics"), ("v3", [0.0, 0.0, 1.0], "clothing"), ("v4", [0.5, 0.5, 0.0], "electronics"),
    ("v5", [0.8, 0.1, 0.1], "electronics"), ("v6", [0.1, 0.8, 0.1], "electronics"), ("v7", [0.1, 0.1, 0.8], "clothing"), ("v8", [0.33, 0.33, 0.33], "home"),
]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    rows = spark.createDataFrame([(i, v, f'{{"category": "{c}"}}') for i, v, c in SAMPLE], "id string, values array<float>, metadata string")
    e.create("sample", 3, "Cosine").insert(rows)
    return e


def ids(df):
    return [r["id"] for r in df.collect()]


def test_flagship(engine):
    raw = {"vector": [1.0, 0.0, 0.0], "limit": 5, "filter": {"conditions": [{"field": "category", "operator": "eq", "value": "electronics"}]}}
    got = engine.query("sample", raw).collect()
    assert [r["id"] for r in got] == ["v1", "v5", "v4", "v6", "v2"]
    assert [r["distance"] for r in got] == pytest.approx([1, 0.984732, 0.707107, 0.123091, 0], abs=1e-6)
    assert [r["score"] for r in got] == pytest.approx([1, 0.992366, 0.853553, 0.561546, 0.5], abs=1e-6)
    assert '"status": "ok"' in engine.respond("sample", raw)


def test_writes(engine, spark):
    c = engine.collection("sample")
    c.delete(["v1"])
    c.delete(["v1"])
    assert engine.info("sample") == {"name": "sample", "dimension": 3, "metric": "Cosine", "count": 7}
    assert "v1" not in ids(c.query(QueryRequest(vector=[1.0, 0.0, 0.0])))
    c.insert(spark.createDataFrame([("v1", [0.0, 0.0, 2.0])], "id string, values array<float>"))
    assert c.count() == 8 and list(c.get("v1").first()["values"]) == [0, 0, 2]
    with pytest.raises(NotFound):
        c.delete(["nobody"])
    with pytest.raises(ValueError, match="dimension"):
        c.insert(spark.createDataFrame([("ok", [1.0, 2.0, 3.0]), ("bad", [1.0])], "id string, values array<float>"))
    assert c.count() == 8
    assert ids(c.list_vectors(2, 3)) == ["v4", "v5"]
    for bad in ((0, 0), (1, -1)):
        with pytest.raises(ValueError):
            c.list_vectors(*bad)
    with pytest.raises(ValueError):
        c.add_index("other", 4)


def test_catalog(engine):
    with pytest.raises(Conflict):
        engine.create("sample", 3)
    with pytest.raises(ValueError):
        engine.create("x", 0)
    assert [c["name"] for c in engine.list()] == ["sample"]
    engine.drop("sample")
    with pytest.raises(NotFound):
        engine.collection("sample")


def test_schema(spark):
    c = Engine(spark).create("typed", 1, "l2", {"price": "number"})
    with pytest.raises(ValueError, match="price"):
        c.insert(spark.createDataFrame([("a", [1.0], '{"price": "7"}')], "id string, values array<float>, metadata string"))
    c.insert(spark.createDataFrame([("a", [1.0], '{"price": 7, "other": "x"}')], "id string, values array<float>, metadata string"))
    assert c.count() == 1


def test_query_kinds(engine):
    c = engine.collection("sample")
    assert ids(c.query(QueryRequest(point_id="v1", limit=2))) == ["v1", "v5"]
    assert ids(c.query(QueryRequest(scroll=ScrollParams("", 3)))) == ["v1", "v2", "v3"]
    assert ids(c.query(QueryRequest(scroll=ScrollParams("after:v6", 3)))) == ["v7", "v8"]
    assert ids(c.query(QueryRequest(recommend=RecommendParams(["v1"], ["v2"]), limit=1))) == ["v5"]
    assert sorted(ids(c.query(QueryRequest(sample=True, limit=20)))) == [f"v{i}" for i in range(1, 9)]
    q = QueryRequest(vector=[1.0, 0.0, 0.0], limit=4)
    assert ids(c.query(q.__class__(vector=[1.0, 0.0, 0.0], limit=4, offset=3))) == ids(c.query(q))[3:]
    assert ids(c.query(q.__class__(vector=[1.0, 0.0, 0.0], limit=4, offset=4))) == ids(c.query(q))
    with pytest.raises(NotFound):
        c.query(QueryRequest(point_id="nobody"))
    with pytest.raises(ValueError):
        c.query(QueryRequest(vector=[1.0]))
    with pytest.raises(ValueError):
        c.query(QueryRequest())
    groups = c.query_groups(QueryRequest(vector=[1.0, 0.0, 0.0], group_by="category", group_size=2, group_limit=2)).collect()
    assert sorted((r["group_rank"], r["hit_rank"], r["id"]) for r in groups) == [(1, 1, "v1"), (1, 2, "v5"), (2, 1, "v8")]
    full = c.query(QueryRequest(vector=[1.0, 0.0, 0.0], limit=1, with_vectors=True, with_payload=["category"])).first()
    assert full["metadata"] == '{"category":"electronics"}' and list(full["values"]) == [1, 0, 0]
    batch = c.query_batch([q, QueryRequest(scroll=ScrollParams("", 2)), QueryRequest(vector=[0.0, 1.0, 0.0], limit=2, params=SearchParams(score_threshold=0.9))]).collect()
    assert [r["id"] for r in sorted((r for r in batch if r["request"] == 0), key=lambda r: (-r["distance"], r["id"]))] == ids(c.query(q))
    assert sorted(r["id"] for r in batch if r["request"] == 1) == ["v1", "v2"] and {r["id"] for r in batch if r["request"] == 2} == {"v2", "v6"}
    with pytest.raises(ValueError):
        c.query_batch([q, QueryRequest()])
    assert c.query_batch([]).count() == 0


def test_scroll_cursor(engine):
    import json

    seen, cursor = [], ""
    while cursor is not None:
        answer = json.loads(engine.respond("sample", {"scroll": {"offset": cursor, "limit": 3}}))["result"]
        seen += [p["id"] for p in answer["points"]]
        cursor = answer["next"]
    assert seen == [f"v{i}" for i in range(1, 9)]


def test_recommend_strategies(engine):
    c = engine.collection("sample")
    best = c.query(QueryRequest(recommend=RecommendParams(["v1", "v3"], ["v2"], "best"), limit=8)).collect()
    assert [r["id"] for r in best][:2] == ["v5", "v7"] and {r["id"] for r in best if r["distance"] == float("-inf")} == {"v4", "v6", "v8"}
    with pytest.raises(ValueError, match="strategy"):
        c.query(QueryRequest(recommend=RecommendParams(["v1"], [], "worst")))


def test_reopen_and_drop(spark, tmp_path):
    import os

    folder = str(tmp_path)
    e = Engine.opened(spark, folder)
    c = e.create("a/b", 2, "l2", {"price": "number", "tag": "string"}, {"title": 3})
    row = "id string, values array<float>, metadata string, title array<float>"
    c.insert(spark.createDataFrame([("x", [1.0, 0.0], '{"price": 5, "tag": "t"}', [1.0, 0.0, 0.0]), ("y", [0.0, 1.0], '{"price": 9, "o": {"p": 1, "q": 2}}', [0.0, 1.0, 0.0]), ("z", [5.0, 5.0], None, None)], row))
    c.delete(["z"])
    with pytest.raises(ValueError, match="title"):
        c.insert(spark.createDataFrame([("w", [1.0, 0.0], None, [1.0])], row))
    f = {"conditions": [{"field": "price", "operator": "gt", "value": 6}]}
    for compact in (False, True):
        e = Engine.opened(spark, folder)
        if compact:
            e.compact("a/b")
            e = Engine.opened(spark, folder)
            c = e.collection("a/b")
            assert c.unique and "GreaterThan(m_price,6.0)" in c.query(QueryRequest.of({"vector": [1.0, 0.0], "filter": f}))._jdf.queryExecution().toString().replace(" ", "")
        assert e.list() == [{"name": "a/b", "dimension": 2, "metric": "Euclidean", "count": 2}]
        assert ids(e.query("a/b", {"vector": [1.0, 0.0], "filter": f})) == ["y"]
        assert ids(e.query("a/b", {"vector": [0.0, 1.0, 0.0], "using": "title", "limit": 1})) == ["y"]
        got = e.query("a/b", {"pointid": "y", "limit": 1, "withpayload": {"exclude": ["o.p", "price"]}}).first()
        assert got["metadata"] == '{"o":{"q":2}}'
        assert e.query("a/b", {"pointid": "y", "limit": 1, "withpayload": ["o.q", "none"]}).first()["metadata"] == '{"o":{"q":2}}'
        with pytest.raises(ValueError, match="no vector"):
            e.query("a/b", {"vector": [1.0, 1.0], "using": "nothing"})
    c = e.collection("a/b")
    c.insert(spark.createDataFrame([("x", [3.0, 3.0], '{"price": 7}', None)], row))
    for e in (e, Engine.opened(spark, folder)):
        assert not e.collection("a/b").unique and ids(e.query("a/b", {"vector": [3.0, 3.0], "filter": f})) == ["x", "y"]
    assert len(os.listdir(folder)) == 1
    e.drop("a/b")
    assert os.listdir(folder) == [] and Engine.opened(spark, folder).list() == []


def test_index_of_a_collection(spark):
    import random

    rng = random.Random(2)
    rows = spark.createDataFrame([(f"{i:03d}", [rng.gauss(i % 4 * 6, 1) for _ in range(5)]) for i in range(200)], "id string, values array<float>")
    c = Engine(spark).register("r", rows, 5, "l2", unique=True)
    v = [6.0] * 5
    exact = ids(c.query(QueryRequest(vector=v)))
    c.build_index("ivf", 8)
    assert ids(c.query(QueryRequest(vector=v, params=SearchParams(search_strategy=SearchStrategy.EXACT)))) == exact
    for s in (SearchStrategy.DEFAULT, SearchStrategy.FAST, SearchStrategy.PRECISE):
        request = QueryRequest(vector=v, params=SearchParams(search_strategy=s))
        assert "cell" in c.query(request)._jdf.queryExecution().toString() and len(set(ids(c.query(request))) & set(exact)) >= 9
    c.insert(spark.createDataFrame([("new", v)], "id string, values array<float>"))
    assert ids(c.query(QueryRequest(vector=v)))[0] == "new"


def test_request_rules():
    assert QueryRequest(vector=[1.0], limit=0).normalized().limit == 10
    r = QueryRequest(vector=[1.0], limit=7, group_by="x", group_size=3).normalized()
    assert (r.group_size, r.group_limit) == (1, 7)
    ef = lambda s, e=0: SearchParams(hnsw_ef=e, search_strategy=s).adjusted()
    assert [ef(s).hnsw_ef for s in SearchStrategy] == [100, 0, 40, 300, 0]
    assert [ef(s, 7).hnsw_ef for s in SearchStrategy] == [7, 0, 7, 7, 7] and not SearchParams(exact=True).adjusted().exact
    assert ef(SearchStrategy.EXACT).exact and ef(SearchStrategy.DEFAULT, 7).hnsw_ef == 7
    assert [SearchParams.default().hnsw_ef, SearchParams.fast().hnsw_ef, SearchParams.precise().hnsw_ef] == [100, 40, 300]
    shows = lambda p: QueryRequest(with_payload=p).payload_fields()
    assert [shows(p) for p in (True, False, "x", [], ["a"], {"a": 1}, 3)] == [True, False, True, False, ["a"], True, False]
    raw = QueryRequest.of({"Vector": [1.0], "WithVectors": True, "with_payload": True, "params": {"score_threshold": 0.5}})
    assert raw.with_vectors and raw.with_payload and raw.params.score_threshold == 0.5
    with pytest.raises(ValueError):
        recommended([], [[1.0]])


@pytest.mark.parametrize("metric", list(DistanceMetric))
def test_metrics_and_batch(spark, metric):
    rows = spark.createDataFrame([("v1", [1.0, 0.0, 0.0]), ("v2", [0.0, 1.0, 0.0]), ("v3", [0.0, 0.0, 1.0]), ("v4", [0.5, 0.5, 0.0]), ("n", None)], "id string, values array<float>")
    best = knn(rows, [0.7, 0.7, 0.0], metric, 1).first()
    assert best["distance"] == pytest.approx({0: 1, 1: 0.7, 2: 0.282843, 3: 0.4}[int(metric)], abs=1e-6)
    q = spark.createDataFrame([(1, [0.7, 0.7, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id int, values array<float>")
    got = batch_knn(rows, q, metric, 3).collect()
    assert len(got) == 6
    one = knn(rows, [0.7, 0.7, 0.0], metric, 3).collect()
    mine = sorted((r for r in got if r["query_id"] == 1), key=lambda r: r["rank"])
    assert [r["id"] for r in mine] == [r["id"] for r in one]
    assert [r["score"] for r in mine] == pytest.approx([r["score"] for r in one])
    assert batch_knn(rows.where("false"), q, metric).count() == batch_knn(rows, q.where("false"), metric).count() == 0


def test_threshold_and_plan(spark):
    rows = spark.createDataFrame([("v1", [1.0, 0.0]), ("v2", [0.0, 1.0]), ("v3", [0.7, 0.7]), ("v4", [-1.0, 0.0])], "id string, values array<float>")
    got = ids(knn(rows, [0.8, 0.6], DistanceMetric.COSINE, 10, threshold=0.95))
    assert got == ["v3"]
    plan = knn(rows, [0.8, 0.6], DistanceMetric.COSINE, 2, F.col("id") != "v1")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_binary(spark):
    raw = pack("idé", [1.5, -2.0], '{"a": 1}', 7, True)
    assert unpack(raw) == ("idé", [1.5, -2.0], '{"a": 1}', 7, True)
    for bad in (b"", raw[:-1], raw + b"x", b"\xff\xff\xff\xff"):
        with pytest.raises(InvalidFormat):
            unpack(bad)
    rows = spark.createDataFrame([("a", [1.0], "{}", 5, False)], "id string, values array<float>, metadata string, ts_ns bigint, deleted boolean")
    assert deserialized(serialized(rows)).collect() == rows.collect()
