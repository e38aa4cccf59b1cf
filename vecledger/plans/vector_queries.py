"""Queries on vectors and their SQL.

`embeddings` is the point table (its vectors scaled by 1 + vec_id % 3, so that the metrics
differ), with label and price as metadata; `vectors` is the table of writes with JSON
metadata of mixed types.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecledger.functions.distance import (
    DistanceMetric, cosine_normalized, cosine_with_norms, distance_function, dot_product, euclidean, manhattan, metric_name, norm, normalize, normalized_score, sparse_distance, sparse_dot, to_sparse, vector_literal,
)
from vecledger.functions.filters import Condition, MetadataFilter, all_of, any_of, equals, filter_column, in_range, schema_violations
from vecledger.functions.vectors import size_estimate
from vecledger.operators.approximate import InvertedFile, centroids, ivf_knn, quantization_error, with_cell
from vecledger.operators.collection import Engine, grouped, latest, paged, recommended
from vecledger.operators.knn import batch_knn, knn
from vecledger.plans.request import QueryRequest, RecommendParams, ScrollParams, SearchParams, SearchStrategy
from vecledger.sources.tables import table

COS, DOT, L2, L1 = DistanceMetric.COSINE, DistanceMetric.DOT_PRODUCT, DistanceMetric.EUCLIDEAN, DistanceMetric.MANHATTAN
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.lit(1) + F.col("vec_id") % 3))
    return e.select(F.col("vec_id").alias("id"), scaled.alias("values"), "label", (F.col("vec_id") % 100).alias("price"))


def values_of(rows: DataFrame, vec_id: int) -> list[float]:
    return list(rows.where(F.col("id") == vec_id).select("values").first()[0])


def point(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    """The values of one stored point."""
    return values_of(points(spark, sf), vec_id)


def nearest_to(spark: SparkSession, sf: str, vec_id: int, *args, **more) -> DataFrame:
    """knn around a stored point; its table is opened once."""
    rows = points(spark, sf)
    return shown(knn(rows, values_of(rows, vec_id), *args, **more))


P = """p AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 3)) AS v, label, vec_id % 100 AS price FROM embeddings),
    q AS (SELECT v AS qv FROM p WHERE id = 1)"""
D = {
    COS: "list_cosine_similarity(v, qv)",
    DOT: "list_inner_product(v, qv)",
    L2: "list_distance(v, qv)",
    L1: "list_sum(list_transform(list_zip(v, qv), lambda x: abs(x[1] - x[2])))",
}
S = {COS: "(d + 1) / 2", DOT: "greatest(0, least(1, d))", L2: "exp(-d)", L1: "exp(-d * 0.5)"}
WAY = {COS: "DESC", DOT: "DESC", L2: "ASC", L1: "ASC"}


def knn_sql(metric: DistanceMetric, k: int = 10, where: str = "true", after: str = "true", extra: str = "", q: str = "q") -> str:
    return f"""WITH {P}, d AS (SELECT id, label, price, v, {D[metric]} AS d FROM p, {q} WHERE {where}),
        t AS (SELECT *, {S[metric]} AS s FROM d ORDER BY d {WAY[metric]}, id LIMIT {k})
        SELECT id, round(d, 6) AS distance, round(s, 6) AS score{extra} FROM t WHERE {after}"""


def shown(hits: DataFrame, *more) -> DataFrame:
    return hits.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), *more)


for _name, _metric in (("knn_cosine", COS), ("knn_dot", DOT), ("knn_euclidean", L2), ("knn_manhattan", L1)):
    query(_name, knn_sql(_metric))(lambda spark, sf, m=_metric: nearest_to(spark, sf, 1, m))


@query("knn_filtered", knn_sql(COS, 10, "label = 3"))
def _(spark, sf):
    return nearest_to(spark, sf, 1, COS, 10, F.col("label") == 3)


@query("knn_threshold", knn_sql(COS, 50, after="s >= 0.6"))
def _(spark, sf):
    return nearest_to(spark, sf, 1, COS, 50, threshold=0.6)


@query("knn_offset", knn_sql(L2, 10).replace("FROM t WHERE true", "FROM (SELECT *, row_number() OVER (ORDER BY d, id) AS n FROM t) WHERE n > 4"))
def _(spark, sf):
    return shown(paged(knn(points(spark, sf), point(spark, sf, 1), L2, 10), 10, 4, [F.col("distance"), F.col("id")]))


@query("knn_offset_overflow", knn_sql(L2, 10))
def _(spark, sf):
    return shown(paged(knn(points(spark, sf), point(spark, sf, 1), L2, 10), 10, 10, [F.col("distance"), F.col("id")]))


@query("knn_with_vectors", knn_sql(COS, 5, extra=", list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6) + 0.0) AS vector, label"))
def _(spark, sf):
    hits = knn(points(spark, sf), point(spark, sf, 1), COS, 5, keep=("values", "label"))
    return shown(hits, F.transform(normalize(F.col("values")), lambda x: F.round(x, 6) + 0.0).alias("vector"), "label")


@query("knn_scores", f"WITH {P} SELECT id, round({S[COS].replace('d', '(' + D[COS] + ')', 1)}, 6) AS cosine_score, round(greatest(0, least(1, {D[DOT]})), 6) AS dot_score, round(exp(-({D[L2]})), 6) AS euclidean_score, round(exp(-({D[L1]}) * 0.5), 6) AS manhattan_score FROM p, q")
def _(spark, sf):
    q = vector_literal(point(spark, sf, 1))
    score = lambda m: F.round(normalized_score(distance_function(m)(F.col("values"), q), m), 6)
    return points(spark, sf).select("id", score(COS).alias("cosine_score"), score(DOT).alias("dot_score"), score(L2).alias("euclidean_score"), score(L1).alias("manhattan_score"))


@query("knn_zero_vector", "SELECT vec_id AS id, 0.0::DOUBLE AS distance, 0.5::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT 10")
def _(spark, sf):
    return shown(knn(points(spark, sf), [0.0] * len(point(spark, sf, 1)), COS))


@query("normalize_vectors", f"WITH {P} SELECT id, list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)), 6) + 0.0) AS unit FROM p")
def _(spark, sf):
    return points(spark, sf).select("id", F.transform(normalize(F.col("values")), lambda x: F.round(x, 6) + 0.0).alias("unit"))


@query("vector_norms", f"WITH {P} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM p")
def _(spark, sf):
    return points(spark, sf).select("id", F.round(norm(F.col("values")), 6).alias("norm"))


@query("cosine_with_norms", f"WITH {P} SELECT id, round({D[COS]}, 6) AS cosine FROM p, q")
def _(spark, sf):
    q = point(spark, sf, 1)
    stored = points(spark, sf).withColumn("norm", norm(F.col("values")))
    qn = sum(x * x for x in q) ** 0.5
    return stored.select("id", F.round(cosine_with_norms(F.col("values"), vector_literal(q), F.col("norm"), F.lit(qn)), 6).alias("cosine"))


@query("cosine_of_normalized", f"WITH {P} SELECT id, round({D[COS]}, 6) AS cosine FROM p, q")
def _(spark, sf):
    q = point(spark, sf, 1)
    qn = sum(x * x for x in q) ** 0.5
    return points(spark, sf).select("id", F.round(cosine_normalized(normalize(F.col("values")), vector_literal([x / qn for x in q])), 6).alias("cosine"))


@query("batch_distance", f"WITH {P} SELECT id, " + ", ".join(f"round({D[m]}, 6) AS {n}" for m, n in ((COS, "cosine"), (DOT, "dot"), (L2, "euclidean"), (L1, "manhattan"))) + " FROM p, q")
def _(spark, sf):
    q = vector_literal(point(spark, sf, 1))
    v = F.col("values")
    return points(spark, sf).select("id", *[F.round(distance_function(m)(v, q), 6).alias(n) for m, n in ((COS, "cosine"), (DOT, "dot"), (L2, "euclidean"), (L1, "manhattan"))])


@query("length_mismatch", "SELECT vec_id AS id, -1.0::DOUBLE AS cosine, 0.0::DOUBLE AS dot, 'Infinity'::DOUBLE AS euclidean, 'Infinity'::DOUBLE AS manhattan FROM embeddings")
def _(spark, sf):
    short = F.array(F.lit(1.0), F.lit(2.0))
    v = F.col("values")
    return points(spark, sf).select("id", cosine_with_norms(v, short, norm(v), norm(short)).alias("cosine"), dot_product(v, short).alias("dot"), euclidean(v, short).alias("euclidean"), manhattan(v, short).alias("manhattan"))


def _batch(metric: DistanceMetric):
    def run(spark, sf):
        rows = points(spark, sf)
        hits = batch_knn(rows, rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "values"), metric, 10)
        return hits.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))

    sql = f"""WITH {P}, d AS (SELECT a.id AS query_id, p.id AS id, {D[metric].replace("qv", "a.v").replace("(v,", "(p.v,")} AS d FROM p, p AS a WHERE a.id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9) {WAY[metric]}, id) AS rank FROM d)
        SELECT query_id, id, rank, round(d, 6) AS distance, round({S[metric]}, 6) AS score FROM r WHERE rank <= 10"""
    return run, sql


for _name, _metric in (("batch_knn", COS), ("batch_knn_dot", DOT), ("batch_knn_euclidean", L2), ("batch_knn_manhattan", L1)):
    _run, _sql = _batch(_metric)
    query(_name, _sql)(_run)


@query("point_id_search", knn_sql(COS, 10).replace("id = 1)", "id = 7)"))
def _(spark, sf):
    return shown(knn(points(spark, sf), point(spark, sf, 7), COS))


_MEAN = "SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p WHERE id IN ({ids})) GROUP BY i)"


@query("recommend", f"""WITH {P}, a AS ({_MEAN.format(ids="1, 2, 3")}), b AS ({_MEAN.format(ids="10, 11")}),
    r AS (SELECT list_transform(list_zip(a.v, b.v), lambda x: x[1] - 0.5 * x[2]) AS qv FROM a, b),
    d AS (SELECT id, {D[COS]} AS d FROM p, r WHERE id NOT IN (1, 2, 3, 10, 11)),
    t AS (SELECT * FROM d ORDER BY d DESC, id LIMIT 10) SELECT id, round(d, 6) AS distance, round({S[COS]}, 6) AS score FROM t""")
def _(spark, sf):
    rows = points(spark, sf)
    found = {r[0]: list(r[1]) for r in rows.where(F.col("id").isin(1, 2, 3, 10, 11)).select("id", "values").collect()}
    q = recommended([found[i] for i in (1, 2, 3)], [found[i] for i in (10, 11)])
    return shown(knn(rows, q, COS, 10, ~F.col("id").isin(1, 2, 3, 10, 11)))


@query("scroll", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id > 120 AND label <> 3 ORDER BY vec_id LIMIT 25")
def _(spark, sf):
    return points(spark, sf).where("id > 120 and label <> 3").orderBy("id").limit(25).select("id", "label")


@query("sample", "SELECT vec_id AS id FROM embeddings ORDER BY md5('42:' || vec_id::VARCHAR), vec_id LIMIT 20")
def _(spark, sf):
    return points(spark, sf).orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")).cast("binary")), "id").limit(20).select("id")


@query("group_hits", f"""WITH {P}, d AS (SELECT id, label, {D[COS]} AS d FROM p, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, id) AS hit_rank FROM d),
    g AS (SELECT label, row_number() OVER (ORDER BY d DESC, id) AS group_rank FROM r WHERE hit_rank = 1)
    SELECT label AS group_id, group_rank, hit_rank, id, round(d, 6) AS distance FROM r JOIN g USING (label) WHERE hit_rank <= 3 AND group_rank <= 4""")
def _(spark, sf):
    q = vector_literal(point(spark, sf, 1))
    hits = points(spark, sf).select("id", "label", distance_function(COS)(F.col("values"), q).alias("distance"))
    return grouped(hits, F.col("label"), True, 3, 4).select("group_id", "group_rank", "hit_rank", "id", F.round("distance", 6).alias("distance"))


_INFO = """WITH w AS (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY ts_ns DESC) = 1),
    n AS (SELECT collection_name, count(*) AS n FROM w WHERE NOT deleted GROUP BY collection_name)
    SELECT collection_name AS name, dimension,
      CASE WHEN lower(metric) IN ('dotproduct', 'dot_product', 'dot') THEN 'DotProduct' WHEN lower(metric) IN ('euclidean', 'euclid', 'l2') THEN 'Euclidean'
           WHEN lower(metric) IN ('manhattan', 'taxicab', 'cityblock', 'l1') THEN 'Manhattan' ELSE 'Cosine' END AS metric,
      coalesce(n, 0) AS count FROM collections LEFT JOIN n USING (collection_name)"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    last = latest(table(spark, sf, "vectors").withColumnRenamed("vector_id", "id"), ["collection_name"])
    n = last.where("not deleted").groupBy("collection_name").count()
    rows = table(spark, sf, "collections").join(n, "collection_name", "left")
    return rows.select(F.col("collection_name").alias("name"), "dimension", metric_name(F.col("metric")).alias("metric"), F.coalesce("count", F.lit(0)).alias("count"))


query("list_collections", _INFO)(catalog)
query("collection_info", _INFO + " WHERE collection_name = 'audio_clips'")(lambda spark, sf: catalog(spark, sf).where("name = 'audio_clips'"))


@query("live_count", """WITH w AS (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY ts_ns DESC) = 1)
    SELECT count(*) FILTER (WHERE NOT deleted) AS live, count(*) FILTER (WHERE deleted) AS dead FROM w""")
def _(spark, sf):
    last = latest(table(spark, sf, "vectors").withColumnRenamed("vector_id", "id"), [])
    return last.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("dead"))


@query("upsert_latest", """SELECT vector_id, collection_name, ts_ns, deleted, len(vector_values) AS length FROM
    (SELECT DISTINCT vector_id, collection_name, ts_ns, deleted, vector_values FROM vectors QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY ts_ns DESC) = 1)""")
def _(spark, sf):
    row = F.struct("ts_ns", "collection_name", "deleted", F.size("vector_values").alias("length"), F.col("vector_values").isNull().alias("none"))
    last = table(spark, sf, "vectors").groupBy("vector_id").agg(F.max(row).alias("r"))
    return last.select("vector_id", "r.collection_name", "r.ts_ns", "r.deleted", F.when(~F.col("r.none"), F.col("r.length")).cast("bigint").alias("length"))


@query("soft_delete", """WITH w AS (SELECT * FROM vectors QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY ts_ns DESC) = 1)
    SELECT vector_id, collection_name FROM w WHERE NOT deleted""")
def _(spark, sf):
    last = latest(table(spark, sf, "vectors").withColumnRenamed("vector_id", "id"), ["collection_name"])
    return last.where("not deleted").select(F.col("id").alias("vector_id"), "collection_name")


@query("get_vector", "SELECT vec_id AS id, label, len(embedding) AS dimension FROM embeddings WHERE vec_id = 42")
def _(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 42").select(F.col("vec_id").alias("id"), "label", F.size("embedding").cast("bigint").alias("dimension"))


@query("list_vectors", "SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 10 OFFSET 30")
def _(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label").orderBy("id").offset(30).limit(10)


@query("batch_insert_validate", """SELECT vector_id, ts_ns, dimension, len(vector_values) AS length FROM vectors JOIN collections USING (collection_name)
    WHERE NOT deleted AND (vector_values IS NULL OR len(vector_values) <> dimension)""")
def _(spark, sf):
    rows = table(spark, sf, "vectors").join(table(spark, sf, "collections").select("collection_name", "dimension"), "collection_name")
    return rows.where("not deleted and (vector_values is null or size(vector_values) <> dimension)").select("vector_id", "ts_ns", "dimension", F.when(F.col("vector_values").isNotNull(), F.size("vector_values")).cast("bigint").alias("length"))


_TYPES = {"price": "number", "category": "string", "tags": "array", "loc": "geo"}


@query("schema_violations", """WITH t AS (SELECT vector_id, ts_ns, metadata, json_type(metadata, '$.price') AS p, json_type(metadata, '$.category') AS c, json_type(metadata, '$.tags') AS a,
      json_type(metadata, '$.loc') AS l, json_extract(metadata, '$.loc.lat') IS NOT NULL AND json_extract(metadata, '$.loc.lon') IS NOT NULL AS geo FROM vectors),
    v AS (SELECT vector_id, ts_ns, list_filter([CASE WHEN p NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'price' END, CASE WHEN c NOT IN ('VARCHAR', 'NULL') THEN 'category' END,
      CASE WHEN a <> 'ARRAY' THEN 'tags' END, CASE WHEN l IS NOT NULL AND (l <> 'OBJECT' OR NOT geo) THEN 'loc' END], lambda x: x IS NOT NULL) AS fields FROM t)
    SELECT vector_id, ts_ns, fields FROM v WHERE len(fields) > 0""")
def _(spark, sf):
    rows = table(spark, sf, "vectors").withColumn("fields", schema_violations(F.try_parse_json("metadata"), _TYPES))
    return rows.where("size(fields) > 0").select("vector_id", "ts_ns", "fields")


@query("vector_size", """WITH k AS (SELECT vector_id, ts_ns, vector_values, metadata, unnest(CASE WHEN metadata IS NULL OR len(json_keys(metadata)) = 0 THEN [NULL] ELSE json_keys(metadata) END) AS k, row_number() OVER () AS n FROM vectors),
    b AS (SELECT n, vector_id, ts_ns, vector_values, CASE WHEN k IS NULL THEN 0 ELSE strlen(k) + CASE json_type(metadata, '$.' || k) WHEN 'VARCHAR' THEN strlen(json_extract_string(metadata, '$.' || k)) WHEN 'BOOLEAN' THEN 1 ELSE 8 END END AS b FROM k)
    SELECT vector_id, ts_ns, 49 + 4 * coalesce(len(vector_values), 0) + sum(b)::BIGINT AS bytes FROM b GROUP BY n, vector_id, ts_ns, vector_values""".replace("row_number() OVER () AS n FROM vectors", "n FROM (SELECT *, row_number() OVER () AS n FROM vectors)"))
def _(spark, sf):
    values = F.coalesce("vector_values", F.array().cast("array<float>"))
    return table(spark, sf, "vectors").select("vector_id", "ts_ns", size_estimate(values, F.try_parse_json("metadata")).cast("bigint").alias("bytes"))


# Filters over the JSON metadata of `vectors`.
_M = """WITH m AS (SELECT vector_id, ts_ns, metadata, json_type(metadata, '$.price') AS pt, json_extract_string(metadata, '$.price') AS ps,
    CASE WHEN json_type(metadata, '$.price') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(metadata, '$.price')::DOUBLE END AS pn,
    json_extract_string(metadata, '$.category') AS c, json_extract_string(metadata, '$.tags')::JSON AS tags, json_extract_string(metadata, '$.loc.lat')::DOUBLE AS lat FROM vectors)
    SELECT vector_id, ts_ns FROM m WHERE """


def _filter(f: MetadataFilter, on_type_mismatch: str = "equal"):
    return lambda spark, sf: table(spark, sf, "vectors").where(filter_column(F.try_parse_json("metadata"), f, on_type_mismatch)).select("vector_id", "ts_ns")


_HAS = "coalesce(pt, 'NULL') <> 'NULL'"
for _name, _f, _sql in (
    ("filter_eq", all_of(equals("category", "garden")), "c = 'garden'"),
    ("filter_eq_number", all_of(equals("price", 440)), "pn = 440"),
    ("filter_neq", all_of(Condition("price", "neq", "78")), f"{_HAS} AND NOT (pt = 'VARCHAR' AND ps = '78')"),
    ("filter_gt", all_of(Condition("price", "gt", 500)), "pn > 500"),
    ("filter_gte", all_of(Condition("price", "gte", 500)), f"{_HAS} AND (pn >= 500 OR pn IS NULL)"),
    ("filter_lt", all_of(Condition("category", "lt", "kitchen")), "c < 'kitchen'"),
    ("filter_lte", all_of(Condition("category", "lte", "kitchen")), "c <= 'kitchen'"),
    ("filter_range", all_of(in_range("price", 100, 200)), f"{_HAS} AND (pn BETWEEN 100 AND 200 OR pn IS NULL)"),
    ("filter_contains_string", all_of(Condition("category", "contains", "ar")), "contains(c, 'ar')"),
    ("filter_contains_array", all_of(Condition("tags", "contains", "sale")), "list_contains(from_json(tags, '[\"VARCHAR\"]'), 'sale')"),
    ("filter_nested_path", all_of(Condition("loc.lat", "gt", 50.0)), "lat > 50"),
    ("filter_and", all_of(equals("category", "toys"), Condition("price", "lt", 300)), "c = 'toys' AND pn < 300"),
    ("filter_or", any_of(equals("category", "toys"), Condition("tags", "contains", "new")), "coalesce(c = 'toys', false) OR coalesce(list_contains(from_json(tags, '[\"VARCHAR\"]'), 'new'), false)"),
    ("filter_type_mismatch", all_of(Condition("price", "lte", "500")), f"{_HAS} AND (pt <> 'VARCHAR' OR ps <= '500')"),
    ("filter_missing", all_of(Condition("tags", "neq", "x")), "tags IS NOT NULL"),
    ("filter_unknown_operator", all_of(Condition("category", "like", "t")), "false"),
    ("filter_empty", MetadataFilter([]), "true"),
):
    query(_name, _M + _sql)(_filter(_f))
query("filter_strict", _M + "pn >= 500")(_filter(all_of(Condition("price", "gte", 500)), "no_match"))


@query("filter_event_props", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 90")
def _(spark, sf):
    return table(spark, sf, "events").where(filter_column(F.try_parse_json("props"), all_of(Condition("k", "gte", 90)))).select("event_id")


_E = """WITH p AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT v AS qv FROM p WHERE id = '1')"""


def engine(spark: SparkSession, sf: str, metric: str = "cosine") -> Engine:
    """`embeddings` as a registered collection with metadata {"category", "label"}."""
    meta = F.to_json(F.struct(F.concat(F.lit("c"), F.col("label")).alias("category"), "label"))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), meta.alias("metadata"))
    found = Engine(spark)
    found.register("embeddings", rows, 64, metric, unique=True)
    return found


def versions(spark: SparkSession, sf: str, *names: str, schema: dict[str, str] | None = None) -> Engine:
    """Collections of `vectors`, with all their writes, as registered tables."""
    rows = table(spark, sf, "vectors").select("collection_name", F.col("vector_id").alias("id"), F.col("vector_values").alias("values"), "metadata", "ts_ns", "deleted")
    found = Engine(spark)
    for r in table(spark, sf, "collections").select("collection_name", "dimension", "metric").collect():  # the catalog
        if not names or r[0] in names:
            found.register(r[0], rows.where(F.col("collection_name") == r[0]).drop("collection_name"), r[1], r[2], schema)
    return found


_W = """w AS (SELECT * FROM vectors WHERE collection_name = 'audio_clips' QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY ts_ns DESC) = 1)"""


@query("engine_list", _INFO)
def _(spark, sf):
    return versions(spark, sf).listed()


@query("engine_info", _INFO + " WHERE collection_name = 'audio_clips'")
def _(spark, sf):
    info = versions(spark, sf, "audio_clips").info("audio_clips")
    return spark.createDataFrame([tuple(info.values())], "name string, dimension int, metric string, count bigint")


@query("engine_get", f"WITH {_W} SELECT vector_id AS id, metadata, ts_ns, len(vector_values) AS length FROM w WHERE NOT deleted AND vector_id = (SELECT min(vector_id) FROM w WHERE NOT deleted AND vector_values IS NOT NULL)")
def _(spark, sf):
    c = versions(spark, sf, "audio_clips").collection("audio_clips")
    first = c.points().where("values is not null").agg(F.min("id")).first()[0]
    return c.get(first).select("id", "metadata", "ts_ns", F.size("values").cast("bigint").alias("length"))


@query("engine_list_vectors", f"WITH {_W} SELECT vector_id AS id, metadata FROM w WHERE NOT deleted ORDER BY vector_id LIMIT 20 OFFSET 7")
def _(spark, sf):
    return versions(spark, sf, "audio_clips").collection("audio_clips").list_vectors(20, 7)


@query("engine_scroll_cursor", f"WITH {_W} SELECT vector_id AS id, 'after:' || max(vector_id) OVER () AS next FROM (SELECT * FROM w WHERE NOT deleted AND json_extract_string(metadata, '$.category') = 'toys' ORDER BY vector_id LIMIT 5) t")
def _(spark, sf):
    page, cursor = versions(spark, sf, "audio_clips").collection("audio_clips").scroll(QueryRequest(scroll=ScrollParams("", 5), filter=all_of(equals("category", "toys"))))
    return page.select("id", F.lit(cursor).alias("next"))


@query("engine_sample", f"WITH {_W} SELECT vector_id AS id FROM w WHERE NOT deleted ORDER BY md5('7:' || vector_id), vector_id LIMIT 15")
def _(spark, sf):
    return versions(spark, sf, "audio_clips").collection("audio_clips").query(QueryRequest(sample=True, seed=7, limit=15)).select("id")


@query("engine_filter", f"WITH {_W} SELECT vector_id AS id, ts_ns FROM w WHERE NOT deleted AND json_extract_string(metadata, '$.category') = 'garden'")
def _(spark, sf):
    return versions(spark, sf, "audio_clips").collection("audio_clips").points(all_of(equals("category", "garden"))).select("id", "ts_ns")


@query("engine_violations", """SELECT vector_id AS id, ts_ns, CASE WHEN vector_values IS NULL OR len(vector_values) <> 72 THEN 'dimension is not 72' ELSE 'wrong type: price' END AS problem FROM vectors
    WHERE collection_name = 'audio_clips' AND (vector_values IS NULL OR len(vector_values) <> 72 OR json_type(metadata, '$.price') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE'))""")
def _(spark, sf):
    c = versions(spark, sf, "audio_clips", schema={"price": "number"}).collection("audio_clips")
    return c.violations(c.writes()).select("id", "ts_ns", "problem")


@query("engine_delete", f"WITH {_W}, d AS (SELECT vector_id FROM w WHERE NOT deleted ORDER BY vector_id LIMIT 3) SELECT vector_id AS id FROM w WHERE NOT deleted AND vector_id NOT IN (SELECT vector_id FROM d)")
def _(spark, sf):
    c = versions(spark, sf, "audio_clips").collection("audio_clips")
    c.delete([r[0] for r in c.list_vectors(3).collect()])
    return c.points().select("id")


@query("engine_upsert", f"WITH {_W}, l AS (SELECT * FROM w WHERE NOT deleted), f AS (SELECT min(vector_id) AS id FROM l) SELECT vector_id AS id, CASE WHEN vector_id = id THEN 'new' ELSE metadata END AS metadata FROM l, f UNION ALL SELECT 'zzz', 'new'")
def _(spark, sf):
    c = versions(spark, sf, "audio_clips").collection("audio_clips")
    ids = [r[0] for r in c.list_vectors(1).collect()] + ["zzz"]
    c.insert(spark.createDataFrame([(i, [0.5] * 72, "new") for i in ids], "id string, values array<float>, metadata string"))
    return c.points().select("id", "metadata")


@query("engine_batch", _E + """, d AS (SELECT list_cosine_similarity(v, qv) AS d, id, label FROM p, q), e AS (SELECT list_cosine_similarity(p.v, b.v) AS d, p.id FROM p, (SELECT v FROM p WHERE id = '2') b)
    SELECT 0 AS request, id, round(d, 5) AS distance FROM (SELECT * FROM d ORDER BY d DESC, id LIMIT 4) a UNION ALL SELECT 1, id, round(d, 5) FROM (SELECT * FROM e ORDER BY d DESC, id LIMIT 7) b
    UNION ALL SELECT 2, id, round(d, 5) FROM (SELECT * FROM d WHERE label = 3 ORDER BY d DESC, id LIMIT 6) c""")
def _(spark, sf):
    c = engine(spark, sf).collection("embeddings")
    a, b = (list(c.get(i).first()["values"]) for i in "12")
    batch = c.query_batch([QueryRequest(vector=a, limit=4), QueryRequest(vector=b, limit=7), QueryRequest(vector=a, limit=6, filter=all_of(equals("label", 3)))])
    return batch.select("request", "id", F.round("distance", 5).alias("distance"))


@query("engine_payload", "SELECT vec_id::VARCHAR AS id, '{\"label\":' || label || '}' AS metadata FROM embeddings ORDER BY 1 LIMIT 6")
def _(spark, sf):
    return engine(spark, sf).query("embeddings", {"scroll": {"limit": 6}, "with_payload": {"exclude": ["category"]}}).select("id", "metadata")


@query("engine_query", _E + """, d AS (SELECT id, list_cosine_similarity(v, qv) AS d FROM p, q WHERE label IN (2, 3))
    SELECT id, round(d, 5) AS distance, round((d + 1) / 2, 5) AS score FROM (SELECT * FROM d ORDER BY d DESC, id LIMIT 8)""")
def _(spark, sf):
    e = engine(spark, sf)
    v = e.collection("embeddings").get("1").first()["values"]
    raw = {"Vector": list(v), "Limit": 8, "filter": {"conditions": [{"field": "category", "operator": "eq", "value": "c2"}, {"field": "label", "operator": "eq", "value": 3}], "operator": 1}}
    return e.query("embeddings", raw).select("id", F.round("distance", 5).alias("distance"), F.round("score", 5).alias("score"))


@query("engine_groups", _E + """, d AS (SELECT id, label, list_cosine_similarity(v, qv) AS d FROM p, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, id) AS hit_rank FROM d),
    g AS (SELECT label, row_number() OVER (ORDER BY d DESC, id) AS group_rank FROM r WHERE hit_rank = 1)
    SELECT 'c' || label AS group_id, group_rank, hit_rank, id FROM r JOIN g USING (label) WHERE hit_rank <= 2 AND group_rank <= 5""")
def _(spark, sf):
    e = engine(spark, sf)
    r = QueryRequest(point_id="1", group_by="category", group_size=2, group_limit=5)
    return e.collection("embeddings").query_groups(r).select("group_id", "group_rank", "hit_rank", "id")


@query("engine_scroll", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id::VARCHAR > '2' ORDER BY 1 LIMIT 12")
def _(spark, sf):
    return engine(spark, sf).query("embeddings", QueryRequest(scroll=ScrollParams("after:2", 12))).select("id")


@query("engine_recommend", _E + """, r AS (SELECT list_transform(list_zip(list_transform(list_zip(a.v, b.v), lambda x: (x[1] + x[2]) / 2), c.v), lambda x: x[1] - 0.5 * x[2]) AS qv
      FROM p a, p b, p c WHERE a.id = '1' AND b.id = '2' AND c.id = '3'),
    d AS (SELECT id, list_inner_product(v, r.qv) AS d FROM p, r WHERE id NOT IN ('1', '2', '3'))
    SELECT id, round(d, 5) AS distance FROM (SELECT * FROM d ORDER BY d DESC, id LIMIT 5) t""")
def _(spark, sf):
    return engine(spark, sf, "dot").query("embeddings", QueryRequest(recommend=RecommendParams(["1", "2"], ["3"]), limit=5)).select("id", F.round("distance", 5).alias("distance"))


@query("engine_recommend_best", _E + """, d AS (SELECT p.id, greatest(list_inner_product(p.v, a.v), list_inner_product(p.v, b.v)) AS d, list_inner_product(p.v, c.v) AS bad FROM p, p a, p b, p c
      WHERE a.id = '1' AND b.id = '2' AND c.id = '3' AND p.id NOT IN ('1', '2', '3'))
    SELECT id, round(d, 5) AS distance FROM (SELECT * FROM d WHERE d > bad ORDER BY d DESC, id LIMIT 5) t""")
def _(spark, sf):
    return engine(spark, sf, "dot").query("embeddings", QueryRequest(recommend=RecommendParams(["1", "2"], ["3"], "best"), limit=5)).select("id", F.round("distance", 5).alias("distance"))


@query("sparse_dot", """WITH s AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0 END) AS v FROM embeddings),
    q AS (SELECT v AS qv FROM s WHERE id = 1) SELECT id, round(list_inner_product(v, qv), 6) + 0.0 AS dot FROM s, q""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    kept = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.abs(s.x) > 0.1)
    rows = e.select(F.col("vec_id").alias("id"), to_sparse(F.transform(kept, lambda s: s.i), F.transform(kept, lambda s: s.x)).alias("m"))
    q = rows.where("id = 1").first()["m"]
    literal = F.map_from_arrays(F.array(*[F.lit(k) for k in q]), F.array(*[F.lit(v) for v in q.values()]))
    return rows.select("id", (F.round(sparse_dot(F.col("m"), literal), 6) + 0.0).alias("dot"))


@query("sparse_distances", """WITH s AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0 END) AS v FROM embeddings),
    q AS (SELECT v AS qv FROM s WHERE id = 1) SELECT id, round(list_cosine_similarity(v, qv), 6) + 0.0 AS cosine, round(list_distance(v, qv), 6) AS euclidean,
      round(list_sum(list_transform(list_zip(v, qv), lambda x: abs(x[1] - x[2]))), 6) AS manhattan FROM s, q""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    kept = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.abs(s.x) > 0.1)
    rows = e.select(F.col("vec_id").alias("id"), to_sparse(F.transform(kept, lambda s: s.i), F.transform(kept, lambda s: s.x)).alias("m"))
    q = rows.where("id = 1").first()["m"]
    literal = F.map_from_arrays(F.array(*[F.lit(k) for k in q]), F.array(*[F.lit(v) for v in q.values()]))
    of = lambda m: F.round(sparse_distance(F.col("m"), literal, m), 6) + 0.0
    return rows.select("id", of(COS).alias("cosine"), of(L2).alias("euclidean"), of(L1).alias("manhattan"))


@query("quantization_error", """WITH p AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings),
    c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p) GROUP BY label, i) GROUP BY label)
    SELECT label AS code, count(*) AS points, round(avg(list_distance(v, c)), 6) AS error FROM p JOIN c USING (label) GROUP BY label""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("code"), F.col("embedding").cast("array<double>").alias("values"))
    parts = rows.select("code", F.posexplode("values").alias("i", "x")).groupBy("code", "i").agg(F.avg("x").alias("m"))
    codebook = parts.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centre"))
    return quantization_error(rows, codebook).select("code", "points", F.round("error", 6).alias("error"))


@query("ivf_knn")
def _(spark, sf):
    rows = points(spark, sf)
    cs = centroids(rows, 16)
    return shown(ivf_knn(with_cell(rows, cs), cs, point(spark, sf, 1), L2, 10, SearchStrategy.PRECISE))


@query("ivf_recall", "SELECT * FROM (VALUES ('DEFAULT', true), ('PRECISE', true), ('EXACT', true)) AS t(strategy, enough)")
def _(spark, sf):
    """Whether the index finds 0.9 of the ten nearest of the points whose id is divisible by 100, by strategy."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))
    index = InvertedFile.built(rows, 16)
    asked = rows.where("id % 100 = 0")
    true = batch_knn(rows, asked.withColumnRenamed("id", "query_id"), COS, 10).select("query_id", "id")
    vectors = [(r[0], list(r[1])) for r in asked.select("id", "values").collect()]  # one in a hundred
    parts = []
    for s in (SearchStrategy.DEFAULT, SearchStrategy.PRECISE, SearchStrategy.EXACT):
        params = SearchParams(search_strategy=s).adjusted()
        hits = reduce(DataFrame.unionByName, [index.search(v, COS, 10, params).select(F.lit(i).cast("bigint").alias("query_id"), "id") for i, v in vectors])
        share = true.join(hits.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
        parts.append(share.select(F.lit(s.name).alias("strategy"), (F.col("recall") >= 0.9).alias("enough")))
    return reduce(DataFrame.unionByName, parts)
