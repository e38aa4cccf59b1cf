"""Approximate search by an inverted file, vector quantization error, and a token ring."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecledger.functions.distance import DistanceMetric, distance_function, euclidean, vector_literal
from vecledger.operators.knn import knn
from vecledger.plans.request import SearchParams, SearchStrategy

RANGES = 4096


def probes(cells: int, ef: int) -> int:
    """How many of `cells` a search of effort ef probes: a share of ef / (ef + 50), so that
    recall does not fall as cells grow; the efforts 40, 100 and 300 probe 44, 67 and 86 %."""
    return max(1, min(cells, -(-cells * ef // (ef + 50))))


def centroids(points: DataFrame, cells: int, sample_rows: int = 20_000, rounds: int = 8) -> list[list[float]]:
    """k-means centroids of a sample of at most sample_rows rows, the smallest by hash."""
    rows = points.where("values is not null").select("id", "values").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    x = np.array([r[1] for r in rows], np.float64)
    if not len(x):
        return []
    c = x[: min(cells, len(x))].copy()
    for _ in range(rounds):
        at = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
        for k in range(len(c)):
            if (at == k).any():
                c[k] = x[at == k].mean(0)
    return c.tolist()


def with_cell(points: DataFrame, cs: list[list[float]]) -> DataFrame:
    """points with `cell`, the nearest centroid, and `error`, the distance to it."""
    table = F.array(*[vector_literal(c) for c in cs])
    near = F.array_min(F.transform(table, lambda c, i: F.struct(euclidean(F.col("values"), c).alias("error"), i.alias("cell"))))
    return points.withColumn("__near", near).withColumn("cell", F.col("__near.cell")).withColumn("error", F.col("__near.error")).drop("__near")


def probed(cs: list[list[float]], query: list[float], metric: DistanceMetric, n: int) -> list[int]:
    """The n cells closest to the query, by the metric's idea of close."""
    c, q = np.array(cs), np.array(query)
    if metric == DistanceMetric.DOT_PRODUCT:
        d = -(c @ q)
    elif metric == DistanceMetric.COSINE:
        d = -(c @ q) / np.maximum(np.linalg.norm(c, axis=1), 1e-12)
    elif metric == DistanceMetric.MANHATTAN:
        d = np.abs(c - q).sum(1)
    else:
        d = np.linalg.norm(c - q, axis=1)
    return np.argsort(d, kind="stable")[:n].tolist()


def ivf_knn(indexed: DataFrame, cs: list[list[float]], query: list[float], metric: DistanceMetric, k: int, strategy: SearchStrategy = SearchStrategy.DEFAULT, ef: int = 0) -> DataFrame:
    """k nearest points in the probed cells; `cell` is a partition column when stored so."""
    return InvertedFile(indexed, cs).search(query, metric, k, SearchParams(hnsw_ef=ef, search_strategy=strategy).adjusted())


class VectorIndex(Protocol):
    """What a collection can search with: hits (id, distance, score, keep...), best first."""

    def search(self, query: list[float], metric: DistanceMetric, k: int, params: SearchParams, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame: ...


class InvertedFile:
    """Points with `cell` and the cells' centroids."""

    def __init__(self, indexed: DataFrame, cs: list[list[float]]):
        self.indexed, self.centroids = indexed, cs

    @staticmethod
    def built(points: DataFrame, cells: int, path: str | None = None) -> InvertedFile:
        """From points (id, values, ...); stored below `path`, partitioned by cell, if given."""
        cs = centroids(points, cells)
        if not cs:
            return InvertedFile(points.withColumn("cell", F.lit(0)), [])
        if path is None:
            return InvertedFile(with_cell(points, cs), cs)
        save_index(with_cell(points, cs), cs, path)
        return InvertedFile(*load_index(points.sparkSession, path))

    def search(self, query: list[float], metric: DistanceMetric, k: int, params: SearchParams, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Exact over all cells if params say so, else over the cells its effort probes; a
        batch without an effort is searched as by default."""
        rows = self.indexed
        if self.centroids and not params.exact:
            at = probed(self.centroids, query, metric, probes(len(self.centroids), params.hnsw_ef or 100))
            rows = rows.where(F.col("cell").isin(at))
        return knn(rows, query, metric, k, where, None, keep)


def save_index(indexed: DataFrame, cs: list[list[float]], path: str) -> None:
    """Write a table with `cell` partitioned by it, and the centroids beside it."""
    indexed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/points")
    indexed.sparkSession.createDataFrame(list(enumerate(cs)), "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[float]]]:
    """What save_index wrote; probing cells prunes partitions."""
    cs = [list(r[0]) for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").select("centre").collect()]
    return spark.read.parquet(f"{path}/points"), cs


def fitness(latency: Column, recall: Column, memory: Column, maintenance: Column, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> Column:
    """Fitness of an index from its query log: w1 / latency + w2 recall - w3 memory - w4 maintenance."""
    w1, w2, w3, w4 = weights
    return F.lit(w1) / F.nullif(latency, F.lit(0.0)) + w2 * recall - w3 * memory - w4 * maintenance


def quantization_error(points: DataFrame, codebook: DataFrame, metric: DistanceMetric = DistanceMetric.EUCLIDEAN) -> DataFrame:
    """(code, points, error): mean distance of points (code, values) to codebook rows (code, centre)."""
    d = distance_function(metric)(F.col("values"), F.col("centre"))
    return points.join(codebook, "code").groupBy("code").agg(F.count("*").alias("points"), F.avg(d).alias("error"))


def ring_tokens(nodes: DataFrame, virtual: int = 256) -> DataFrame:
    """(token, node): `virtual` tokens of every node on a ring of 2^32."""
    v = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("v"))
    return v.select(ring_hash(F.concat_ws("#", "node", "v")).alias("token"), "node")


def ring_hash(key):
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def ring_replicas(keys: DataFrame, tokens: DataFrame, replicas: int = 3) -> DataFrame:
    """(key, nodes): the owner of each key and the next other nodes along the ring, `replicas`
    in all or as many as there are.

    The walk from each token is worked out once, over the tokens: they are nodes times virtual
    nodes, a list that every member of a ring holds.
    """
    ring = [(r[0], r[1]) for r in tokens.groupBy("token").agg(F.min("node").alias("node")).orderBy("token").collect()]
    walks = []
    for i, (token, _) in enumerate(ring):
        nodes: list[str] = []
        for step in range(len(ring)):
            node = ring[(i + step) % len(ring)][1]
            if node not in nodes:
                nodes.append(node)
                if len(nodes) == replicas:
                    break
        walks.append((token, nodes))
    spark = keys.sparkSession
    walk = spark.createDataFrame(walks, "token bigint, nodes array<string>")
    owned = ring_owner(keys, tokens.select("token", F.col("token").cast("string").alias("node")))
    return owned.join(F.broadcast(walk), owned["node"].cast("bigint") == walk["token"]).select("key", "nodes")  # one row a token


def ring_owner(keys: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, node): the node of the first token at or after the key's hash, wrapping.

    Keys and tokens are merged in windows over ranges of the ring, so no task sees it all;
    each range also gets the first token beyond it.
    """
    ring = tokens.groupBy("token").agg(F.min("node").alias("node"))
    part = lambda c: F.floor(c / ((1 << 32) // RANGES)).cast("int")
    last = F.lit(RANGES)
    firsts = ring.withColumn("part", part(F.col("token"))).groupBy("part").agg(F.min(F.struct("token", "node")).alias("t"))
    ranges = keys.sparkSession.range(RANGES).select(F.col("id").cast("int").alias("part"))
    upto = Window.orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    places = ranges.join(firsts, "part", "left").select(F.col("part").alias("place"), "t").unionByName(firsts.orderBy("part").limit(1).select(last.alias("place"), "t"))
    beyond = places.select("place", F.last("t", ignorenulls=True).over(upto).alias("next")).where(F.col("place") < last)  # RANGES rows
    rows = keys.select("key", ring_hash(F.col("key")).alias("at"), F.lit(None).cast("string").alias("node"), F.lit(1).alias("kind"))
    marks = ring.select(F.lit(None).cast("string").alias("key"), F.col("token").alias("at"), "node", F.lit(0).alias("kind"))
    merged = rows.unionByName(marks).withColumn("part", part(F.col("at")))
    w = Window.partitionBy("part").orderBy(F.col("at").desc(), F.col("kind").asc()).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("own", F.last(F.when(F.col("kind") == 0, F.col("node")), ignorenulls=True).over(w)).where("kind = 1")
    return found.join(F.broadcast(beyond), found["part"] == beyond["place"]).select("key", F.coalesce("own", F.col("next.node")).alias("node"))
