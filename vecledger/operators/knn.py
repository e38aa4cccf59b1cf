"""Exact nearest neighbours of one query or of a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecledger.functions.distance import DistanceMetric, distance_function, distance_to, is_higher_better, normalized_score

QUERIES_AT_ONCE = 4096


def distances(points: DataFrame, query: list[float] | Column, metric: DistanceMetric, where: Column | None = None, keep: tuple[str, ...] = (), id_col: str = "id", values_col: str = "values") -> DataFrame:
    """(id, distance, keep...) of all points with values, unordered; `where` reaches the scan."""
    rows = points if where is None else points.where(where)
    v = F.col(values_col)
    d = distance_to(v, query, metric) if isinstance(query, list) else distance_function(metric)(v, query)
    return rows.where(v.isNotNull()).select(F.col(id_col).alias("id"), d.alias("distance"), *keep)


def knn(points: DataFrame, query: list[float] | Column, metric: DistanceMetric, k: int = 10, where: Column | None = None, threshold: float | None = None, keep: tuple[str, ...] = (), id_col: str = "id", values_col: str = "values") -> DataFrame:
    """The k points nearest to `query`, best first: id, distance, score and `keep`.

    `where` is applied before any distance, so it reaches the scan. The threshold acts
    when positive; scores are monotone in the distance, so cutting the sorted prefix is
    the same as filtering before, and the distance is computed once. k <= 0 means 10.
    Equal distances are ordered by id. Points with null values are not found.
    """
    rows = distances(points, query, metric, where, keep, id_col, values_col)
    order = F.col("distance").desc() if is_higher_better(metric) else F.col("distance").asc()
    top = rows.orderBy(order, "id").limit(k if k > 0 else 10)
    top = top.withColumn("score", normalized_score(F.col("distance"), metric))
    if threshold is not None and threshold > 0:
        top = top.where(F.col("score") >= threshold)
    return top


def block_distances(q: np.ndarray, x: np.ndarray, metric: DistanceMetric) -> np.ndarray:
    """Distances of all rows of q to all rows of x, in float64."""
    if metric == DistanceMetric.MANHATTAN:
        return np.stack([np.abs(x - row).sum(1) for row in q])
    if metric == DistanceMetric.EUCLIDEAN:
        square = (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T
        return np.sqrt(np.maximum(square, 0))
    dots = q @ x.T
    if metric == DistanceMetric.DOT_PRODUCT:
        return dots
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def batch_knn(points: DataFrame, queries: DataFrame, metric: DistanceMetric, k: int = 10) -> DataFrame:
    """The k nearest points of every query: query_id, id, distance, score, rank.

    points (id, values), queries (query_id, values). Queries are sent to the points in
    blocks of QUERIES_AT_ONCE, and each task keeps the k best of its points for every
    query by matrix products, so k rows a task and query are shuffled at most. Rows whose
    length differs from that of the queries, and null values, are not found.
    """
    spark = points.sparkSession
    rows = queries.where("values is not null and query_id is not null").select("query_id", "values").toLocalIterator()
    higher = is_higher_better(metric)
    id_kind, q_kind = points.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    blocks: list[tuple[list, np.ndarray]] = []
    ids, values = [], []
    for r in rows:
        ids.append(r[0])
        values.append(r[1])
        if len(ids) == QUERIES_AT_ONCE:
            blocks.append((ids, np.array(values, np.float64)))
            ids, values = [], []
    if ids or not blocks:
        blocks.append((ids, np.array(values, np.float64) if ids else np.zeros((0, 0))))
    out = None
    for ids, q in blocks:
        shared = spark.sparkContext.broadcast((pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType)), q))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            best = None
            for batch in batches:
                keep = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), q.shape[1]), False)
                batch = batch.filter(keep)
                if not batch.num_rows or not len(q):
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                d = block_distances(q, x, metric)
                n = min(k, d.shape[1])
                # all that tie with the n-th stay, the final rank decides by id
                edge = np.partition(-d if higher else d, n - 1, axis=1)[:, n - 1 : n]
                row, col = np.nonzero((-d if higher else d) <= edge)
                part = pa.table({"query_id": names.take(pa.array(row)), "id": batch.column(0).take(pa.array(col)), "distance": d[row, col]})
                best = part if best is None else pa.concat_tables([best, part])
                if best.num_rows > 4 * k * len(q):
                    best = _k_best(best, k, higher)
            if best is not None:
                yield from _k_best(best, k, higher).combine_chunks().to_batches(max_chunksize=10_000)

        part = points.select("id", "values").mapInArrow(near, f"query_id {q_kind}, id {id_kind}, distance double")
        out = part if out is None else out.unionByName(part)
    order = F.col("distance").desc() if higher else F.col("distance").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", normalized_score(F.col("distance"), metric))


def _k_best(rows: pa.Table, k: int, higher: bool) -> pa.Table:
    rows = rows.sort_by([("query_id", "ascending"), ("distance", "descending" if higher else "ascending"), ("id", "ascending")])
    q = rows.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return rows.filter(pa.array(rank < k))
