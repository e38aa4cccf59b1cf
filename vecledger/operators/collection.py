"""Collections of vectors: catalog, versioned writes, live rows and all query types.

A collection's table has one row per write: id, values, metadata (JSON), ts_ns, deleted, and
other vector columns it was declared with. Writes are appended as Parquet; the state is the
latest row of each id, so inserting an id again replaces it and revives a deleted one, and a
delete is a tombstone. Which row is the latest is decided on narrow rows; vectors and metadata
are not shuffled for it unless asked for. compact() leaves one row an id, of which queries are
plain scans; declared metadata fields are then columns whose filters reach the scan.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecledger.functions.distance import DistanceMetric, NAMES, distance_function, is_higher_better, normalize, normalized_score, parse_metric, vector_literal
from vecledger.functions.filters import AND, MetadataFilter, field_at, filter_column, schema_violations
from vecledger.operators.approximate import InvertedFile, VectorIndex
from vecledger.operators.knn import batch_knn, distances, knn
from vecledger.plans.request import QueryRequest, SearchStrategy
from vecledger.sources.tables import removed, shared_folder

SCHEMA = "id string, values array<float>, metadata string, ts_ns bigint, deleted boolean"


class NotFound(LookupError):
    """There is no such collection or point."""


class Conflict(ValueError):
    """The collection exists already."""


def _order(writes: DataFrame) -> list[Column]:
    """What orders the writes of an id: ts_ns, then deletes, then the content, whatever the order of rows."""
    content = F.xxhash64(*[c for c in writes.columns if c not in ("id", "ts_ns", "deleted")])
    return [F.col("ts_ns"), F.coalesce("deleted", F.lit(False)).alias("deleted"), content.alias("content")]


def latest(writes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(id, ts_ns, deleted, columns) of the newest write of each id, deleted ones included;
    writes without id are dropped. Only `columns`, all by default, are shuffled."""
    columns = [c for c in writes.columns if c not in ("id", "ts_ns", "deleted")] if columns is None else columns
    row = F.struct(*_order(writes), *columns)
    last = writes.where("id is not null").groupBy("id").agg(F.max(row).alias("w"))
    return last.select("id", "w.ts_ns", "w.deleted", *[f"w.{c}" for c in columns])


def live(writes: DataFrame, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """latest without deleted rows. With a condition, the newest writes are found on narrow
    rows that say whether they meet it, and only those that do come with their columns."""
    if where is None:
        return latest(writes, columns).where(~F.col("deleted"))
    marked = writes.withColumn("__met", F.coalesce(where, F.lit(False)))
    keys = marked.where("id is not null").groupBy("id").agg(F.max(F.struct(*_order(writes), "__met")).alias("w"))
    keys = keys.where("w.__met and not w.deleted").select("id", F.coalesce("w.ts_ns", F.lit(-1)).alias("__ts"), F.col("w.content").alias("__content"))
    content = _order(writes)[2]
    rows = marked.where("__met").withColumn("__ts", F.coalesce("ts_ns", F.lit(-1))).withColumn("__content", content)
    rows = rows.join(keys, ["id", "__ts", "__content"], "left_semi").dropDuplicates(["id"])
    columns = [c for c in writes.columns if c not in ("id", "ts_ns", "deleted")] if columns is None else columns
    return rows.select("id", "ts_ns", F.lit(False).alias("deleted"), *columns)


def paged(rows: DataFrame, limit: int, offset: int, order: list[Column]) -> DataFrame:
    """The first `limit` rows without the first `offset` of them; an offset of that many
    rows or more is ignored. The window runs over at most `limit` rows."""
    top = rows.orderBy(*order).limit(limit)
    if offset <= 0:
        return top
    numbered = top.withColumn("__n", F.row_number().over(Window.orderBy(*order))).withColumn("__all", F.count("*").over(Window.partitionBy()))
    return numbered.where((F.col("__n") > offset) | (F.lit(offset) >= F.col("__all"))).drop("__n", "__all")


def grouped(hits: DataFrame, group: Column, higher: bool, size: int, limit: int) -> DataFrame:
    """Hits (id, distance, score) by group: at most `size` a group, the `limit` groups with
    the best hits; columns group_id, group_rank, hit_rank. A null group is left out."""
    best = F.col("distance").desc() if higher else F.col("distance").asc()
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(best, "id"))
    rows = hits.withColumn("group_id", group).where("group_id is not null").withColumn("hit_rank", rank).where(F.col("hit_rank") <= size)
    firsts = rows.where("hit_rank = 1").orderBy(best, "id", "group_id").limit(limit)
    firsts = firsts.select("group_id", F.row_number().over(Window.orderBy(best, "id", "group_id")).alias("group_rank"))
    return rows.join(F.broadcast(firsts), "group_id")  # at most `limit` rows


class Collection:
    """vector_columns: other named vectors, {name: dimension}, each a column of its name."""

    def __init__(self, name: str, dimension: int, metric: DistanceMetric, writes: DataFrame, path: str | None = None, schema: dict[str, str] | None = None, vector_columns: dict[str, int] | None = None, unique: bool = False, created_ns: int | None = None):
        if dimension <= 0 or any(d <= 0 for d in (vector_columns or {}).values()):
            raise ValueError("dimension must be positive")
        self.name, self.dimension, self.metric, self.path = name, dimension, metric, path
        self.schema = schema or {}
        self.vector_columns = vector_columns or {}
        self.indexes: dict[str, VectorIndex | None] = {"exact": None}
        self.created_ns = created_ns or time.time_ns()
        self.updated_ns = self.created_ns
        self.unique = unique
        self.on_change: Callable[[], None] | None = None
        self._writes = writes
        self._spark = writes.sparkSession

    def add_index(self, name: str, dimension: int, index: VectorIndex | None = None) -> None:
        """Search with `index`, or exactly if None; requests that ask for exactness ignore it.
        Later writes drop it, as it would not know them."""
        if dimension != self.dimension:
            raise ValueError(f"index dimension {dimension} differs from {self.dimension}")
        self.indexes[name] = index

    def build_index(self, name: str, cells: int, path: str | None = None) -> None:
        """An inverted file over the live points."""
        self.add_index(name, self.dimension, InvertedFile.built(self.points(), cells, path))

    def about(self) -> dict:
        return {
            "name": self.name, "dimension": self.dimension, "metric": NAMES[self.metric], "schema": json.dumps(self.schema), "vectors": json.dumps(self.vector_columns),
            "created_ns": self.created_ns, "unique": self.unique, "rows": self.path,
        }

    def writes(self) -> DataFrame:
        if self.path is None:
            return self._writes
        extra = "".join(f", `{c}` array<float>" for c in self.vector_columns) + "".join(f", `{declared(f)}` {DECLARED[t]}" for f, t in self.schema.items() if t in DECLARED)
        return self._spark.read.schema(SCHEMA + extra).parquet(self.path)

    def _live(self, columns: list[str], where: MetadataFilter | None = None, more: Column | None = None) -> DataFrame:
        """(id, ts_ns, columns) of the live rows that meet a filter."""
        rows = self.writes()
        met = filter_column(F.try_parse_json("metadata"), where) if where is not None and where.conditions else None
        if more is not None:
            met = more if met is None else met & more
        if self.unique:
            for c in self._pushed(where):
                rows = rows.where(c)
            rows = rows.where("id is not null and not coalesce(deleted, false)")
            return (rows if met is None else rows.where(met)).select("id", "ts_ns", *columns)
        return live(rows, columns, met).select("id", "ts_ns", *columns)

    def _pushed(self, where: MetadataFilter | None) -> list[Column]:
        """Conditions on declared columns that the filter implies; they reach the scan."""
        if self.path is None or where is None or where.operator != AND:
            return []
        made = {"eq": "__eq__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
        kinds = {"number": (int, float), "string": str, "bool": bool}
        found = []
        for c in where.conditions:
            kind = self.schema.get(c.field)
            fits = kind in DECLARED and isinstance(c.value, kinds[kind]) and (kind == "bool") == isinstance(c.value, bool)
            if fits and c.operator in made and (kind != "bool" or c.operator == "eq"):
                value = float(c.value) if kind == "number" else c.value
                found.append(getattr(F.col(f"`{declared(c.field)}`"), made[c.operator])(F.lit(value)))
        return found

    def points(self, where: MetadataFilter | None = None, using: str = "", more: Column | None = None) -> DataFrame:
        """Live points (id, values, metadata); cosine collections give normalized values.

        using: the named vector that takes the place of values.
        """
        if using and using not in self.vector_columns:
            raise ValueError(f"no vector {using!r}")
        column = f"`{using}`" if using else "values"
        rows = self._live([using or "values", "metadata"], where, more).withColumn("values", F.col(column))
        if self.metric == DistanceMetric.COSINE:
            rows = rows.withColumn("values", normalize(F.col("values")).cast("array<float>"))
        return rows.select("id", "values", "metadata", "ts_ns")

    def violations(self, rows: DataFrame) -> DataFrame:
        """Rows that may not be inserted, with `problem`."""
        wrong = schema_violations(F.try_parse_json("metadata"), self.schema)
        problem = (
            F.when(F.col("id").isNull(), "id is missing")
            .when(F.col("values").isNull() | (F.size("values") != self.dimension), f"dimension is not {self.dimension}")
            .when(F.size(wrong) > 0, F.concat(F.lit("wrong type: "), F.array_join(wrong, ", ")))
        )
        for name, dimension in self.vector_columns.items():
            if name in rows.columns:
                problem = problem.when(F.col(f"`{name}`").isNotNull() & (F.size(f"`{name}`") != dimension), f"dimension of {name} is not {dimension}")
        return rows.withColumn("problem", problem).where("problem is not null")

    def insert(self, rows: DataFrame) -> None:
        """Append rows (id, values[, metadata, named vectors]); all are validated before any is written."""
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.lit(None).cast("string"))
        for name in self.vector_columns:
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("array<float>"))
        bad = self.violations(rows).select("id", "problem").first()
        if bad is not None:
            raise ValueError(f"row {bad[0]!r}: {bad[1]}")
        self._append(rows, deleted=False)

    def delete(self, ids: list[str]) -> None:
        """Tombstones; NotFound for an id that was never written, deleting twice is fine."""
        known = {r[0] for r in self.writes().where(F.col("id").isin(ids)).select("id").distinct().collect()}
        missing = [i for i in ids if i not in known]
        if missing:
            raise NotFound(f"no vector {missing[0]!r}")
        gone = self._spark.createDataFrame([(i,) for i in ids], "id string")
        empty = [F.lit(None).cast("array<float>").alias(c) for c in ("values", *self.vector_columns)]
        self._append(gone.select("id", *empty, F.lit(None).cast("string").alias("metadata")), deleted=True)

    def _append(self, rows: DataFrame, deleted: bool) -> None:
        vectors = [F.col(f"`{c}`").cast("array<float>").alias(c) for c in self.vector_columns]
        if self.unique:  # known before the first row of another write is
            self.unique = False
            if self.on_change is not None:
                self.on_change()
        rows = rows.select("id", F.col("values").cast("array<float>"), "metadata", F.lit(time.time_ns()).alias("ts_ns"), F.lit(deleted).alias("deleted"), *vectors)
        if self.path is None:
            self._writes = self._writes.unionByName(rows)
        else:
            self._columned(rows).write.mode("append").parquet(self.path)
        self.indexes = {name: None for name in self.indexes}
        self.updated_ns = time.time_ns()

    def _columned(self, rows: DataFrame) -> DataFrame:
        v = F.try_parse_json("metadata")
        for name, kind in self.schema.items():
            if kind in DECLARED:
                rows = rows.withColumn(declared(name), F.try_variant_get(field_at(v, name), "$", DECLARED[kind]))
        return rows

    def compact(self, path: str | None = None) -> None:
        """Rewrite the live rows, one an id, so that queries are plain scans until the next write."""
        base = ["values", "metadata", *self.vector_columns]
        rows = live(self.writes(), base).select("id", "values", "metadata", "ts_ns", "deleted", *[f"`{c}`" for c in self.vector_columns])
        path = path or (f"{self.path.rsplit('/', 1)[0]}/rows-{time.time_ns()}" if self.path else f"{shared_folder(self._spark)}/compact-{time.time_ns()}")
        self._columned(rows).write.parquet(path)
        self.path, self.unique = path, True

    def count(self) -> int:
        return self._counted().first()[0]

    def _counted(self) -> DataFrame:
        return self._live([]).agg(F.count("*").alias("count"))

    def get(self, point_id: str) -> DataFrame:
        return live(self.writes().where(F.col("id") == point_id)).select("id", "values", "metadata", "ts_ns")

    def list_vectors(self, limit: int = 10, offset: int = 0) -> DataFrame:
        if limit <= 0 or offset < 0:
            raise ValueError("limit must be positive and offset not negative")
        return self._live(["metadata"]).select("id", "metadata").orderBy("id").offset(offset).limit(limit)

    def scroll(self, request: QueryRequest) -> tuple[DataFrame, str | None]:
        """A page and the cursor of the next one, None after the last."""
        r = request.normalized()
        limit = r.scroll.limit if r.scroll.limit > 0 else 10
        ids = [x[0] for x in self.query(r).select("id").orderBy("id").collect()]
        return self.query(r), f"after:{ids[-1]}" if len(ids) == limit else None

    def query(self, request: QueryRequest) -> DataFrame:
        r = request.normalized()
        if r.scroll is not None:
            after = r.scroll.offset.removeprefix("after:")
            more = F.col("id") > after if after not in ("", "0") else None
            rows = self.points(r.filter, r.using, more)
            return self._shown(rows.orderBy("id").limit(r.scroll.limit if r.scroll.limit > 0 else 10), r)
        if r.sample:
            draw = F.md5(F.concat(F.lit(f"{r.seed}:"), F.col("id")))
            return self._shown(self.points(r.filter, r.using).orderBy(draw, "id").limit(r.limit), r)
        query, more, best = r.vector, None, None
        if r.recommend is not None:
            positive, negative = self._examples(r.recommend.positive, r.using), self._examples(r.recommend.negative, r.using)
            more = ~F.col("id").isin([*r.recommend.positive, *r.recommend.negative])
            if r.recommend.strategy in ("best", "best_score"):
                best = lambda v: best_of(v, positive, negative, self.metric)
            elif r.recommend.strategy not in ("", "average", "average_vector"):
                raise ValueError(f"unknown strategy {r.recommend.strategy!r}")
            query = recommended(positive, negative)
        elif query is None:
            query = self._examples([r.point_id], r.using)[0]
        dimension = self.vector_columns.get(r.using, self.dimension)
        if len(query) != dimension:
            raise ValueError(f"query has {len(query)} elements, the collection {dimension}")
        keep = tuple(c for c, on in (("values", r.with_vectors), ("metadata", bool(r.payload_fields()) or bool(r.group_by))) if on)
        higher = is_higher_better(self.metric)
        order = F.col("distance").desc() if higher else F.col("distance").asc()
        points = self.points(r.filter, r.using, more)
        index = next((i for i in self.indexes.values() if i is not None), None)
        if r.group_by:
            hits = distances(points, query, self.metric, None, keep) if best is None else distances(points, F.lit(None), lambda v, _: best(v), None, keep)
            hits = hits.withColumn("score", normalized_score(F.col("distance"), self.metric))
            if r.params.score_threshold > 0:
                hits = hits.where(F.col("score") >= r.params.score_threshold)
            group = F.try_variant_get(field_at(F.try_parse_json("metadata"), r.group_by), "$", "string")
            return grouped(hits, group, higher, r.group_size, r.group_limit).select("group_id", "group_rank", "hit_rank", "id", "distance", "score")
        if best is not None:
            hits = distances(points, F.lit(None), lambda v, _: best(v), None, keep).orderBy(order, "id").limit(r.limit)
            hits = hits.withColumn("score", normalized_score(F.col("distance"), self.metric))
        elif index is not None and not r.params.exact and not r.using:
            met = filter_column(F.try_parse_json("metadata"), r.filter)
            hits = index.search(query, self.metric, r.limit, r.params, met if more is None else met & more, keep)
        else:
            hits = knn(points, query, self.metric, r.limit, None, None, keep)
        if r.params.score_threshold > 0:
            hits = hits.where(F.col("score") >= r.params.score_threshold)
        return self._shown(paged(hits, r.limit, r.offset, [order, F.col("id")]), r)

    def query_batch(self, requests: list[QueryRequest]) -> DataFrame:
        """One plan for all requests: (request, id, distance, score), request being the place
        in the list. All are validated before any is planned.

        Requests for a plain vector search share one pass over the points; the others are
        parts of a union. Rows of scrolls and samples have no distance.
        """
        asked = [r.normalized() for r in requests]
        plain = [i for i, r in enumerate(asked) if r.vector is not None and r.filter is None and not r.group_by and not r.offset and not r.using and (r.params.exact or r.params.search_strategy == SearchStrategy.BATCH or all(x is None for x in self.indexes.values()))]
        parts = []
        if plain:
            for i in plain:
                if len(asked[i].vector) != self.dimension:
                    raise ValueError(f"request {i} has {len(asked[i].vector)} elements, the collection {self.dimension}")
            queries = self._spark.createDataFrame([(i, [float(x) for x in asked[i].vector]) for i in plain], "query_id int, values array<double>")
            limits = self._spark.createDataFrame([(i, asked[i].limit, float(max(0.0, asked[i].params.score_threshold))) for i in plain], "request int, most int, least double")
            hits = batch_knn(self.points(), queries, self.metric, max(asked[i].limit for i in plain)).withColumnRenamed("query_id", "request")
            parts.append(hits.join(F.broadcast(limits), "request").where("rank <= most and (least = 0 or score >= least)").select("request", "id", "distance", "score"))
        for i in sorted(set(range(len(asked))) - set(plain)):
            rows = self.query(asked[i])
            d = [F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in ("distance", "score")]
            parts.append(rows.select(F.lit(i).alias("request"), "id", *d))
        if not parts:
            return self._spark.createDataFrame([], "request int, id string, distance double, score double")
        return reduce(DataFrame.unionByName, parts)

    def query_groups(self, request: QueryRequest) -> DataFrame:
        if not request.group_by:
            raise ValueError("group_by is missing")
        return self.query(request)

    def _examples(self, ids: list, using: str) -> list[list[float]]:
        if not ids:
            return []
        points = self.points(None, using, F.col("id").isin(ids)).where("values is not null")
        found = {x[0]: list(x[1]) for x in points.select("id", "values").collect()}
        for i in ids:
            if i not in found:
                raise NotFound(f"no point {i!r}")
        return [found[i] for i in ids]

    def _shown(self, rows: DataFrame, r: QueryRequest) -> DataFrame:
        if not r.with_vectors and "values" in rows.columns:
            rows = rows.drop("values")
        fields = r.payload_fields()
        if "metadata" in rows.columns:
            if fields is False:
                rows = rows.drop("metadata")
            elif isinstance(fields, list) or r.payload_excluded():
                rows = rows.withColumn("metadata", payload("metadata", fields if isinstance(fields, list) else None, r.payload_excluded()))
        return rows.drop("deleted", "ts_ns")


#: Types of declared fields that become columns.
DECLARED = {"number": "double", "string": "string", "bool": "boolean"}


def declared(name: str) -> str:
    """Column of a declared metadata field."""
    return "m_" + quote(name, safe="")


def payload(column: str, include: list[str] | None, exclude: list[str]) -> Column:
    """JSON metadata of the included fields, all if None, without the excluded ones.

    Fields are dotted paths; an included path keeps its nesting, a missing one is left out.
    The fields are a request's few, so the JSON is cut by a function of Arrow batches.
    """
    def cut(text: str | None) -> str | None:
        try:
            whole = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(whole, dict):
            return None
        kept: dict = whole if include is None else {}
        for path in include or []:
            steps, value = path.split("."), whole
            for step in steps:
                value = value.get(step, cut) if isinstance(value, dict) else cut
            if value is not cut:
                at = kept
                for step in steps[:-1]:
                    at = at.setdefault(step, {})
                at[steps[-1]] = value
        for path in exclude:
            *steps, last = path.split(".")
            at = kept
            for step in steps:
                at = at.get(step) if isinstance(at, dict) else None
            if isinstance(at, dict):
                at.pop(last, None)
        return json.dumps(kept, ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return cuts(F.col(column))


def best_of(values: Column, positive: list[list[float]], negative: list[list[float]], metric: DistanceMetric) -> Column:
    """Distance by the best example: that to the closest positive one; where a negative one is
    at least as close, the worst distance that the metric has, so such points come last."""
    near, lowest = (F.greatest, float("-inf")) if is_higher_better(metric) else (F.least, float("inf"))
    d = distance_function(metric)
    of = lambda rows: reduce(near, [d(values, vector_literal(v)) for v in rows], F.lit(lowest))
    good, bad = of(positive), of(negative)
    closer = good > bad if is_higher_better(metric) else good < bad
    return F.when(closer, good).otherwise(F.lit(lowest))


def recommended(positive: list[list[float]], negative: list[list[float]], beta: float = 1.0, gamma: float = 0.5) -> list[float]:
    """Rocchio feedback: beta * mean of positives - gamma * mean of negatives."""
    if not positive:
        raise ValueError("recommend needs a positive example")
    mean = lambda rows: [sum(c) / len(rows) for c in zip(*rows, strict=True)]
    p = mean(positive)
    n = mean(negative) if negative else [0.0] * len(p)
    return [beta * a - gamma * b for a, b in zip(p, n, strict=True)]


class Engine:
    """A catalog of collections; those made with a folder outlive the engine, see opened."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self.collections: dict[str, Collection] = {}

    @staticmethod
    def opened(spark: SparkSession, folder: str) -> Engine:
        """The engine of a folder with its collections."""
        e = Engine(spark, folder)
        try:
            rows = spark.read.schema(CATALOG).json(f"{e.folder}/*/about").collect()
        except AnalysisException:  # nothing there yet
            return e
        for r in rows:
            empty = spark.createDataFrame([], SCHEMA)
            e._kept(Collection(r["name"], r["dimension"], parse_metric(r["metric"]), empty, r["rows"], json.loads(r["schema"]), json.loads(r["vectors"]), r["unique"], r["created_ns"]))
        return e

    def _home(self, name: str) -> str:
        return f"{self.folder or shared_folder(self.spark)}/{quote(name, safe='')}"

    def create(self, name: str, dimension: int, metric: str | None = "cosine", schema: dict[str, str] | None = None, vectors: dict[str, int] | None = None) -> Collection:
        """A new collection. schema: metadata fields with their types; vectors: other named
        vectors with their dimensions, which requests choose by `using`."""
        if not name:
            raise ValueError("name is required")
        if name in self.collections:
            raise Conflict(f"collection {name!r} exists")
        path = f"{self._home(name)}/rows-{time.time_ns()}"
        empty = self.spark.createDataFrame([], SCHEMA)
        found = Collection(name, dimension, parse_metric(metric), empty, path, schema, vectors)
        found._columned(found._spark.createDataFrame([], SCHEMA + "".join(f", `{c}` array<float>" for c in found.vector_columns))).write.parquet(path)
        self._kept(found)
        self.save(name)
        return found

    def _kept(self, c: Collection) -> None:
        self.collections[c.name] = c
        c.on_change = lambda: self.save(c.name)

    def save(self, name: str) -> None:
        """Write the catalog entry of a collection that has files."""
        c = self.collection(name)
        if c.path is not None:
            about = self.spark.createDataFrame([tuple(c.about().values())], CATALOG)
            about.coalesce(1).write.mode("overwrite").json(f"{self._home(name)}/about")

    def compact(self, name: str) -> None:
        self.collection(name).compact()
        self.save(name)

    def register(self, name: str, writes: DataFrame, dimension: int, metric: str = "cosine", schema: dict[str, str] | None = None, vectors: dict[str, int] | None = None, unique: bool = False) -> Collection:
        """An existing table of writes as a collection; missing columns get defaults.
        unique: the table has one row an id, so it is only scanned."""
        for column, kind, default in (("metadata", "string", None), ("ts_ns", "bigint", 0), ("deleted", "boolean", False)):
            if column not in writes.columns:
                writes = writes.withColumn(column, F.lit(default).cast(kind))
        self.collections[name] = Collection(name, dimension, parse_metric(metric), writes, None, schema, vectors, unique)
        return self.collections[name]

    def collection(self, name: str) -> Collection:
        if name not in self.collections:
            raise NotFound(f"no collection {name!r}")
        return self.collections[name]

    def drop(self, name: str) -> None:
        """Forget a collection and delete its files; a registered table stays."""
        if self.collection(name).path is not None:
            removed(self.spark, self._home(name))
        del self.collections[name]

    def listed(self) -> DataFrame:
        """(name, dimension, metric, count) of all collections, in one plan."""
        parts = []
        for name in sorted(self.collections):
            c = self.collections[name]
            parts.append(c._counted().select(F.lit(name).alias("name"), F.lit(c.dimension).alias("dimension"), F.lit(NAMES[c.metric]).alias("metric"), "count"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "name string, dimension int, metric string, count bigint")

    def info(self, name: str) -> dict:
        c = self.collection(name)
        return {"name": c.name, "dimension": c.dimension, "metric": NAMES[c.metric], "count": c.count()}

    def list(self) -> list[dict]:
        return [r.asDict() for r in self.listed().orderBy("name").collect()]

    def query(self, name: str, raw: dict | QueryRequest) -> DataFrame:
        return self.collection(name).query(raw if isinstance(raw, QueryRequest) else QueryRequest.of(raw))

    def respond(self, name: str, raw: dict) -> str:
        """The result of a JSON request in its envelope, as many rows as the request's limit;
        a scroll's has the rows as points and the next cursor."""
        request = QueryRequest.of(raw)
        if request.scroll is not None:
            page, cursor = self.collection(name).scroll(request)
            result = {"points": [r.asDict(recursive=True) for r in page.orderBy("id").collect()], "next": cursor}
        else:
            result = [r.asDict(recursive=True) for r in self.query(name, raw).collect()]
        return json.dumps({"result": result, "status": "ok"}, default=str)


CATALOG = "name string, dimension int, metric string, schema string, vectors string, created_ns bigint, unique boolean, rows string"
