"""Latest usable version of every vector of a versioned table (upserts and tombstones)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 1.17e-38  # a value that vectors hardly hold


def usable(values: Column, dimension: Column) -> Column:
    """Whether a vector has its collection's dimension, no null or NaN and a nonzero element."""
    # NaN is the greatest value; array_contains is null where it finds nothing but a null
    low, high = F.array_min(values), F.array_max(values)
    seen = F.array_contains(values, F.lit(RARE).cast("float"))
    whole = F.when(seen.isNull(), False).when(seen, ~F.exists(values, lambda x: x.isNull())).otherwise(True)
    sound = values.isNotNull() & (F.size(values) == dimension) & ~F.isnan(high) & ((low != 0) | (high != 0)) & whole
    return F.coalesce(sound, F.lit(False))


def latest_versions(writes: DataFrame) -> DataFrame:
    """The row of each vector_id with the greatest ts_ns, with the columns
    collection_name, vector_id, vector_values, deleted.

    Repeated rows count once; if rows with the same greatest ts_ns differ, one wins by its
    content (see version), whatever the order of rows. A null ts_ns is below all others.
    Rows without vector_id are dropped. Versions are combined before the shuffle.
    """
    row = F.struct(*version(), "vector_values")
    last = writes.where("vector_id is not null").groupBy("vector_id").agg(F.max(row).alias("r"))
    return last.select("r.collection_name", "vector_id", "r.vector_values", "r.deleted")


def version() -> list[Column]:
    """What orders the versions of a vector_id: its ts_ns, then its content."""
    return [F.col("ts_ns"), F.col("collection_name"), F.col("deleted"), F.xxhash64("vector_values").alias("content")]


def live_keys(writes: DataFrame, collections: DataFrame) -> DataFrame:
    """(vector_id, collection_name, ts_ns, content) of live vectors, content being the hash of
    their values; no vector is shuffled."""
    dims = collections.groupBy("collection_name").agg(F.max("dimension").alias("dimension"))
    known = writes.where("vector_id is not null").join(dims, "collection_name", "left")
    row = F.struct(*version(), usable(F.col("vector_values"), F.col("dimension")).alias("usable"))
    last = known.groupBy("vector_id").agg(F.max(row).alias("r")).where("r.usable and r.deleted = false")
    return last.select("vector_id", "r.collection_name", "r.ts_ns", "r.content")


def live_vectors(writes: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection_name, vector_id, vector_values) of live vectors: the latest version is
    not deleted and usable. Vectors of unknown collections are not live."""
    dims = collections.groupBy("collection_name").agg(F.max("dimension").alias("dimension"))
    rows = latest_versions(writes).where(F.col("deleted") == F.lit(False)).join(dims, "collection_name")
    return rows.where(usable(F.col("vector_values"), F.col("dimension"))).select("collection_name", "vector_id", "vector_values")
