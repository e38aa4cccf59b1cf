"""Commands on vectors as an ordered log: put, batch put, delete, create and delete of collections.

A stream's batches are appended to a table as they come; what lives after the log is the
latest command of each vector, so a batch that is written again after a failure changes
nothing. Searches and gets are reads and leave no trace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COMMANDS = "log_index bigint, command string, collection string, id string, values array<float>, metadata string, points array<struct<id: string, values: array<float>, metadata: string>>"
#: The names of commands that change something.
WRITES = ("VectorPut", "VectorBatchPut", "VectorDelete", "CollectionCreate", "CollectionDelete")


def writes_of(commands: DataFrame) -> DataFrame:
    """(log_index, place, command, collection, id, values, metadata): batches one row a point, in their order."""
    rows = commands.where(F.col("command").isin(*WRITES) & F.col("log_index").isNotNull() & F.col("collection").isNotNull())
    one = F.array(F.struct("id", "values", "metadata"))
    points = F.when(F.col("command") == "VectorBatchPut", F.coalesce("points", F.array().cast("array<struct<id: string, values: array<float>, metadata: string>>"))).otherwise(one)
    rows = rows.select("log_index", "command", "collection", F.posexplode(points).alias("place", "p"))
    return rows.select("log_index", "place", "command", "collection", "p.id", "p.values", "p.metadata")


def live_points(writes: DataFrame) -> DataFrame:
    """(collection, id, values, metadata, log_index) that live after the log.

    The latest put or delete of an id counts if the collection was neither created nor
    deleted after it; a collection whose last such command is a delete has no points. Puts
    to a collection that was never created are kept, as it may be older than the log.
    """
    whole = F.col("command").startswith("Collection")
    ends = writes.where(whole).groupBy("collection").agg(F.max(F.struct("log_index", "command")).alias("c"))
    ends = ends.select("collection", F.col("c.log_index").alias("__from"), (F.col("c.command") == "CollectionDelete").alias("__gone"))
    row = F.struct("log_index", "place", (F.col("command") != "VectorDelete").alias("put"), F.col("values"), F.col("metadata"))
    last = writes.where(~whole & F.col("id").isNotNull()).groupBy("collection", "id").agg(F.max(row).alias("w"))
    rows = last.where("w.put").join(ends, "collection", "left").where("__from is null or (not __gone and w.log_index > __from)")
    return rows.select("collection", "id", "w.values", "w.metadata", "w.log_index")


def kept_in(commands: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start the stream that appends commands to the table at `path`; live_points reads it."""

    def append(batch: DataFrame, number: int) -> None:
        writes_of(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return commands.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

