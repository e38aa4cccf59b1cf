"""Rebuilding a keyed table from its change feed, newest changes first.

Ordered changes of a key form a monoid: (has_reset, live, text), where a put or delete
resets what came before it and an append extends it. Changes are folded per key and
segment of `SEGMENT` consecutive log positions, so no group ever holds more than SEGMENT
rows even if one key has a third of the feed; only the short segment images go on.
Batches of segments are then resolved newest first: keys already resolved by a newer put
or delete are anti-joined away, and base rows that no change touched are added last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecledger.sources.tables import written

GET, PUT, APPEND, DELETE = 0, 1, 2, 3
SEGMENT = 1024
COMMAND = "Key string, Value string, OpType string, ClientId bigint, SeqId bigint"


def op_code(name: Column) -> Column:
    """Operation code of a code or of a name in any letter case; null if unknown."""
    n = F.lower(F.trim(name))
    return (
        F.when(n.isin("get", "0"), GET).when(n.isin("put", "1"), PUT)
        .when(n.isin("append", "2"), APPEND).when(n.isin("delete", "3"), DELETE)
    )


def log_entries(feed: DataFrame) -> DataFrame:
    """The entry in force at each (gid, command_index): that of the greatest log_term.

    Repeated and late deliveries of an entry count once. If deliveries of one term
    differ, which a correct log excludes, the greatest content wins, so the result does
    not depend on row order. Rows without gid or command_index are no entries; a null
    log_term is below all others; a null command_valid is false.
    """
    c = F.from_json("command", COMMAND)
    parsed = feed.where("gid is not null and command_index is not null").select(
        "gid", "command_index", F.struct(
            "log_term", F.coalesce("command_valid", F.lit(False)).alias("valid"), op_code(c.OpType).alias("op"),
            c.Key.alias("key"), F.coalesce(c.Value, F.lit("")).alias("value"), c.ClientId.alias("client"), c.SeqId.alias("seq"),
        ).alias("e"),
    )
    return parsed.groupBy("gid", "command_index").agg(F.max("e").alias("e")).select("gid", "command_index", "e.*")


def effective_writes(entries: DataFrame) -> DataFrame:
    """Writes that take effect: of each (gid, client, seq) the one earliest in the log.

    A write without client or seq cannot be a retry and always takes effect; a write
    without key or with an unknown operation never does.
    """
    w = entries.where(F.col("valid") & F.col("op").isin(PUT, APPEND, DELETE) & F.col("key").isNotNull())
    named = F.col("client").isNotNull() & F.col("seq").isNotNull()
    first = (
        w.where(named).groupBy("gid", "client", "seq")
        .agg(F.min(F.struct("command_index", "op", "key", "value")).alias("w")).select("gid", "w.*")
    )
    return first.unionByName(w.where(~named).select("gid", "command_index", "op", "key", "value"))


def _image(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, has_reset, live, text) of the fold of rows (keys, pos, has_reset, live, text) in order of pos.

    What comes before the last reset is left out before anything is sorted."""
    row = F.struct("pos", "live", "text")
    grouped = rows.groupBy(*keys).agg(F.collect_list(row).alias("parts"), F.max(F.when(F.col("has_reset"), F.col("pos"))).alias("reset"))
    kept = grouped.withColumn("parts", F.array_sort(F.filter("parts", lambda p: F.col("reset").isNull() | (p.pos >= F.col("reset")))))
    return kept.select(
        *keys, F.col("reset").isNotNull().alias("has_reset"), F.exists("parts", lambda p: p.live).alias("live"), F.array_join(F.transform("parts", lambda p: p.text), "").alias("text"))


def segment_images(writes: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, segment, has_reset, live, text) of ordered writes (op, value)."""
    rows = writes.select(
        *keys, F.floor(F.col(position) / SEGMENT).cast("bigint").alias("segment"), F.col(position).alias("pos"), F.col("op").isin(PUT, DELETE).alias("has_reset"),
        (F.col("op") != DELETE).alias("live"), F.when(F.col("op") != DELETE, F.col("value")).otherwise("").alias("text"))
    return _image(rows, [*keys, "segment"])


def _wider(images: DataFrame, keys: list[str]) -> DataFrame:
    """Images of SEGMENT segments each."""
    rows = images.withColumnRenamed("segment", "pos").withColumn("segment", F.floor(F.col("pos") / SEGMENT).cast("bigint"))
    return _image(rows, [*keys, "segment"])


def folded_state(writes: DataFrame, keys: list[str], position: str, first: int, last: int, base: DataFrame | None = None) -> DataFrame:
    """current_state in one pass without intermediate tables, for positions from `first` to `last`.

    Segments are folded into wider ones until a key has SEGMENT of them at most."""
    images = segment_images(writes.withColumn("value", F.coalesce("value", F.lit(""))), keys, position)
    first, last = first // SEGMENT, last // SEGMENT
    while last - first >= SEGMENT:
        images = _wider(images, keys)
        first, last = first // SEGMENT, last // SEGMENT
    if base is not None:
        old = base.select(*keys, F.lit(first - 1).cast("bigint").alias("segment"), F.lit(False).alias("has_reset"), F.lit(True).alias("live"), F.coalesce("value", F.lit("")).alias("text"))
        images = images.unionByName(old)
    final = _image(images.withColumnRenamed("segment", "pos"), keys)
    return final.where("live").select(*keys, F.col("text").alias("value"))


def current_state(writes: DataFrame, keys: list[str], position: str, base: DataFrame | None = None, batches: int = 4) -> DataFrame:
    """Current (keys, value) after ordered writes with columns keys, `position`, op, value.

    base: the table (keys, value) before the first write; its rows must be unique by key.
    Positions are unique within a key and may begin anywhere. Keys that end deleted, or that
    only had deletes, are absent; an append to a missing key starts from ''. Null values count as ''.
    """
    images = written(segment_images(writes.withColumn("value", F.coalesce("value", F.lit(""))), keys, position))
    first, last = images.agg(F.min("segment"), F.max("segment")).first()
    first, last = first or 0, last or 0
    while last - first >= batches * SEGMENT:  # so a batch has at most SEGMENT segments of a key
        images = written(_wider(images, keys))
        first, last = first // SEGMENT, last // SEGMENT
    per_batch = -(-(last - first + 1) // batches)
    resolved, out = None, []
    for b in reversed(range(batches)):
        start = first + b * per_batch
        part = images.where((F.col("segment") >= start) & (F.col("segment") < start + per_batch))
        if resolved is not None:
            part = part.join(resolved, keys, "left_anti")
        part = _image(part.withColumnRenamed("segment", "pos"), keys)
        part = written(part.withColumn("batch", F.lit(b).cast("bigint")))
        out.append(part)
        done = part.where("has_reset").select(*keys)
        resolved = done if resolved is None else resolved.unionByName(done)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    if base is not None:
        kept = base.select(*keys, F.coalesce("value", F.lit("")).alias("text")).join(resolved, keys, "left_anti")
        whole = whole.unionByName(kept.select(*keys, F.lit(False).alias("has_reset"), F.lit(True).alias("live"), "text", F.lit(-1).cast("bigint").alias("batch")))
    final = _image(whole.withColumnRenamed("batch", "pos"), keys)
    return final.where("live").select(*keys, F.col("text").alias("value"))


def apply_feed(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(gid, kv_key, value) that the feed leaves, see log_entries, effective_writes and current_state."""
    writes = effective_writes(log_entries(feed))
    base = base.select("gid", F.col("kv_key").alias("key"), "value") if base is not None else None
    return current_state(writes, ["gid", "key"], "command_index", base).select("gid", F.col("key").alias("kv_key"), "value")
