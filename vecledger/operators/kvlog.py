"""State of a key/value store as a fold of its ordered operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecledger.operators.changefeed import APPEND, PUT, folded_state

OPS = ("Get", "Put", "Append")
BLOCK = 1 << 16


def once(log: DataFrame) -> DataFrame:
    """Operations of a log (log_index, op, key, value, client_id, seq_id) that take effect.

    A write whose seq_id is not above all earlier writes of its client is skipped; reads
    always take effect. Skipped writes never raise the running maximum, so it is that of
    all earlier writes. Writes without client or sequence number always take effect.
    """
    write = F.coalesce(F.col("op") != "Get", F.lit(False))
    named = write & F.col("client_id").isNotNull() & F.col("seq_id").isNotNull()
    writes = log.where(named).withColumn("__block", F.floor(F.col("log_index") / BLOCK).cast("bigint"))
    # a client's log is cut into blocks, so the window never holds a whole client
    tops = writes.groupBy("client_id", "__block").agg(F.max("seq_id").alias("__top"))
    before = Window.partitionBy("client_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("client_id", "__block", F.max("__top").over(before).alias("__earlier"))
    inside = Window.partitionBy("client_id", "__block").orderBy("log_index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.max("seq_id").over(inside), F.col("__earlier"))
    marked = writes.join(tops, ["client_id", "__block"]).withColumn("__last", last)
    fresh = marked.where(F.col("__last").isNull() | (F.col("seq_id") > F.col("__last"))).select(*log.columns)
    return fresh.unionByName(log.where(~named))


def state(log: DataFrame) -> DataFrame:
    """(key, value) after the log: Put replaces, Append extends, a missing key starts at ''."""
    return _folded(log, None)


def _folded(log: DataFrame, base: DataFrame | None) -> DataFrame:
    first, last = log.agg(F.min("log_index"), F.max("log_index")).first()
    writes = once(log).where(F.col("op").isin("Put", "Append") & F.col("key").isNotNull())
    op = F.when(F.col("op") == "Put", PUT).otherwise(APPEND)
    return folded_state(writes.select("key", "log_index", op.alias("op"), "value"), ["key"], "log_index", first or 0, last or 0, base)


def get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """(key, value, found) of requested keys; '' for a missing key."""
    return keys.select("key").distinct().join(state, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"), F.col("value").isNotNull().alias("found"))


def majority_index(match: DataFrame, group: list[str], index: str) -> DataFrame:
    """Per group the index that a majority has reached: the lower median. Nulls do not count."""
    median = F.expr(f"percentile_disc(0.5) within group (order by `{index}`)")
    return match.groupBy(*group).agg(median.cast(match.schema[index].dataType).alias("majority_index"))


def applied_table(log: DataFrame) -> DataFrame:
    """(client_id, seq_id): the last write of each client that took effect."""
    named = log.where("op <> 'Get' and client_id is not null and seq_id is not null")
    return named.groupBy("client_id").agg(F.max("seq_id").alias("seq_id"))


def snapshot(state: DataFrame, applied: DataFrame, path: str) -> None:
    """Write the state (key, value) and the deduplication table (client_id, seq_id)."""
    state.write.mode("overwrite").parquet(f"{path}/state")
    applied.write.mode("overwrite").parquet(f"{path}/applied")


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The state and the deduplication table of a snapshot."""
    return spark.read.parquet(f"{path}/state"), spark.read.parquet(f"{path}/applied")


def resumed(state_before: DataFrame, applied: DataFrame, log: DataFrame) -> DataFrame:
    """State (key, value) after the part of a log that follows a snapshot."""
    last = applied.select("client_id", F.col("seq_id").alias("__seq"))
    rest = log.join(last, "client_id", "left").where("op = 'Get' or __seq is null or seq_id is null or seq_id > __seq").select(*log.columns)
    return _folded(rest, state_before)


def moments(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mean, variance, deviation) of a column, of the population; merged from
    partial moments of the tasks. Nulls do not count, NaN makes all but n NaN."""
    v = F.col(value)
    return df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("deviation"))
