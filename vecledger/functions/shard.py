"""Shards of keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 10


def key_to_shard(key: Column) -> Column:
    """First byte of the key modulo SHARDS; 0 for an empty key, null for a null one."""
    first = F.conv(F.substring(F.hex(key.cast("binary")), 1, 2), 16, 10).cast("int")
    return F.when(key.isNotNull(), F.coalesce(first, F.lit(0)) % SHARDS)
