"""Shard assignment: configurations, their changes, and migration of shard data.

A configuration is (num, shards ARRAY<INT>, groups MAP<INT, ARRAY<STRING>>). Planning a
new one touches SHARDS numbers and is plain Python on the driver; everything on keys and
rows is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecledger.functions.shard import SHARDS, key_to_shard

CONFIG = "num int, shards array<int>, groups map<int, array<string>>"
NORMAL, MOVE_IN, MOVE_OUT, GC = "Normal", "MoveIn", "MoveOut", "GC"


@dataclass(frozen=True)
class Config:
    num: int = 0
    shards: tuple[int, ...] = (0,) * SHARDS
    groups: dict[int, list[str]] = field(default_factory=dict)

    def holders(self) -> dict[int, list[int]]:
        held: dict[int, list[int]] = {g: [] for g in sorted(self.groups)}
        for shard, gid in enumerate(self.shards):
            if gid:
                held.setdefault(gid, []).append(shard)
        return held


def _spread(shards: list[int], held: dict[int, list[int]], free: list[int]) -> tuple[int, ...]:
    """Free shards go to the smallest holder, then the largest gives to the smallest until
    they differ by one at most; the lower gid wins ties, and lists are used in order."""
    for shard in free:
        gid = min(held, key=lambda g: (len(held[g]), g))
        held[gid].append(shard)
        shards[shard] = gid
    while held:
        low = min(held, key=lambda g: (len(held[g]), g))
        high = min(held, key=lambda g: (-len(held[g]), g))
        if len(held[high]) - len(held[low]) <= 1:
            break
        shard = held[high].pop(0)
        held[low].append(shard)
        shards[shard] = low
    return tuple(shards)


class Controller:
    """The history of configurations, with requests applied once a client and number."""

    def __init__(self) -> None:
        self.history = [Config()]
        self.applied: dict[int, int] = {}

    @property
    def latest(self) -> Config:
        return self.history[-1]

    def query(self, num: int = -1) -> Config:
        return self.history[num] if 0 <= num < len(self.history) else self.latest

    def join(self, groups: dict[int, list[str]]) -> Config:
        """Add groups; known ones are left as they are, an empty map changes nothing but num."""
        old = self.latest
        new = Config(old.num + 1, old.shards, {**groups, **old.groups})
        if new.groups:
            free = [s for s, g in enumerate(old.shards) if g == 0]
            new = Config(new.num, _spread(list(old.shards), new.holders(), free), new.groups)
        self.history.append(new)
        return new

    def leave(self, gids: Iterable[int]) -> Config:
        """Remove groups; their shards go one by one to the smallest holder."""
        old, gone = self.latest, set(gids)
        groups = {g: s for g, s in old.groups.items() if g not in gone}
        shards, free = list(old.shards), [s for s, g in enumerate(old.shards) if g in gone]
        for s in free:
            shards[s] = 0
        held = Config(0, tuple(shards), groups).holders()
        if groups:
            for shard in free:
                gid = min(held, key=lambda g: (len(held[g]), g))
                held[gid].append(shard)
                shards[shard] = gid
        else:
            shards = [0] * SHARDS
        self.history.append(Config(old.num + 1, tuple(shards), groups))
        return self.latest

    def move(self, shard: int, gid: int) -> Config:
        """Assign one shard, whatever the balance."""
        old = self.latest
        shards = list(old.shards)
        shards[shard] = gid
        self.history.append(Config(old.num + 1, tuple(shards), old.groups))
        return self.latest

    def apply(self, client_id: int, seq_id: int, op: str, *args) -> Config:
        """A request of a client; a repeated or older change is skipped, query is exempt."""
        if op == "query":
            return self.query(*args)
        if seq_id > self.applied.get(client_id, -1):
            self.applied[client_id] = seq_id
            return {"join": self.join, "leave": self.leave, "move": self.move}[op](*args)
        return self.latest

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.num, list(c.shards), c.groups) for c in self.history], CONFIG)


def config_at(configs: DataFrame, num: int) -> DataFrame:
    """The configuration `num`; the latest for a negative or unknown one."""
    asked = F.when(F.col("num") == num, 1).otherwise(0)
    return configs.orderBy(asked.desc(), F.col("num").desc()).limit(1)


def owners(keys: DataFrame, config: DataFrame) -> DataFrame:
    """(key, shard, gid, servers) of keys under one configuration row."""
    one = config.select("shards", "groups").limit(1)  # a single row
    rows = keys.select("key", key_to_shard(F.col("key")).alias("shard")).join(F.broadcast(one))
    gid = F.get("shards", F.col("shard"))
    return rows.select("key", "shard", gid.alias("gid"), F.try_element_at("groups", gid).alias("servers"))


def shard_counts(configs: DataFrame) -> DataFrame:
    """(num, gid, shards) of every joined group, also of those without a shard, and of
    group 0 where it holds any."""
    held = configs.select("num", F.explode("shards").alias("gid"))
    none = configs.select("num", F.explode(F.map_keys("groups")).alias("gid"))
    both = held.select("num", "gid", F.lit(1).alias("n")).unionByName(none.select("num", "gid", F.lit(0).alias("n")))
    return both.groupBy("num", "gid").agg(F.sum("n").alias("shards"))


def balance(configs: DataFrame) -> DataFrame:
    """(num, max_gid, max_shards, min_gid, min_shards, balanced): group 0 is the largest while
    it holds any and never the smallest; ties go to the lower gid."""
    counts = shard_counts(configs)
    high = F.max(F.struct((F.col("gid") == 0).alias("zero"), "shards", (-F.col("gid")).alias("g")))
    low = F.min(F.when(F.col("gid") != 0, F.struct("shards", "gid")))
    joined = F.when(F.col("gid") != 0, F.col("shards"))
    return counts.groupBy("num").agg(high.alias("h"), low.alias("l"), (F.max(joined) <= F.min(joined) + 1).alias("balanced")).select(
        "num", (-F.col("h.g")).alias("max_gid"), F.col("h.shards").alias("max_shards"), F.col("l.gid").alias("min_gid"), F.col("l.shards").alias("min_shards"), "balanced")


def config_changes(configs: DataFrame) -> DataFrame:
    """(num, shard, gid, status) for every group a change from num - 1 to num concerns.

    Gained from a real group is MoveIn, lost to a real group is MoveOut; what comes from
    or goes to group 0 starts Normal and moves nothing.
    """
    rows = configs.select("num", F.posexplode("shards").alias("shard", "gid"))
    before = F.lag("gid").over(Window.partitionBy("shard").orderBy("num"))
    pairs = rows.withColumn("old", before).where("old is not null and old <> gid")
    gained = pairs.where("gid <> 0").select("num", "shard", "gid", F.when(F.col("old") != 0, MOVE_IN).otherwise(NORMAL).alias("status"))
    lost = pairs.where("old <> 0").select("num", "shard", F.col("old").alias("gid"), F.when(F.col("gid") != 0, MOVE_OUT).otherwise(NORMAL).alias("status"))
    return gained.unionByName(lost)


def statuses(configs: DataFrame) -> DataFrame:
    """(num, gid, shard, owned, status) just after each configuration: of every group the
    shards it owns and those it lost.

    A group takes the next configuration only when all its shards are Normal (see next_config),
    so what it kept is Normal, and what a change concerns is as in config_changes.
    """
    rows = configs.select("num", F.posexplode("shards").alias("shard", "gid"))
    before = F.lag("gid").over(Window.partitionBy("shard").orderBy("num"))
    kept = rows.withColumn("old", before).where("gid <> 0 and (old is null or old = gid)").select("num", "gid", "shard", F.lit(True).alias("owned"), F.lit(NORMAL).alias("status"))
    changed = config_changes(configs).join(rows.withColumnRenamed("gid", "owner"), ["num", "shard"])
    return kept.unionByName(changed.select("num", "gid", "shard", (F.col("owner") == F.col("gid")).alias("owned"), "status"))


def serves(statuses: DataFrame) -> DataFrame:
    """Shards (gid, shard, owned, status) that a group may serve: its own, Normal or GC."""
    return statuses.where(F.col("owned") & F.col("status").isin(NORMAL, GC))


def next_config(current: DataFrame, statuses: DataFrame, configs: DataFrame) -> DataFrame:
    """(gid, num) that each group of `current` (gid, num) takes next: the following
    configuration if there is one and none of its shards (gid, shard, status) is being moved."""
    busy = statuses.where(F.col("status") != NORMAL).select("gid").distinct()
    ready = current.join(busy, "gid", "left_anti").select("gid", (F.col("num") + 1).alias("num"))
    return ready.join(configs.select("num"), "num", "left_semi").select("gid", "num")


def pulled(data: DataFrame, current: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shard data (to_gid, shard, key, value) for requests (to_gid, from_gid, shard, num), and
    the requests (to_gid, from_gid, shard) not ready, whose source has an older configuration.

    data: (gid, key, value) of all groups; current: (gid, num).
    """
    at = requests.join(current.select(F.col("gid").alias("from_gid"), F.col("num").alias("have")), "from_gid", "left")
    ready = F.coalesce(F.col("have") >= F.col("num"), F.lit(False))
    rows = data.select(F.col("gid").alias("from_gid"), "key", "value").withColumn("shard", key_to_shard(F.col("key")))
    return rows.join(at.where(ready), ["from_gid", "shard"]).select("to_gid", "shard", "key", "value"), at.where(~ready).select("to_gid", "from_gid", "shard")


def installed(data: DataFrame, statuses: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Data (gid, key, value) and statuses (gid, shard, ..., status) after pulled rows came in:
    they are put over those of shards that are MoveIn, which are GC then; others are left alone."""
    open_ = statuses.where(F.col("status") == MOVE_IN).select("gid", "shard")
    new = moved.select(F.col("to_gid").alias("gid"), "shard", "key", F.col("value").alias("__new"), F.lit(True).alias("__in")).join(open_, ["gid", "shard"], "left_semi").drop("shard")
    merged = data.join(new, ["gid", "key"], "full").select("gid", "key", F.when(F.col("__in"), F.col("__new")).otherwise(F.col("value")).alias("value"))
    return merged, statuses.withColumn("status", F.when(F.col("status") == MOVE_IN, GC).otherwise(F.col("status")))


def garbage_collected(data: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Data and statuses after a collection: the rows of shards moved out are deleted, and
    these shards and those that were GC are Normal."""
    gone = statuses.where(F.col("status") == MOVE_OUT).select("gid", F.col("shard").alias("__shard"))
    kept = data.withColumn("__shard", key_to_shard(F.col("key"))).join(gone, ["gid", "__shard"], "left_anti").select("gid", "key", "value")
    return kept, collected(statuses).drop("emptied")


def merge_migrated(receiver: DataFrame, moved: DataFrame) -> DataFrame:
    """State (key, value) of the receiver with the moved keys put over it."""
    other = moved.select("key", F.col("value").alias("__new"), F.lit(True).alias("__in"))
    return receiver.join(other, "key", "full").select("key", F.when(F.col("__in"), F.col("__new")).otherwise(F.col("value")).alias("value"))


def merge_applied(*tables: DataFrame) -> DataFrame:
    """Deduplication tables (client_id, seq_id, reply): the largest seq_id of each client."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("client_id").agg(F.max(F.struct("seq_id", "reply")).alias("r")).select("client_id", "r.*")


def collected(statuses: DataFrame) -> DataFrame:
    """Statuses after a collection: GC is Normal; a shard moved out is Normal and empty."""
    return statuses.withColumn("emptied", F.col("status") == MOVE_OUT).withColumn("status", F.when(F.col("status").isin(GC, MOVE_OUT), NORMAL).otherwise(F.col("status")))
