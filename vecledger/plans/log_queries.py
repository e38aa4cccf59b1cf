"""Queries on operation logs, shards and histories, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecledger.functions.shard import key_to_shard
from vecledger.operators import kvlog, shards
from vecledger.operators.approximate import ring_owner, ring_replicas, ring_tokens
from vecledger.operators.history import GET, PUT, history_verdict, linearizable
from vecledger.operators.redelivery import first_deliveries
from vecledger.sources.tables import table
from vecledger.streaming.vector_stream import live_points, writes_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def log(spark: SparkSession, sf: str) -> DataFrame:
    """`events` as an operation log, with repeated and older sequence numbers."""
    op = F.when(F.col("event_type").isin("signup", "purchase"), "Put").when(F.col("event_type").isin("click", "view"), "Append").otherwise("Get")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("log_index"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"),
        (F.col("user_id") % 7).alias("client_id"), (F.floor(F.col("event_id") / 2) - F.when(F.col("event_id") % 5 == 0, 40).otherwise(0)).alias("seq_id"))


L = """l AS (SELECT event_id AS i, CASE WHEN event_type IN ('signup', 'purchase') THEN 'Put' WHEN event_type IN ('click', 'view') THEN 'Append' ELSE 'Get' END AS op,
      user_id::VARCHAR AS key, event_type AS val, user_id % 7 AS client, event_id // 2 - CASE WHEN event_id % 5 = 0 THEN 40 ELSE 0 END AS seq FROM events),
    o AS (SELECT * FROM l WHERE op <> 'Get' QUALIFY seq > coalesce(max(seq) OVER (PARTITION BY client ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000)),
    r AS (SELECT *, max(CASE WHEN op = 'Put' THEN i END) OVER (PARTITION BY key) AS reset FROM o),
    s AS (SELECT key, string_agg(val, '' ORDER BY i) AS val FROM r WHERE reset IS NULL OR i >= reset GROUP BY key)"""


@query("kv_dedup", f"WITH {L} SELECT i AS log_index, key, op FROM o UNION ALL SELECT i, key, op FROM l WHERE op = 'Get'")
def _(spark, sf):
    return kvlog.once(log(spark, sf)).select("log_index", "key", "op")


@query("kv_state", f"WITH {L} SELECT key, md5(val) AS value_md5, length(val) AS length FROM s")
def _(spark, sf):
    return kvlog.state(log(spark, sf)).select("key", F.md5(F.col("value").cast("binary")).alias("value_md5"), F.length("value").cast("bigint").alias("length"))


@query("kv_resumed", f"WITH {L} SELECT key, md5(val) AS value_md5 FROM s")
def _(spark, sf):
    """A snapshot in the middle of the log, and the rest of the log on top of it."""
    rows = log(spark, sf)
    middle = rows.agg(F.percentile_approx("log_index", 0.5).alias("m"))
    marked = rows.join(F.broadcast(middle))  # one row
    first, rest = marked.where("log_index <= m").drop("m"), marked.where("log_index > m").drop("m")
    found = kvlog.resumed(kvlog.state(first), kvlog.applied_table(first), rest)
    return found.select("key", F.md5(F.col("value").cast("binary")).alias("value_md5"))


@query("kv_get", f"WITH {L}, k AS (SELECT (c_custkey // 2)::VARCHAR AS key FROM customer) SELECT DISTINCT key, md5(coalesce(val, '')) AS value_md5, val IS NOT NULL AS found FROM k LEFT JOIN s USING (key)")
def _(spark, sf):
    keys = table(spark, sf, "customer").select(F.expr("cast(c_custkey div 2 as string)").alias("key"))
    return kvlog.get(keys, kvlog.state(log(spark, sf))).select("key", F.md5(F.col("value").cast("binary")).alias("value_md5"), "found")


_HEX = "CASE WHEN {k} = '' THEN 0 ELSE ((instr('0123456789ABCDEF', substr(hex({k}), 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex({k}), 2, 1)) - 1) % 10 END"


@query("key_to_shard", f"SELECT kv_key, ({_HEX.format(k='kv_key')})::INT AS shard, count(*) AS messages FROM put_append_msgs WHERE kv_key IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "put_append_msgs").where("kv_key is not null").groupBy("kv_key").agg(F.count("*").alias("messages"))
    return rows.select("kv_key", key_to_shard(F.col("kv_key")).alias("shard"), "messages")


@query("shard_sizes", f"SELECT ({_HEX.format(k='kv_key')})::INT AS shard, count(DISTINCT kv_key) AS keys, count(*) AS messages FROM put_append_msgs WHERE kv_key IS NOT NULL GROUP BY 1")
def _(spark, sf):
    rows = table(spark, sf, "put_append_msgs").where("kv_key is not null").groupBy("kv_key").agg(F.count("*").alias("n"))
    return rows.groupBy(key_to_shard(F.col("kv_key")).alias("shard")).agg(F.count("*").alias("keys"), F.sum("n").alias("messages"))


@query("first_deliveries", """SELECT arrival_no FROM put_append_msgs WHERE client_id IS NULL OR seq_id IS NULL OR kv_key IS NULL
    UNION ALL SELECT min(arrival_no) FROM put_append_msgs WHERE client_id IS NOT NULL AND seq_id IS NOT NULL AND kv_key IS NOT NULL GROUP BY client_id, seq_id, kv_key""")
def _(spark, sf):
    return first_deliveries(table(spark, sf, "put_append_msgs"), ("client_id", "seq_id"), "kv_key", "arrival_no").select("arrival_no")


def controller() -> shards.Controller:
    c = shards.Controller()
    c.join({1: ["x", "y", "z"]})
    c.join({2: ["a", "b", "c"]})
    c.leave([1])
    c.leave([2])
    c.join({3: ["d"], 4: ["e"]})
    c.move(0, 4)
    return c


#: The configurations that the controller above must arrive at.
_CONFIGS = """c AS (SELECT * FROM (VALUES (0, [0,0,0,0,0,0,0,0,0,0], []::INT[]), (1, [1,1,1,1,1,1,1,1,1,1], [1]), (2, [2,2,2,2,2,1,1,1,1,1], [1, 2]),
    (3, [2,2,2,2,2,2,2,2,2,2], [2]), (4, [0,0,0,0,0,0,0,0,0,0], []::INT[]), (5, [3,4,3,4,3,4,3,4,3,4], [3, 4]), (6, [4,4,3,4,3,4,3,4,3,4], [3, 4])) AS t(num, shards, gids))"""


def configs(spark: SparkSession) -> DataFrame:
    return controller().frame(spark)


def _config(name: str, num: int, asked: int | None = None) -> None:
    asked = num if asked is None else asked
    sql = f"WITH {_CONFIGS} SELECT num, shards, gids FROM c WHERE num = {num}"
    query(name, sql)(lambda spark, sf: shards.config_at(configs(spark), asked).select("num", "shards", F.array_sort(F.map_keys("groups")).alias("gids")))


_config("controller_join", 2)
_config("controller_leave", 3)
_config("controller_leave_all", 4)
_config("controller_move", 6)
_config("controller_query", 1)
_config("controller_query_latest", 6, -1)


@query("shard_balance", f"""WITH {_CONFIGS}, h AS (SELECT num, unnest(shards) AS gid, 1 AS n FROM c UNION ALL SELECT num, unnest(gids), 0 FROM c),
    k AS (SELECT num, gid, sum(n)::BIGINT AS n FROM h GROUP BY ALL)
    SELECT num, arg_max(gid, (CASE WHEN gid = 0 THEN 1000000 ELSE 0 END) + n * 1000 - gid) AS max_gid, arg_max(n, (CASE WHEN gid = 0 THEN 1000000 ELSE 0 END) + n * 1000 - gid) AS max_shards,
      arg_min(gid, n * 1000 + gid) FILTER (WHERE gid <> 0) AS min_gid, min(n) FILTER (WHERE gid <> 0) AS min_shards,
      max(n) FILTER (WHERE gid <> 0) <= min(n) FILTER (WHERE gid <> 0) + 1 AS balanced FROM k GROUP BY num""")
def _(spark, sf):
    return shards.balance(configs(spark))


@query("shard_config_diff", f"""WITH {_CONFIGS}, u AS (SELECT num, unnest(shards) AS gid, generate_subscripts(shards, 1)::INT - 1 AS shard FROM c),
    d AS (SELECT n.num, n.shard, n.gid, o.gid AS old FROM u n JOIN u o ON o.num = n.num - 1 AND o.shard = n.shard WHERE n.gid <> o.gid)
    SELECT num, shard, gid, CASE WHEN old <> 0 THEN 'MoveIn' ELSE 'Normal' END AS status FROM d WHERE gid <> 0
    UNION ALL SELECT num, shard, old, CASE WHEN gid <> 0 THEN 'MoveOut' ELSE 'Normal' END FROM d WHERE old <> 0""")
def _(spark, sf):
    return shards.config_changes(configs(spark)).withColumn("shard", F.col("shard").cast("int"))


@query("shard_status_gc", f"""WITH {_CONFIGS}, u AS (SELECT num, unnest(shards) AS gid, generate_subscripts(shards, 1)::INT - 1 AS shard FROM c),
    d AS (SELECT n.num, n.shard, n.gid, o.gid AS old FROM u n JOIN u o ON o.num = n.num - 1 AND o.shard = n.shard WHERE n.gid <> o.gid)
    SELECT num, shard, gid, CASE WHEN old <> 0 THEN 'MoveIn' ELSE 'Normal' END AS status, false AS emptied FROM d WHERE gid <> 0
    UNION ALL SELECT num, shard, old, 'Normal', gid <> 0 FROM d WHERE old <> 0""")
def _(spark, sf):
    return shards.collected(shards.config_changes(configs(spark))).withColumn("shard", F.col("shard").cast("int"))


@query("shard_serving", f"""WITH {_CONFIGS}, u AS (SELECT num, unnest(shards) AS gid, generate_subscripts(shards, 1)::INT - 1 AS shard FROM c)
    SELECT n.num, n.shard, n.gid FROM u n LEFT JOIN u o ON o.num = n.num - 1 AND o.shard = n.shard WHERE n.gid <> 0 AND coalesce(o.gid, 0) IN (0, n.gid)""")
def _(spark, sf):
    return shards.serves(shards.statuses(configs(spark))).select("num", F.col("shard").cast("int").alias("shard"), "gid")


@query("shard_next_config", "SELECT * FROM (VALUES (1, 2)) AS t(gid, num)")
def _(spark, sf):
    """At configuration 1 all is Normal; at 2, group 2 still waits for its shards and group 1 to be rid of them."""
    c = configs(spark)
    at = lambda num, gid: (spark.createDataFrame([(gid, num)], "gid int, num int"), shards.statuses(c).where(F.col("num") == num))
    first, second = shards.next_config(*at(1, 1), c), shards.next_config(*at(2, 2), c)
    return first.unionByName(second)


def shard_data(spark: SparkSession, sf: str) -> DataFrame:
    """All keys at group 1, as after configuration 1."""
    rows = table(spark, sf, "put_append_msgs").where("kv_key is not null").groupBy(F.col("kv_key").alias("key")).agg(F.max("kv_value").alias("value"))
    return rows.select(F.lit(1).alias("gid"), "key", "value")


def moving(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Data, statuses after configuration 2, the rows group 2 pulls and the requests not ready."""
    status = shards.statuses(configs(spark)).where("num = 2")
    asked = status.where("status = 'MoveIn'").select(F.col("gid").alias("to_gid"), F.lit(1).alias("from_gid"), "shard", "num")
    late = spark.createDataFrame([(4, 3, 9, 7)], "to_gid int, from_gid int, shard int, num int")
    data, current = shard_data(spark, sf), spark.createDataFrame([(1, 2), (2, 2), (3, 6)], "gid int, num int")
    return data, status, *shards.pulled(data, current, asked.unionByName(late))


_DATA = f"""d AS (SELECT kv_key AS key, max(kv_value) AS value, ({_HEX.format(k='kv_key')})::INT AS shard FROM put_append_msgs WHERE kv_key IS NOT NULL GROUP BY kv_key)"""


@query("shard_pull", f"WITH {_DATA} SELECT 2 AS to_gid, shard, key, value FROM d WHERE shard < 5")
def _(spark, sf):
    return moving(spark, sf)[2].withColumn("shard", F.col("shard").cast("int"))


@query("shard_pull_not_ready", "SELECT 4 AS to_gid, 3 AS from_gid, 9 AS shard")
def _(spark, sf):
    return moving(spark, sf)[3]


@query("shard_install", f"WITH {_DATA} SELECT gid, key, value FROM d, (VALUES (1), (2)) AS g(gid) WHERE gid = 1 OR shard < 5")
def _(spark, sf):
    data, status, moved, _late = moving(spark, sf)
    return shards.installed(data, status, moved)[0]


@query("shard_gc", f"WITH {_DATA} SELECT CASE WHEN shard < 5 THEN 2 ELSE 1 END AS gid, key, value FROM d")
def _(spark, sf):
    data, status, moved, _late = moving(spark, sf)
    return shards.garbage_collected(*shards.installed(data, status, moved))[0]


@query("shard_statuses", f"""WITH {_CONFIGS}, u AS (SELECT num, unnest(shards) AS gid, generate_subscripts(shards, 1)::INT - 1 AS shard FROM c WHERE num IN (1, 2)),
    d AS (SELECT n.shard, n.gid, o.gid AS old FROM u n JOIN u o ON o.num = 1 AND o.shard = n.shard WHERE n.num = 2)
    SELECT shard, gid, true AS owned, 'Normal' AS status FROM d UNION ALL SELECT shard, old, false, 'Normal' FROM d WHERE old <> gid""")
def _(spark, sf):
    data, status, moved, _late = moving(spark, sf)
    return shards.garbage_collected(*shards.installed(data, status, moved))[1].select(F.col("shard").cast("int").alias("shard"), "gid", "owned", "status")


@query("shard_owner_lookup", f"""WITH {_CONFIGS}, k AS (SELECT DISTINCT kv_key AS key, ({_HEX.format(k='kv_key')})::INT AS shard FROM put_append_msgs WHERE kv_key IS NOT NULL)
    SELECT key, shard, shards[shard + 1] AS gid, CASE shards[shard + 1] WHEN 1 THEN 3 ELSE 3 END AS servers FROM k, c WHERE num = 2""")
def _(spark, sf):
    keys = table(spark, sf, "put_append_msgs").where("kv_key is not null").select(F.col("kv_key").alias("key")).distinct()
    return shards.owners(keys, shards.config_at(configs(spark), 2)).withColumn("servers", F.size("servers"))


@query("shard_migration_merge", """WITH a AS (SELECT c_custkey::VARCHAR AS key, c_mktsegment AS val FROM customer), b AS (SELECT o_custkey::VARCHAR AS key, max(o_orderpriority) AS val FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT key, coalesce(b.val, a.val) AS value FROM a FULL JOIN b USING (key)""")
def _(spark, sf):
    mine = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    moved = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.max("o_orderpriority").alias("value"))
    return shards.merge_migrated(mine, moved)


@query("applied_merge", """SELECT client_id, max(seq_id) AS seq_id FROM put_append_msgs WHERE client_id IS NOT NULL AND seq_id IS NOT NULL GROUP BY client_id""")
def _(spark, sf):
    rows = table(spark, sf, "put_append_msgs").where("client_id is not null and seq_id is not null")
    part = lambda server: rows.where(F.col("server_id") % 2 == server).select("client_id", "seq_id", F.col("op_type").alias("reply"))
    return shards.merge_applied(part(0), part(1), rows.where("server_id is null").select("client_id", "seq_id", F.col("op_type").alias("reply"))).select("client_id", "seq_id")


@query("majority_index", "SELECT l_orderkey, list_sort(list(l_quantity))[(count(*) - 1) // 2 + 1] AS majority_index FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    return kvlog.majority_index(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity")


@query("op_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type")
def _(spark, sf):
    found = kvlog.moments(table(spark, sf, "events"), ["event_type"], "value")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("deviation", 6).alias("deviation"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """A history that is linearizable by construction: signups put, clicks get the last put."""
    e = table(spark, sf, "events").where("event_type in ('signup', 'click')")
    put = F.col("event_type") == "signup"
    last = F.last(F.when(put, F.col("event_id").cast("string")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return e.select(
        F.col("user_id").alias("client_id"), F.when(put, PUT).otherwise(GET).alias("op"), F.col("user_id").cast("string").alias("key"), F.when(put, F.col("event_id").cast("string")).alias("value"),
        F.when(~put, F.coalesce(last, F.lit(""))).alias("output"), (F.col("event_id") * 10).alias("call_ns"), (F.col("event_id") * 10 + 5).alias("return_ns"))


@query("linearizability", "SELECT user_id::VARCHAR AS key, 'Ok' AS verdict, count(*) AS operations FROM events WHERE event_type IN ('signup', 'click') GROUP BY 1")
def _(spark, sf):
    return linearizable(history(spark, sf)).select("key", "verdict", "operations")


@query("linearizability_illegal", "SELECT user_id::VARCHAR AS key, CASE WHEN user_id % 10 = 0 AND count(*) FILTER (WHERE event_type = 'click') > 0 THEN 'Illegal' ELSE 'Ok' END AS verdict FROM events WHERE event_type IN ('signup', 'click') GROUP BY user_id")
def _(spark, sf):
    stale = history(spark, sf).withColumn("output", F.when((F.col("client_id") % 10 == 0) & (F.col("op") == GET), "never put").otherwise(F.col("output")))
    return linearizable(stale).select("key", "verdict")


@query("linearizability_unknown", "SELECT user_id::VARCHAR AS key, CASE WHEN count(*) > 1 THEN 'Unknown' ELSE 'Ok' END AS verdict FROM events WHERE event_type IN ('signup', 'click') GROUP BY user_id")
def _(spark, sf):
    return linearizable(history(spark, sf), budget=1).select("key", "verdict")


@query("linearizability_verdict", "SELECT 'Ok' AS verdict")
def _(spark, sf):
    return history_verdict(linearizable(history(spark, sf)))


@query("token_ring", """WITH t AS (SELECT ('0x' || substr(md5('node' || n || '#' || v), 1, 8))::BIGINT AS token, 'node' || n AS node FROM range(4) a(n), range(256) b(v)),
    k AS (SELECT DISTINCT kv_key AS key, ('0x' || substr(md5(kv_key), 1, 8))::BIGINT AS h FROM put_append_msgs WHERE kv_key IS NOT NULL),
    a AS (SELECT key, node FROM k ASOF LEFT JOIN t ON k.h <= t.token)
    SELECT key, coalesce(node, (SELECT arg_min(node, token) FROM t)) AS node FROM a""")
def _(spark, sf):
    nodes = spark.range(4).select(F.concat(F.lit("node"), "id").alias("node"))
    keys = table(spark, sf, "put_append_msgs").where("kv_key is not null").select(F.col("kv_key").alias("key")).distinct()
    return ring_owner(keys, ring_tokens(nodes))


@query("token_ring_replicas", """WITH t AS (SELECT ('0x' || substr(md5('node' || n || '#' || v), 1, 8))::BIGINT AS token, 'node' || n AS node FROM range(4) a(n), range(8) b(v)),
    k AS (SELECT DISTINCT kv_key AS key, ('0x' || substr(md5(kv_key), 1, 8))::BIGINT AS h FROM put_append_msgs WHERE kv_key IS NOT NULL),
    d AS (SELECT key, node, min(CASE WHEN token >= h THEN token - h ELSE token - h + 4294967296 END) AS away FROM k, t GROUP BY key, node),
    r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY away, node) AS n FROM d)
    SELECT key, list(node ORDER BY n) AS nodes FROM r WHERE n <= 3 GROUP BY key""")
def _(spark, sf):
    nodes = spark.range(4).select(F.concat(F.lit("node"), "id").alias("node"))
    keys = table(spark, sf, "put_append_msgs").where("kv_key is not null").select(F.col("kv_key").alias("key")).distinct()
    return ring_replicas(keys, ring_tokens(nodes, 8), 3)


@query("vector_commands", """WITH w AS (SELECT * FROM vectors WHERE collection_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection_name, vector_id ORDER BY ts_ns DESC) = 1),
    m AS (SELECT max(ts_ns) AS t FROM vectors WHERE collection_name = 'thumbnails')
    SELECT collection_name AS collection, vector_id AS id, ts_ns AS log_index, coalesce(len(vector_values), -1) AS length FROM w, m
    WHERE NOT deleted AND (collection_name <> 'thumbnails' OR ts_ns > t - 3599999999999)""")
def _(spark, sf):
    """Writes as commands, with a delete and a new create of one collection an hour before its last write."""
    rows = table(spark, sf, "vectors")
    command = F.when(F.col("deleted"), "VectorDelete").otherwise("VectorPut")
    nothing = F.lit(None).cast("array<struct<id: string, values: array<float>, metadata: string>>").alias("points")
    commands = rows.select(F.col("ts_ns").alias("log_index"), command.alias("command"), F.col("collection_name").alias("collection"), F.col("vector_id").alias("id"), F.col("vector_values").alias("values"), "metadata", nothing)
    again = commands.where("collection = 'thumbnails'").groupBy("collection").agg((F.max("log_index") - 3600000000000).alias("log_index"))
    for later, kind in enumerate(("CollectionDelete", "CollectionCreate")):
        commands = commands.unionByName(again.select("collection", (F.col("log_index") + later).alias("log_index"), F.lit(kind).alias("command")), allowMissingColumns=True)
    return live_points(writes_of(commands)).select("collection", "id", "log_index", F.coalesce(F.when(F.col("values").isNotNull(), F.size("values")), F.lit(-1)).cast("bigint").alias("length"))
