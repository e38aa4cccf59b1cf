import random

import pytest
from pyspark.sql import functions as F

from vecledger.functions.shard import key_to_shard
from vecledger.operators import changefeed, kvlog, shards
from vecledger.operators.approximate import ring_owner, ring_tokens
from vecledger.operators.history import ILLEGAL, OK, UNKNOWN, check, partial_orders, history_verdict, linearizable
from vecledger.operators.redelivery import first_deliveries, permute, redelivered, unpermute
from vecledger.streaming.kv_stream import applied

LOG = "log_index bigint, op string, key string, value string, client_id bigint, seq_id bigint"


def model(ops):
    state, last = {}, {}
    for _, op, key, value, client, seq in sorted(ops):
        if op == "Get":
            continue
        if seq <= last.get(client, -(2**62)):
            continue
        last[client] = seq
        state[key] = value if op == "Put" else state.get(key, "") + value
    return state


def test_literal_log(spark):
    rows = [(1, "Put", "k", "A", 1, 0), (2, "Append", "k", "B", 1, 1), (3, "Append", "k", "B", 1, 1), (4, "Append", "k", "C", 2, 0), (5, "Put", "j", "Z", 2, 0), (6, "Get", "k", None, 3, 0)]
    state = kvlog.state(spark.createDataFrame(rows, LOG))
    assert dict(state.collect()) == {"k": "ABC"}
    keys = spark.createDataFrame([("k",), ("j",), ("k",)], "key string")
    assert sorted(kvlog.get(keys, state).collect()) == [("j", "", False), ("k", "ABC", True)]


def test_random_log(spark, monkeypatch):
    monkeypatch.setattr(kvlog, "BLOCK", 64)
    monkeypatch.setattr(changefeed, "SEGMENT", 16)
    rng = random.Random(5)
    ops = [(i, rng.choice(["Put", "Append", "Append", "Get"]), rng.choice("abcde"), str(i) + ";", rng.randrange(3), max(0, i // 2 - rng.choice([0, 0, 0, 30]))) for i in range(1500)]
    for start in (0, 10**9):  # a compacted log begins late
        later = [(i + start, *rest) for i, *rest in ops]
        assert dict(kvlog.state(spark.createDataFrame(later, LOG).repartition(7)).collect()) == model(ops)
    assert kvlog.state(spark.createDataFrame([], LOG)).count() == 0


def feed_model(rows):
    """rows: (gid, index, term, valid, op, key, value, client, seq)."""
    entry = {}
    for r in rows:
        if (r[0], r[1]) not in entry or entry[r[0], r[1]][2] < r[2]:
            entry[r[0], r[1]] = r
    state, done = {}, set()
    for (gid, _), (_, _, _, valid, op, key, value, client, seq) in sorted(entry.items()):
        if not valid or op == 0 or (gid, client, seq) in done:
            continue
        done.add((gid, client, seq))
        if op == 3:
            state.pop((gid, key), None)
        else:
            state[gid, key] = value if op == 1 else state.get((gid, key), "") + value
    return state


FEED = "feed_no bigint, gid int, log_term int, command_index bigint, command_valid boolean, kv_op tinyint, kv_key string, command string"


def test_change_feed(spark, monkeypatch):
    import json

    monkeypatch.setattr(changefeed, "SEGMENT", 8)
    rng = random.Random(11)
    names = {0: ["Get", 0], 1: ["Put", "put", 1], 2: ["APPEND", 2], 3: ["delete", 3]}
    entries = {}
    rows = []
    for _ in range(1200):
        gid, index, term = rng.randrange(3), rng.randrange(1, 300), rng.randrange(3)
        if (gid, index, term) not in entries:
            op = rng.choice([0, 1, 2, 2, 2, 3])
            entries[gid, index, term] = (gid, index, term, rng.random() < 0.9, op, rng.choice(["é", "b", "c\"", ""]), f"{index};", rng.randrange(4), rng.randrange(120))
        rows.append(entries[gid, index, term])
    data = []
    for n, (gid, index, term, valid, op, key, value, client, seq) in enumerate(rows):
        body = {"Key": key, "OpType": rng.choice(names[op]), "ClientId": client, "SeqId": seq}
        if op in (1, 2):
            body["Value"] = value
        data.append((n, gid, term, index, valid, None, None, json.dumps(body) if valid or rng.random() < 0.5 else None))
    data.append((len(data), None, 1, 1, True, None, None, "{}"))
    data.append((len(data), 1, 9, 1000, True, None, None, "not json"))
    got = {(r[0], r[1]): r[2] for r in changefeed.apply_feed(spark.createDataFrame(data, FEED).repartition(5)).collect()}
    assert got == feed_model(rows)
    assert changefeed.apply_feed(spark.createDataFrame([], FEED)).count() == 0


def test_base_rows(spark):
    writes = spark.createDataFrame([("a", 1, 2, "+"), ("b", 2, 3, None), ("c", 3, 1, None), ("d", 5000, 2, "x")], "key string, pos bigint, op int, value string")
    base = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("e", None)], "key string, value string")
    want = {"a": "A+", "c": "", "d": "x", "e": ""}
    assert dict(changefeed.current_state(writes, ["key"], "pos", base).collect()) == dict(changefeed.folded_state(writes, ["key"], "pos", 1, 5000, base).collect()) == want
    late = writes.withColumn("pos", F.col("pos") + 10**9)
    assert dict(changefeed.current_state(late, ["key"], "pos", base).collect()) == want


MESSAGES = "arrival_no bigint, client_id bigint, seq_id bigint, kv_key string, quotient string, a int"


def test_redelivery(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, -5]), rng.choice([None, 0, 7]), rng.choice([None, "", "x", "x "]), "q", i) for i in range(400)]
    rows += [rows[5], (None, 1, 7, "x", "q", 0)]
    df = spark.createDataFrame(rows, MESSAGES).repartition(6)
    first, others, nameless = {}, set(), set()
    for r in sorted(r for r in rows if r[0] is not None):
        key = r[1:4]
        if None in key:
            nameless.add(r[0])
        elif first.setdefault(key, r[0]) != r[0]:
            others.add(r[0])
    ids = (("client_id", "seq_id"), "kv_key", "arrival_no")
    assert sorted(r[0] for r in redelivered(df, *ids).collect()) == sorted(others)
    kept = first_deliveries(df, *ids)
    assert kept.columns == df.columns
    assert {r[0] for r in kept.collect()} == set(first.values()) | nameless
    assert redelivered(df.where("false"), *ids).count() == 0


def test_permutation(spark):
    rows = spark.createDataFrame([(0, 0), (1, -1), (2**63 - 1, -(2**63))], "a bigint, b bigint")
    p, q = permute(F.col("a"), F.col("b"))
    back = rows.select("a", "b", p.alias("p"), q.alias("q")).select("a", "b", *[c.alias(n) for c, n in zip(unpermute(F.col("p"), F.col("q")), "xy", strict=True)])
    assert all(r[0] == r[2] and r[1] == r[3] for r in back.collect())


def test_shards(spark):
    keys = spark.createDataFrame([(k,) for k in ["0", "1", "2", "9", "", "Größe", "ß", None]], "key string")
    got = {r[0]: r[1] for r in keys.select("key", key_to_shard(F.col("key"))).collect()}
    assert got == {"0": 8, "1": 9, "2": 0, "9": 7, "": 0, "Größe": ord("G") % 10, "ß": 0xC3 % 10, None: None}


def test_controller():
    c = shards.Controller()
    assert c.query().shards == (0,) * 10
    assert c.join({1: ["x"]}).shards == (1,) * 10
    assert c.join({2: ["a"]}).shards == (2, 2, 2, 2, 2, 1, 1, 1, 1, 1)
    assert c.leave([1]).shards == (2,) * 10
    assert c.leave([2]).shards == (0,) * 10
    assert c.join({}).shards == (0,) * 10
    assert c.query(1).shards == (1,) * 10 and c.query(99).num == c.query(-1).num == 5
    rng = random.Random(1)
    for _ in range(200):
        old = c.latest
        if rng.random() < 0.5:
            new = c.join({rng.randrange(1, 14): ["s"]})
            moved = [s for s in range(10) if old.shards[s] != new.shards[s]]
            assert all(new.shards[s] not in old.groups for s in moved)
        else:
            gid = rng.randrange(1, 14)
            new = c.leave([gid])
            assert all(old.shards[s] == gid for s in range(10) if old.shards[s] != new.shards[s])
        n = [new.shards.count(g) for g in new.groups]
        assert not n or max(n) <= min(n) + 1 and sum(n) == 10
    d = shards.Controller()
    d.apply(1, 1, "join", {1: ["a"]})
    d.apply(1, 1, "join", {2: ["b"]})
    assert d.latest.num == 1 and d.apply(1, 2, "move", 0, 9).shards[0] == 9


def test_migration(spark):
    mine = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    moved = spark.createDataFrame([("b", "9"), ("c", None)], "key string, value string")
    assert dict(shards.merge_migrated(mine, moved).collect()) == {"a": "1", "b": "9", "c": None}
    t = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 0, "z")], "client_id int, seq_id int, reply string")
    assert sorted(shards.merge_applied(t, t).collect()) == [(1, 7, "y"), (2, 0, "z")]


@pytest.mark.parametrize(("values", "expected"), [([5, 3, 4], 4), ([9, 1, 7, 3, 5], 5), ([4, 1, 3, 2], 2)])
def test_majority(spark, values, expected):
    df = spark.createDataFrame([(1, v) for v in values], "g int, v int")
    assert kvlog.majority_index(df, ["g"], "v").first()[1] == expected


def test_linearizability(spark):
    good = [(1, "a", "", 0, 10), (0, "", "a", 5, 15), (2, "b", "", 12, 20), (0, "", "ab", 14, 30)]
    stale = [(1, "a", "", 0, 1), (1, "b", "", 2, 3), (0, "", "a", 4, 5)]
    assert check(good)[0] == OK
    assert check(stale) == (ILLEGAL, [0, 1])
    assert check(good, budget=1)[0] == UNKNOWN
    assert check([]) == (OK, [])
    open_end = [(1, "a", "", 0, 10), (1, "b", "", 1, 11), (0, "", "c", 12, 13)]
    assert partial_orders(open_end) == (ILLEGAL, [[0, 1], [1, 0]][:1]) or partial_orders(open_end)[1][0] in ([0, 1], [1, 0])
    schema = "client_id int, op tinyint, key string, value string, output string, call_ns bigint, return_ns bigint"
    rows = [(1, op, "g", v, o, c, r) for op, v, o, c, r in good] + [(1, op, "s", v, o, c, r) for op, v, o, c, r in stale]
    got = linearizable(spark.createDataFrame(rows, schema))
    assert {r["key"]: r["verdict"] for r in got.collect()} == {"g": OK, "s": ILLEGAL}
    assert history_verdict(got).first()[0] == ILLEGAL


def test_token_ring(spark):
    tokens = ring_tokens(spark.createDataFrame([("n1",), ("n2",), ("n3",)], "node string"), 5).cache()
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    import hashlib

    ring = sorted((r["token"], r["node"]) for r in tokens.collect())
    at = lambda k: int(hashlib.md5(k.encode()).hexdigest()[:8], 16)
    expected = {f"k{i}": next((n for t, n in ring if t >= at(f"k{i}")), ring[0][1]) for i in range(300)}
    assert {r["key"]: r["node"] for r in ring_owner(keys, tokens).collect()} == expected


def streamed(spark, tmp_path, parts):
    """Key to value after a stream that is stopped and started again after each part."""
    source, out, latest = str(tmp_path / "in"), str(tmp_path / "check"), {}

    def sink(df, _):
        latest.update({r["key"]: r["value"] for r in df.collect()})

    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        stream = applied(spark.readStream.schema(LOG).parquet(source))
        stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    return latest


def test_stream(spark, tmp_path):
    rng = random.Random(8)
    ops = [(i, rng.choice(["Put", "Append", "Append", "Get"]), rng.choice("ab"), f"{i};", rng.randrange(2), max(0, i // 2 - rng.choice([0, 0, 9]))) for i in range(60)]
    assert streamed(spark, tmp_path, (ops[:25], ops[25:40], ops[40:])) == model(ops)


def test_stream_dedup_is_by_client(spark, tmp_path):
    """The same sequence number of a client on another key has taken effect; ids near 2^62 and null ids."""
    big = 2**62
    ops = [
        (1, "Put", "k", "A", big + 1, 0), (2, "Append", "k", "B", big + 1, 1), (3, "Append", "k", "B", big + 1, 1), (4, "Append", "k", "C", big + 2, 0), (5, "Put", "j", "Z", big + 2, 0),
        (6, "Get", "k", None, 3, 0), (7, "Append", "n", "1", None, 5), (8, "Append", "n", "1", None, 5), (9, "Append", "n", None, 4, None), (10, "Put", None, "x", 5, big),
        (11, "Put", "m", "late", 5, big - 1), (12, "Append", "k", "D", big + 1, big),
    ]
    got = streamed(spark, tmp_path, (ops[:4], ops[4:7], ops[7:]))
    assert got == {"k": "ABCD", "n": "11"}
    assert got == dict(kvlog.state(spark.createDataFrame(ops, LOG)).collect())


def test_snapshot_keeps_the_deduplication_table(spark, tmp_path):
    rng = random.Random(4)
    ops = [(i, rng.choice(["Put", "Append", "Append", "Get"]), rng.choice("abc"), f"{i};", rng.randrange(3), max(0, i // 2 - rng.choice([0, 0, 20]))) for i in range(300)]
    first, rest = spark.createDataFrame(ops[:140], LOG), spark.createDataFrame(ops[140:], LOG)
    kvlog.snapshot(kvlog.state(first), kvlog.applied_table(first), str(tmp_path / "snap"))
    assert dict(kvlog.resumed(*kvlog.restore(spark, str(tmp_path / "snap")), rest).collect()) == model(ops)


def test_vector_commands_as_a_stream(spark, tmp_path):
    from vecledger.streaming import vector_stream as v

    p = lambda i, x: (i, [x], None)
    log = [
        (1, "CollectionCreate", "c", None, None, None, None), (2, "VectorPut", "c", "a", [1.0], "{}", None), (3, "VectorBatchPut", "c", None, None, None, [p("b", 2.0), p("a", 3.0), p("b", 4.0)]),
        (4, "VectorDelete", "c", "a", None, None, None), (5, "VectorPut", "d", "x", [9.0], None, None), (6, "VectorSearch", "c", None, [1.0], None, None),
        (7, "CollectionDelete", "d", None, None, None, None), (8, "VectorPut", "d", "y", [1.0], None, None), (9, "VectorPut", "c", "a", [5.0], None, None), (10, "VectorBatchPut", "c", None, None, None, None),
        (11, "CollectionDelete", "c", None, None, None, None), (12, "CollectionCreate", "c", None, None, None, None), (13, "VectorPut", "c", "z", [7.0], None, None),
    ]
    source, path, check = (str(tmp_path / n) for n in ("in", "rows", "check"))
    for upto, want in ((6, {("c", "b"): [4.0], ("d", "x"): [9.0]}), (10, {("c", "b"): [4.0], ("c", "a"): [5.0]}), (13, {("c", "z"): [7.0]})):
        done = 0 if upto == 6 else 6 if upto == 10 else 10
        spark.createDataFrame(log[done:upto], v.COMMANDS).coalesce(1).write.mode("append").parquet(source)
        v.kept_in(spark.readStream.schema(v.COMMANDS).parquet(source), path, check).awaitTermination()
        written = spark.read.parquet(path)
        for rows in (written, written.unionByName(written)):  # a batch written twice
            assert {(r["collection"], r["id"]): list(r["values"]) for r in v.live_points(rows).collect()} == want


def test_shard_life_cycle(spark):
    c = shards.Controller()
    c.join({1: ["x"]})
    c.join({2: ["y"]})
    configs = c.frame(spark)
    at = shards.statuses(configs).where("num = 2")
    data = spark.createDataFrame([(1, k, "v" + k) for k in "0123456789"] + [(2, "stale", "s")], "gid int, key string, value string")
    assert {(r["gid"], r["shard"]) for r in shards.serves(at).collect()} == {(1, s) for s in range(5, 10)}
    asked = at.where("status = 'MoveIn'").select(F.col("gid").alias("to_gid"), F.lit(1).alias("from_gid"), "shard", "num")
    behind = spark.createDataFrame([(1, 1), (2, 2)], "gid int, num int")
    rows, late = shards.pulled(data, behind, asked)
    assert rows.count() == 0 and late.count() == 5
    current = spark.createDataFrame([(1, 2), (2, 2)], "gid int, num int")
    rows, late = shards.pulled(data, current, asked)
    assert late.count() == 0 and {r["shard"] for r in rows.collect()} == {0, 1, 2, 3, 4}
    assert shards.next_config(current, at, configs).count() == 0
    new, at = shards.installed(data, at, rows)
    assert {(r["gid"], r["shard"]) for r in shards.serves(at).collect()} == {(1, s) for s in range(5, 10)} | {(2, s) for s in range(5)}
    new, at = shards.garbage_collected(new, at)
    owner = {r["shard"]: r["gid"] for r in at.where("owned").collect()}
    kept = {(r["gid"], r["key"]) for r in new.collect()}
    assert kept == {(owner[ord(k) % 10], k) for k in "0123456789"} | {(2, "stale")}
    assert {r["status"] for r in at.collect()} == {"Normal"}


def test_index_files(spark, tmp_path):
    from vecledger.functions.distance import DistanceMetric
    from vecledger.operators import approximate as a
    from vecledger.operators.knn import knn
    from vecledger.plans.request import SearchStrategy

    rng = random.Random(1)
    points = spark.createDataFrame([(i, [rng.gauss(i % 5 * 4, 1) for _ in range(6)]) for i in range(400)], "id int, values array<double>").cache()
    cs = a.centroids(points, 8)
    a.save_index(a.with_cell(points, cs), cs, str(tmp_path / "index"))
    stored, back = a.load_index(spark, str(tmp_path / "index"))
    assert back == cs and stored.count() == 400
    hit = total = 0
    for q in range(0, 400, 40):
        v = list(points.where(f"id = {q}").first()["values"])
        exact = {r["id"] for r in knn(points, v, DistanceMetric.EUCLIDEAN, 10).collect()}
        hit += len(exact & {r["id"] for r in a.ivf_knn(stored, back, v, DistanceMetric.EUCLIDEAN, 10, SearchStrategy.DEFAULT).collect()})
        total += 10
    assert hit >= 0.9 * total
    assert a.ivf_knn(stored, back, v, DistanceMetric.EUCLIDEAN, 10, SearchStrategy.EXACT).count() == 10
    f = spark.range(1).select(a.fitness(F.lit(2.0), F.lit(0.9), F.lit(0.1), F.lit(0.2))).first()[0]
    assert f == pytest.approx(0.5 + 0.9 - 0.1 - 0.2)
