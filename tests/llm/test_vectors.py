import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from vecledger.llm import ivfpq, pivots
from vecledger.llm.queries_vectors import neighbour_pairs

WRITES = "collection_name string, vector_id string, vector_values array<float>, ts_ns bigint, deleted boolean, k string, h int"


def make(spark, copies=0):
    """Clusters, near copies, noise, versions, tombstones and unusable values."""
    rng = np.random.default_rng(6)
    rows = []
    for name, dim, groups in (("one", 24, 12), ("two", 17, 5), ("empty", 8, 0)):
        n = 0
        for g in range(groups):
            centre = rng.normal(size=dim)
            centre /= np.linalg.norm(centre)
            for _ in range(4 + 3 * g):
                v = centre + rng.normal(size=dim) * 0.3 / dim**0.5
                rows.append((name, f"{name}-{n:04d}", (v * rng.uniform(0.5, 3)).tolist(), 5, False))
                n += 1
                if rng.random() < 0.4:
                    rows.append((name, f"{name}-{n:04d}", (v + rng.normal(size=dim) * 0.002).tolist(), 5, False))
                    n += 1
        for _ in range(groups * 8):
            rows.append((name, f"{name}-{n:04d}", rng.normal(size=dim).tolist(), 5, False))
            n += 1
    rows += [(c, i, [-x for x in v], 3, False) for c, i, v, _, _ in rows[::7]]
    rows += [(c, i, None, 9, True) for c, i, _, _, _ in rows[3:60:11]]
    rows += rows[:20]
    rows += [("one", "bad-1", [float("nan")] * 24, 5, False), ("one", "bad-2", [0.0] * 24, 5, False), ("one", "bad-3", [1.0], 5, False), ("one", "bad-4", None, 5, False),
             ("none", "bad-5", [1.0], 5, False), (None, "bad-6", [1.0], 5, False), ("one", None, [1.0] * 24, 5, False), ("one", "bad-7", [1.0] * 24, None, None)]
    same = rng.normal(size=24).tolist()
    rows += [("one", f"same-{k:04d}", same, 5, False) for k in range(copies)]
    random.Random(1).shuffle(rows)
    writes = spark.createDataFrame([(*r, "x", 1) for r in rows], WRITES).repartition(4).cache()
    collections = spark.createDataFrame([("one", 24, "l2", "z"), ("two", 17, "dot", "z"), ("empty", 8, None, "z")], "collection_name string, dimension int, metric string, vector_id string")
    last = {}
    for r in rows:
        if r[1] is not None and (r[1] not in last or (r[3] or -1) > (last[r[1]][3] or -1)):
            last[r[1]] = r
    dims = {"one": 24, "two": 17, "empty": 8}
    live = {}
    for c, i, v, _, gone in last.values():
        if gone is False and v is not None and c in dims and len(v) == dims[c] and not np.isnan(v).any() and np.any(v):
            live.setdefault(c, {})[i] = np.array(v, np.float32).astype(float)
    return writes, collections, live


def brute(live):
    for points in live.values():
        ids = sorted(points)
        x = np.array([points[i] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        yield ids, x @ x.T


@pytest.mark.parametrize("copies", [0, 60])
def test_neighbours(spark, copies, monkeypatch):
    monkeypatch.setattr(ivfpq, "EXACT_ROWS", 100)
    monkeypatch.setattr(ivfpq, "QUERY_ELEMENTS", 24 * 300)
    monkeypatch.setattr(ivfpq, "REGION_ROWS", 400)
    writes, collections, live = make(spark, copies)
    expected = set()
    for ids, s in brute(live):
        for a in range(len(ids)):
            near = sorted((-round(s[a, b], 6), ids[b]) for b in range(len(ids)) if b != a and s[a, b] >= 0.98)
            expected |= {tuple(sorted((ids[a], i))) for _, i in near[:5]}
    got = {(r["id_a"], r["id_b"]) for r in neighbour_pairs(writes, collections, 0.98, 5).collect()}
    assert not got - expected
    assert len(got) >= 0.97 * len(expected) > 100


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_crowd_of_one_collection_elsewhere(spark, bits, monkeypatch):
    """A crowd's values in another collection, and rows that only the bit filter takes for surplus."""
    monkeypatch.setattr(ivfpq, "FILTER_BITS", bits)
    rng = np.random.default_rng(9)
    same = rng.normal(size=16)
    near = [same + rng.normal(size=16) * 0.01 for _ in range(3)]
    points = {"a": [*[same] * 40, *near], "b": [same, same, *near]}
    for name in points:
        for _ in range(30):
            v = rng.normal(size=16)
            points[name] += [v, v + rng.normal(size=16) * 0.01]
    live = {c: {f"{c}-{n:03d}": np.array(v, np.float32).astype(float) for n, v in enumerate(vs)} for c, vs in points.items()}
    rows = [(c, i, v.tolist(), 5, False, "x", 1) for c, of in live.items() for i, v in of.items()]
    collections = spark.createDataFrame([("a", 16), ("b", 16)], "collection_name string, dimension int")
    got = {tuple(r) for r in neighbour_pairs(spark.createDataFrame(rows, WRITES), collections, 0.98, 5).collect()}
    want = set()
    for ids, s in brute(live):
        for a in range(len(ids)):
            near = sorted((-round(s[a, b], 6), ids[b]) for b in range(len(ids)) if b != a and s[a, b] >= 0.98)[:5]
            want |= {(min(ids[a], b), max(ids[a], b)) for _, b in near}
    assert got == want


def test_no_vectors(spark):
    writes, collections, _ = make(spark)
    assert neighbour_pairs(writes.where("false"), collections, 0.98, 5).count() == 0
    assert pivots.clusters(writes.where("false"), collections).count() == 0
    assert neighbour_pairs(writes, collections.where("false"), 0.98, 5).count() == 0


@pytest.mark.parametrize("prefix", [16, 2048])
def test_clusters(spark, prefix, monkeypatch):
    monkeypatch.setattr(pivots, "LEAST_PREFIX", prefix)
    monkeypatch.setattr(pivots, "MOST_PREFIX", prefix)
    monkeypatch.setattr(pivots, "SMALL", 100)
    writes, collections, live = make(spark, 30)
    expected = set()
    for ids, s in brute(live):
        left = set(range(len(ids)))
        while left:
            a = min(left)
            group = [b for b in left if s[a, b] >= 0.75]
            left -= set(group)
            if len(group) >= 5:
                expected.add(tuple(sorted(ids[b] for b in group)))
    members = pivots.clusters(writes, collections).cache()
    by = {}
    for r in members.collect():
        by.setdefault(r["pivot"], []).append(r["vector_id"])
    got = {tuple(sorted(v)) for v in by.values()}
    assert len(got & expected) >= (len(expected) if prefix > 100 else 0.9 * len(expected)) and len(expected) > 10
    described = pivots.typical_members(writes, members).collect()
    assert {(r["cluster_id"], r["size"]) for r in described} == {(v[0], len(v)) for v in got}
    assert all(1 <= len(r["typical_ids"]) <= 3 for r in described)


def found_clusters(spark, points):
    """{pivot: ids} of one collection of points."""
    rows = [("c", f"{n:04d}", v.tolist(), 5, False, "x", 1) for n, v in enumerate(points)]
    collections = spark.createDataFrame([("c", points.shape[1])], "collection_name string, dimension int")
    by = {}
    for r in pivots.clusters(spark.createDataFrame(rows, WRITES), collections).collect():
        by.setdefault(r["pivot"], []).append(int(r["vector_id"]))
    return by


@pytest.mark.parametrize("prefix", [16, 2048])
def test_clusters_are_mutual(spark, prefix, monkeypatch):
    """Elongated groups: arcs on which rows are similar to a pivot and not to each other."""
    monkeypatch.setattr(pivots, "LEAST_PREFIX", prefix)
    monkeypatch.setattr(pivots, "MOST_PREFIX", prefix)
    monkeypatch.setattr(pivots, "PAIR_ROWS", 8)
    rng = np.random.default_rng(4)
    points = []
    for _ in range(12):
        u, v = np.linalg.qr(rng.normal(size=(40, 2)))[0].T
        points += [np.cos(t) * u + np.sin(t) * v for t in np.linspace(0, 2.0, 30)]
    x = np.array(points).astype(np.float32).astype(float)
    by = found_clusters(spark, x)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    assert min(len(ids) for ids in by.values()) >= 5
    assert all((s[np.ix_(ids, ids)] >= 0.75).all() for ids in by.values())
    # an arc of 2.0 holds two to four such groups, which take nearly all rows
    listed = sum(len(ids) for ids in by.values())
    assert listed == len({i for ids in by.values() for i in ids}) >= 0.8 * len(x)


def test_cells_keep_pairs_at_the_threshold(spark, monkeypatch):
    """All pairs of a cluster are a little above the threshold, less than 8 bits resolve."""
    monkeypatch.setattr(pivots, "LEAST_PREFIX", 16)
    monkeypatch.setattr(pivots, "MOST_PREFIX", 16)
    rng = np.random.default_rng(8)
    x = []
    for _ in range(40):
        q = np.linalg.qr(rng.normal(size=(64, 9)))[0].T
        x += [0.7502**0.5 * q[0] + 0.2498**0.5 * v for v in q[1:]]
    by = found_clusters(spark, np.array(x))
    assert {tuple(sorted(ids)) for ids in by.values()} == {tuple(range(n, n + 8)) for n in range(0, 320, 8)}


def planted(seed, dim, sizes, noise):
    """Separated clusters, any two of a cluster with a cosine near 0.9, and rows in none."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    parts = [unit(rng.normal(size=dim))[None] + 0.33 * unit(rng.normal(size=(n, dim))) for n in sizes]
    return np.concatenate([*parts, rng.normal(size=(noise, dim))]).astype(np.float32).astype(float)


def test_batches_do_not_matter(spark, monkeypatch):
    """Rows with and without a pivot share Arrow batches, several a partition; cells and
    clusters are cut into blocks; brute force gives the same clusters."""
    monkeypatch.setattr(pivots, "SMALL", 100)
    monkeypatch.setattr(pivots, "LEAST_PREFIX", 600)
    monkeypatch.setattr(pivots, "MOST_PREFIX", 600)
    x = planted(3, 32, [400, 150, *range(5, 45)], 2600)
    s = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = s @ s.T >= 0.75
    first = near.argmax(1)
    expected = {tuple(np.flatnonzero(first == f).tolist()) for f in np.unique(first) if (first == f).sum() >= 5}
    assert len(expected) == 42
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, rows in ((100, 16384), (100, 64), (1000, 16384), (10000, 64)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            monkeypatch.setattr(pivots, "PAIR_ROWS", rows)
            monkeypatch.setattr(pivots, "CELL_ROWS", max(rows // 2, 40))
            assert {tuple(sorted(ids)) for ids in found_clusters(spark, x).values()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_touching_clusters_keep_their_rows(spark, monkeypatch):
    """Two clusters that touch: rows between them end in the closer one they fit, none that fits is dropped."""
    monkeypatch.setattr(pivots, "SMALL", 10)
    rng = np.random.default_rng(12)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    centre = lambda t: np.cos(t) * q[0] + np.sin(t) * q[1]
    points = [centre(t) + 0.02 * rng.normal(size=24) / 24**0.5 for t in np.concatenate([rng.uniform(-0.3, 0.28, 60), rng.uniform(0.5, 1.1, 60)])]
    x = np.array(points).astype(np.float32).astype(float)
    by = found_clusters(spark, x)
    s = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = s @ s.T
    assert all((s[np.ix_(ids, ids)] >= 0.75).all() for ids in by.values())
    listed = {i for ids in by.values() for i in ids}
    for i in set(range(len(x))) - listed:
        assert not any((s[i, ids] >= 0.75).all() for ids in by.values())
    assert len(listed) >= 0.95 * len(x)


def test_expelled_are_the_later():
    at = np.deg2rad([0, 10, 20, 30, 38, 44])
    pdf = pd.DataFrame({"k": range(6), "pivot": 7, "vector_values": [np.array([np.cos(t), np.sin(t)]) for t in at], "late": [False] * 5 + [True], "angle": abs(at - at.mean())})
    assert pivots.expelled(pdf, 0.75)["k"].tolist() == [5]
    pdf["own"] = True
    assert pivots.violating(pdf, 0.75)["k"].tolist() == [0, 5]


def test_settle_is_sequential():
    rng = np.random.default_rng(2)
    x = ivfpq.unit_rows(rng.normal(size=(300, 5)))
    got = pivots.settle(x, 0.75, block=37)
    expected, chosen = [], []
    for i, row in enumerate(x):
        p = next((c for c in chosen if x[c] @ row >= 0.75), None)
        if p is None:
            chosen.append(i)
            p = i
        expected.append(p)
    assert got.tolist() == expected


def shown(model, x, k):
    """{row: [(cosine, other)]} of one region's search among all rows."""
    home = (x @ model["c"].T).argmax(1)
    h = np.arange(len(x))
    block = ivfpq.Block(model, 0, k, h, x, home)
    for at in np.unique(home):
        block.show(int(at), h[home == at], x[home == at])
    found = {}
    for me, other, near in zip(*(v.tolist() for v in block.result()), strict=True):
        found.setdefault(me, []).append((near, other))
    return found, block


def test_index_recall(monkeypatch):
    """Recall of the index alone for the five nearest of clustered and of isolated rows."""
    monkeypatch.setattr(ivfpq, "EXACT_ROWS", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    x = ivfpq.unit_rows(np.concatenate([rng.normal(size=(3000, 32)), np.repeat(centres, 100, 0) + rng.normal(size=(2000, 32)) * 0.3]))
    model = ivfpq.fit(x[rng.permutation(len(x))[:1500]], len(x))
    assert len(model["c"]) > 30
    found, _ = shown(model, x, 5)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hit = [len({o for _, o in sorted(found[i], reverse=True)[:5]} & set(np.argsort(-s[i])[:5].tolist())) / 5 for i in range(len(x))]
    assert np.mean(hit[:3000]) >= 0.85 and np.mean(hit[3000:]) >= 0.95 and np.mean(hit) >= 0.9


def test_dense_copies_stay_bounded(monkeypatch):
    """Thousands of near copies of each other: a bounded number of candidates a row, all of them as near as the best."""
    monkeypatch.setattr(ivfpq, "EXACT_ROWS", 100)
    rng = np.random.default_rng(3)
    x = ivfpq.unit_rows(np.concatenate([rng.normal(size=32) + rng.normal(size=(2000, 32)) * 0.02, rng.normal(size=(500, 32))]))
    found, _ = shown(ivfpq.fit(x, len(x)), x, 5)
    assert max(map(len, found.values())) <= ivfpq.KEPT
    s = x @ x.T
    np.fill_diagonal(s, -2)
    fifth = -np.sort(-s, axis=1)[:, 4]
    assert np.mean([sorted(found[i], reverse=True)[4][0] >= fifth[i] - 1e-3 for i in range(2000)]) >= 0.95


def test_nearest_of_isolated_rows(spark):
    """Vectors without near copies have neighbours too; queries can be chosen; copies share theirs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 12)).astype(np.float32).astype(float)
    x[100:112] = x[100]
    rows = [("c", f"{n:04d}", v.tolist(), 5, False, "x", 1) for n, v in enumerate(x)]
    collections = spark.createDataFrame([("c", 12)], "collection_name string, dimension int")
    writes = spark.createDataFrame(rows, WRITES)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(i, rank + 1): o for i in range(150) for rank, o in enumerate(sorted((o for o in range(150) if o != i), key=lambda o: (-s[i, o], o))[:4])}
    got = {(int(r["me"]), r["rank"]): int(r["other"]) for r in ivfpq.nearest(writes, collections, 4).collect()}
    near_ties = [key for key in want if got.get(key) != want[key]]
    assert set(got) == set(want) and all(abs(s[k[0], got[k]] - s[k[0], want[k]]) <= 1e-6 for k in near_ties) and len(near_ties) < 6
    some = {(int(r["me"]), r["rank"]): int(r["other"]) for r in ivfpq.nearest(writes, collections, 4, asks=lambda v: v.endswith("1")).collect()}
    assert some == {k: v for k, v in got.items() if k[0] % 10 == 1}


def test_blocks_of_visitors_stay_bounded(monkeypatch):
    """A region with many more visitors than rows: blocks are bounded, also when the rows lie in a file, and all are answered."""
    rng = np.random.default_rng(8)
    x = ivfpq.unit_rows(rng.normal(size=(5400, 8)))
    x[1] = x[0]
    h, role = np.arange(len(x)), np.where(np.arange(len(x)) < 400, ivfpq.BOTH, ivfpq.QUERY)
    h[1] = 0  # repeated in the table
    small = [pa.array(np.zeros(len(x), np.int32)) for _ in range(2)]
    columns = [pa.array(np.full(len(x), 5)), *small, pa.array(role.astype(np.int32)), small[0], pa.array(h), pa.array([v.tobytes() for v in ivfpq.sixteen(x)], pa.binary())]
    shipped = pa.RecordBatch.from_arrays(columns, schema=ivfpq.SHIPPED)
    sizes, made = [], ivfpq.Block.__init__
    monkeypatch.setattr(ivfpq.Block, "__init__", lambda self, model, region, k, h, *rest: (sizes.append(len(h)), made(self, model, region, k, h, *rest))[1])
    monkeypatch.setattr(ivfpq, "BLOCK_ELEMENTS", 8 * 200)
    answers = []
    for most in (1 << 25, 100):
        monkeypatch.setattr(ivfpq, "HELD_ELEMENTS", most)
        found = {}
        for batch in ivfpq.searched(iter([shipped.slice(s, 300) for s in range(0, len(x), 300)]), {}, 5, -1.0):
            for _, me, other, near in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found.setdefault(me, []).append((-near, other))
        answers.append({me: [o for _, o in sorted(of)[:5]] for me, of in found.items()})
    assert max(sizes) <= 300 + 200
    assert answers[0] == answers[1] and set(range(2, 400)) <= set(answers[0])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    s[:, 1] = -2
    assert np.mean([answers[0][i] == np.argsort(-s[i, :400])[:5].tolist() for i in range(2, 400)]) >= 0.99
    # visitors are bounded by each other: they find what is among the nearest of all
    near = [(i, o) for i in range(400, len(x)) for o in np.argsort(-s[i])[:5].tolist() if o < 400]
    assert len(near) > 1000 and np.mean([o in answers[0].get(i, []) for i, o in near]) >= 0.99


def test_fit_is_bounded():
    """The products of a sample with its centroids are never held at once."""
    x = np.random.default_rng(4).normal(size=(16000, 8)).astype(np.float32)
    tracemalloc.start()
    model = ivfpq.fit(x, 4_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model["c"]) == 1000 and peak < 16000 * 1000 * 4


def test_pairs_are_compared_once(spark, monkeypatch):
    """A pair that one of the two has found counts for both."""
    x = np.random.default_rng(2).normal(size=(12, 8))
    writes = spark.createDataFrame([("c", f"{n:02d}", v.tolist(), 5, False, "x", 1) for n, v in enumerate(x)], WRITES)
    collections = spark.createDataFrame([("c", 8)], "collection_name string, dimension int")
    every = ivfpq.candidates
    monkeypatch.setattr(ivfpq, "candidates", lambda *a: every(*a).where("me < other"))
    got = ivfpq.nearest(writes, collections, 11).collect()
    assert len({(r["me"], r["other"]) for r in got}) == len(got) == 12 * 11
