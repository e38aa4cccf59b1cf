"""Clusters of mutually similar vectors by parallel pivot correlation clustering.

Rows have a random order (a hash). A row that no earlier row resembles, a local minimum,
is a pivot and absorbs its similar neighbours. The prefix of the order, a bounded sample of
each collection, is settled first, its members move to the closest pivot and the pivots
become the centres of their members, twice over. The centres are sent to all tasks, and
every row joins the closest one it resembles where it lies. However large a cluster is, its
rows end here. The others go to the cells of their NEAREST closest centres, where each
links itself to the earliest row it resembles; pivots that share a row hand on to the
earliest of them, the rows of one such group are settled, moved to the closest medoid and
the medoids recomputed, in one task. Collections of at most SMALL rows are one cell.

Rows travel in 8 bits an element with the norm of their rounding error, so a product of
two of them bounds their cosine from both sides. Pairs that the angles to the centre or
these bounds do not prove to have the threshold are compared in DOUBLE on the stored values.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecledger.functions.distance import cosine_similarity
from vecledger.llm.ivfpq import FILTER_BITS, bit_filter, bit_table, in_table, unit_rows
from vecledger.llm.topn import top_n
from vecledger.operators.liverows import live_keys
from vecledger.sources.tables import written

SMALL, LEAST_PREFIX, MOST_PREFIX, ALL_PREFIXES = 2048, 2048, 8192, 1 << 17
NEAREST = 6
CELL_ROWS, PAIR_ROWS = 8192, 16384
FLOAT_ROUNDING, ANGLE_ROUNDING = 1e-6, 1e-3
ASKED_MOST = 4096
SHIPPED = pa.schema([
    ("c", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("block", pa.int32()), ("later", pa.int32()), ("turn", pa.float32()),
    ("k", pa.int64()), ("error", pa.float32()), ("body", pa.binary()),
])
SHIPPED_DDL = "c bigint, kind int, at bigint, block int, later int, turn float, k bigint, error float, body binary"
MEMBER, VISIT, GROUP = 0, 1, 2
LOST = 4.0  # no angle: a row that left its group


def settle(x: np.ndarray, threshold: float, block: int = 512) -> np.ndarray:
    """Position of the pivot of each row; rows are unit vectors in order, earliest first.

    The same as absorbing one local minimum after another, done block by block.
    """
    pivot = np.full(len(x), -1)
    left = np.arange(len(x))
    while len(left):
        head = left[:block]
        near = x[head] @ x[head].T >= threshold
        pivots, taken = [], np.zeros(len(head), dtype=bool)
        for i in range(len(head)):
            if not taken[i]:
                pivots.append(i)
                taken |= near[i]
        chosen = head[pivots]
        for s in range(0, len(left), 8192):
            part = left[s : s + 8192]
            similar = x[part] @ x[chosen].T >= threshold
            hit = similar.any(1)
            pivot[part[hit]] = chosen[similar[hit].argmax(1)]
        pivot[chosen] = chosen
        left = left[pivot[left] < 0]
    return pivot


def recentred(x: np.ndarray, pivot: np.ndarray, threshold: float, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivots, centres, row's place among them or -1) after `rounds` times moving every row
    to the closest centre, if it has the threshold with it, and recomputing the centres."""
    names, place = np.unique(pivot, return_inverse=True)
    centres = x[names]
    for n in range(rounds + 1):
        sums = np.zeros(centres.shape, np.float64)
        mine = place >= 0
        np.add.at(sums, place[mine], x[mine])
        some = np.bincount(place[mine], minlength=len(names)) > 0
        centres = centres.copy()
        centres[some] = unit_rows(sums[some])
        if n < rounds:
            sims = x @ centres.T
            place = sims.argmax(1)
            place[sims[np.arange(len(x)), place] < threshold] = -1
    return names, centres, place


def shrunk(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows in the direction of unit rows, and the norm of what that rounds off."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    scale[scale == 0] = 1
    small = np.round(x / scale).astype(np.int8)
    return small, np.linalg.norm(x - unit_rows(small), axis=1).astype(np.float32) + np.float32(1e-6)


def train(pdf: pd.DataFrame, rate: float, threshold: float) -> dict:
    """Centres and pivots of a prefix, and the blocks that cells and clusters need."""
    pdf = pdf.drop_duplicates("k").sort_values("k")
    x = unit_rows(np.stack(pdf["vector_values"].to_numpy()))
    names, centres, place = recentred(x, settle(x, threshold), threshold)
    size = np.bincount(place[place >= 0], minlength=len(names))
    alone = np.flatnonzero((place < 0) | (size[place] == 1))
    few = min(NEAREST, len(names))
    cells = np.argpartition(-(x[alone] @ centres.T), few - 1, axis=1)[:, :few].ravel() if len(alone) else np.zeros(0, int)
    visits = np.bincount(cells, minlength=len(names))
    blocks = lambda n, most: np.maximum(1, np.ceil(n / rate / most)).astype(np.int32)
    return {"x": centres, "k": pdf["k"].to_numpy()[names], "cells": blocks(visits, CELL_ROWS), "members": blocks(size, PAIR_ROWS)}


def prefix_models(rows: DataFrame, counts: dict[int, int], threshold: float) -> dict[int, dict]:
    """Models of collections {c: number of rows}; at most MOST_PREFIX rows a collection and
    ALL_PREFIXES in all, expected, are sampled."""
    want = {c: min(float(np.clip(8 * n**0.5, LEAST_PREFIX, MOST_PREFIX)), n) for c, n in counts.items()}
    fit = min(1.0, ALL_PREFIXES / max(1.0, sum(want.values())))
    rates = {c: max(w * fit, 64.0) / counts[c] for c, w in want.items()}
    if not rates:
        return {}
    sent = rows.sparkSession.sparkContext.broadcast(rates)

    @F.pandas_udf("boolean")
    def drawn(c: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(k.to_numpy() % (1 << 20) < c.map(sent.value).fillna(0.0).to_numpy() * (1 << 20))

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["c"].iloc[0])
        return pd.DataFrame({"c": [c], "model": [pickle.dumps(train(pdf, min(1.0, sent.value[c]), threshold))]})

    found = rows.where(drawn("c", "k")).groupBy("c").applyInPandas(fitted, "c bigint, model binary").collect()
    return {r[0]: pickle.loads(r[1]) for r in found}


def rows_of(batch: pa.RecordBatch, some: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(c, k, unit rows) of the rows `some` of a batch (c, k, vector_values), by collection and length."""
    c, k = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    lists = batch.column(2)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
    size = np.diff(starts)
    at = np.arange(len(k)) if some is None else np.flatnonzero(some)
    for key in np.unique(np.column_stack([c[at], size[at]]), axis=0).tolist() if len(at) else []:
        mine = at[(c[at] == key[0]) & (size[at] == key[1])]
        for s in range(0, len(mine), 2048):
            part = mine[s : s + 2048]
            yield key[0], k[part], unit_rows(flat[starts[part][:, None] + np.arange(key[1])])


def shipped(c: int, kind: int, at: np.ndarray, blocks: np.ndarray, k: np.ndarray, turn: np.ndarray, small: np.ndarray, error: np.ndarray) -> pa.RecordBatch:
    """Rows to their places; of `blocks` blocks of a place, each has all rows and owns some."""
    n = len(k)
    each = np.repeat(np.arange(n), blocks)
    block = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = k.view(np.uint64)[each] // np.uint64(64) % blocks[each].astype(np.uint64) == block.astype(np.uint64)
    width = small.shape[1]
    offsets = pa.py_buffer((np.arange(len(each) + 1, dtype=np.int32) * width).tobytes())
    body = pa.Array.from_buffers(pa.binary(), len(each), [None, offsets, pa.py_buffer(small[each].tobytes())])
    columns = [np.full(len(each), c), np.full(len(each), kind, np.int32), at[each], block.astype(np.int32), (~own).astype(np.int32), turn[each].astype(np.float32), k[each], error[each]]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), body], schema=SHIPPED)


def sent(rows: DataFrame, models: dict[int, dict], wanted: np.ndarray | None, threshold: float) -> DataFrame:
    """SHIPPED rows of `rows` (c, k, vector_values): members of centres, visits of cells."""
    spark = rows.sparkSession.sparkContext
    models, wanted = spark.broadcast(models), spark.broadcast(wanted)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = None if wanted.value is None else in_table(wanted.value, batch.column(1).to_numpy())
            for c, k, x in rows_of(batch, some):
                model = models.value.get(c)
                small, error = shrunk(x)
                one = np.ones(len(k), np.int32)
                if model is None:
                    yield shipped(c, VISIT, np.zeros(len(k), np.int64), one, k, one, small, error)
                    continue
                if model["x"].shape[1] != x.shape[1]:
                    continue
                sims = x @ model["x"].T
                best = sims.argmax(1)
                top = sims[np.arange(len(x)), best]
                hit = np.flatnonzero(top >= threshold - FLOAT_ROUNDING)
                if len(hit):
                    angle = np.arccos(np.clip(top[hit], -1, 1))
                    yield shipped(c, MEMBER, model["k"][best[hit]], model["members"][best[hit]], k[hit], -angle, small[hit], error[hit])
                rest = np.flatnonzero(top < threshold - FLOAT_ROUNDING)
                if len(rest):
                    few = min(NEAREST, sims.shape[1])
                    cells = np.argpartition(-sims[rest], few - 1, axis=1)[:, :few].ravel()
                    each = np.repeat(rest, few)
                    first = np.arange(len(each)) % few == 0
                    yield shipped(c, VISIT, cells, model["cells"][cells], k[each], first, small[each], error[each])

    return rows.select("c", "k", "vector_values").mapInArrow(near, SHIPPED_DDL)


class Place:
    """The owned rows of one place and block, to which the other rows are shown in parts."""

    def __init__(self, key: tuple[int, int, int, int], k: np.ndarray, turn: np.ndarray, x: np.ndarray, error: np.ndarray, threshold: float):
        self.key, self.threshold = key, threshold
        if key[1] == VISIT:  # in order of k, each once
            k, first = np.unique(k, return_index=True)
            turn, x, error = turn[first], x[first], error[first]
        self.k, self.angle, self.x, self.error = k, -turn, x, error
        self.unproven = np.zeros(len(k), bool)
        self.earliest, self.met = k.copy(), np.zeros(len(k), bool)
        if key[1] != GROUP:
            self.show(k, self.angle, x, error, own=True)

    def show(self, k: np.ndarray, angle: np.ndarray, x: np.ndarray, error: np.ndarray, own: bool = False) -> None:
        slack = float(self.error.max() + error.max())
        if self.key[1] == MEMBER:
            limit = np.arccos(self.threshold) - ANGLE_ROUNDING
            mine = np.flatnonzero(self.angle + angle.max() > limit)
            theirs = np.flatnonzero(angle + self.angle.max() > limit)
            for s in range(0, len(mine), 1024):
                for t in range(0, len(theirs), 4096):
                    self.unproven[mine[s : s + 1024]] |= (self.x[mine[s : s + 1024]] @ x[theirs[t : t + 4096]].T < self.threshold + slack).any(1)
            return
        order = np.argsort(k, kind="stable")
        for t in range(0, len(k), 4096):
            part = order[t : t + 4096]
            for s in range(0, len(self.k), 1024):
                near = self.x[s : s + 1024] @ x[part].T >= self.threshold - slack
                found = np.where(near.any(1), k[part][near.argmax(1)], self.k[s : s + 1024])
                self.earliest[s : s + 1024] = np.minimum(self.earliest[s : s + 1024], found)
                if own:  # each row resembles itself
                    at = np.searchsorted(part, np.arange(s, s + len(near)))
                    inside = np.flatnonzero((at < len(part)) & (part[np.minimum(at, len(part) - 1)] == np.arange(s, s + len(near))))
                    near[inside, at[inside]] = False
                self.met[s : s + 1024] |= near.any(1)


LINKS = pa.schema([("c", pa.int64()), ("kind", pa.int32()), ("k", pa.int64()), ("pivot", pa.int64()), ("unproven", pa.bool_()), ("angle", pa.float32()), ("error", pa.float32()), ("body", pa.binary())])
LINKS_DDL = "c bigint, kind int, k bigint, pivot bigint, unproven boolean, angle float, error float, body binary"


def links(c: int, kind: int, k: np.ndarray, pivot: np.ndarray, unproven: np.ndarray, angle: np.ndarray, error: np.ndarray | None, small: np.ndarray | None) -> pa.RecordBatch:
    n = len(k)
    body = pa.nulls(n, pa.binary()) if small is None else pa.array([r.tobytes() for r in small], pa.binary())
    lost = pa.nulls(n, pa.float32()) if error is None else pa.array(error)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, c)), pa.array(np.full(n, kind, np.int32)), pa.array(k), pa.array(pivot), pa.array(unproven), pa.array(angle.astype(np.float32)), lost, body], schema=LINKS)


def linked(place: Place) -> pa.RecordBatch:
    c, kind, at, _ = place.key
    if kind == MEMBER:
        return links(c, kind, place.k, np.full(len(place.k), at), place.unproven, place.angle, None, None)
    # the body of a row comes from its first cell only
    first = place.angle < 0
    some = place.met & ~first
    small, error = shrunk(place.x[first])
    return pa.concat_batches([
        links(c, kind, place.k[some], place.earliest[some], place.unproven[some], place.angle[some], None, None),
        links(c, kind, place.k[first], place.earliest[first], place.unproven[first], place.angle[first], place.error[first] + error, small),
    ])


def by_place(batches: Iterator[pa.RecordBatch], threshold: float, done: Callable[[Place], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """done(place) of every place and block of sorted SHIPPED rows."""
    held: tuple | None = None
    place: Place | None = None
    waiting: list[tuple] = []

    def built() -> Place:
        return Place(held, *(np.concatenate(parts) for parts in zip(*waiting, strict=True)), threshold)

    for batch in batches:
        c, kind, at, block, later, turn, k, error = (batch.column(i).to_numpy() for i in range(8))
        offsets = np.frombuffer(batch.column(8).buffers()[1], np.int32)[batch.column(8).offset :]
        raw = batch.column(8).buffers()[2]
        change = (c[1:] != c[:-1]) | (kind[1:] != kind[:-1]) | (at[1:] != at[:-1]) | (block[1:] != block[:-1]) | (later[1:] != later[:-1])
        edges = np.flatnonzero(change) + 1
        for a, b in zip([0, *edges], [*edges, len(k)], strict=True):
            if a == b:
                continue
            key = (int(c[a]), int(kind[a]), int(at[a]), int(block[a]))
            if key != held:
                if waiting or place is not None:
                    out = done(place or built())
                    if out.num_rows:
                        yield out
                held, place, waiting = key, None, []
            x = unit_rows(np.frombuffer(raw, np.int8, offsets[b] - offsets[a], offsets[a]).reshape(b - a, -1))
            if later[a]:
                if place is None and waiting:
                    place, waiting = built(), []
                if place is not None:
                    place.show(k[a:b], -turn[a:b], x, error[a:b])
            else:
                waiting.append((k[a:b], turn[a:b], x, error[a:b]))
    if waiting or place is not None:
        out = done(place or built())
        if out.num_rows:
            yield out


def placed(rows: DataFrame, threshold: float, done: Callable[[Place], pa.RecordBatch]) -> DataFrame:
    """LINKS of SHIPPED rows; each place and block comes sorted, own rows first, wide angles first."""
    order = ["c", "kind", "at", "block"]
    return rows.repartition(*order).sortWithinPartitions(*order, "later", "turn").mapInArrow(lambda batches: by_place(batches, threshold, done), LINKS_DDL)


def roots(met: DataFrame) -> DataFrame:
    """(pivot, root): rows and pivots that met, directly or by others, have one root, the earliest.

    met: (k, pivot), pivot <= k. Roots only fall, by jumps over jumps, so the rounds are logarithmic.
    """
    lows = written(met.groupBy("k").agg(F.min("pivot").alias("low")))
    ways = met.join(lows, "k").select("pivot", "low").unionByName(lows.select(F.col("k").alias("pivot"), "low"))
    edges = written(ways.groupBy("pivot").agg(F.min("low").alias("root")))
    while True:
        up = edges.select(F.col("pivot").alias("root"), F.col("root").alias("up")).where("up < root")
        moved = edges.join(up, "root").select("pivot", "up")
        if moved.isEmpty():
            return edges
        edges = written(edges.join(moved, "pivot", "left").select("pivot", F.coalesce("up", "root").alias("root")))


def regrouped(place: Place) -> pa.RecordBatch:
    """LINKS of the rows of one group: settled, moved to the closest medoid, proven or not."""
    k, first = np.unique(place.k, return_index=True)
    x, error, threshold = place.x[first], place.error[first], place.threshold
    slack = 2 * float(error.max())
    names, centres, at = recentred(x, settle(x, threshold - slack), threshold - slack)
    unproven, angle, pivot = np.zeros(len(k), bool), np.zeros(len(k)), np.full(len(k), -1)
    for n in range(len(names)):
        mine = np.flatnonzero(at == n)
        if not len(mine):
            continue
        to = x[mine] @ centres[n]
        pivot[mine] = k[mine[to.argmax()]]  # the medoid
        angle[mine] = np.arccos(np.clip(to, -1, 1))
        for s in range(0, len(mine), 1024):
            unproven[mine[s : s + 1024]] = (x[mine[s : s + 1024]] @ x[mine].T < threshold + slack).any(1)
    lost = at < 0
    pivot[lost], unproven[lost], angle[lost] = k[lost], True, LOST
    return links(place.key[0], GROUP, k, pivot, unproven, angle, None, None)


def assigned(rows: DataFrame, counts: dict[int, int], wanted: np.ndarray | None, threshold: float, least: int) -> DataFrame:
    """(k, pivot, unproven, angle): rows that resemble a pivot, each with one.

    unproven rows may be below the threshold with another unproven row of their pivot.
    Links and groups of fewer than `least` rows end here.
    """
    models = prefix_models(rows if wanted is None else rows.where(tested(rows, wanted)(F.col("k"))), {c: n for c, n in counts.items() if n > SMALL}, threshold)
    found = written(placed(sent(rows, models, wanted, threshold), threshold, linked))
    met = found.where(F.col("kind") == VISIT)
    # rows that met no other are their own roots
    tops = roots(met.where(F.col("pivot") < F.col("k")).select("k", "pivot").distinct())
    groups = tops.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("root")
    labels = written(tops.join(groups, "root").select(F.col("pivot").alias("k"), "root"))
    zero = F.lit(0)
    whole = met.where("body is not null").select("c", "k", "error", "body").join(labels, "k").select(
        "c", F.lit(GROUP).alias("kind"), F.col("root").alias("at"), zero.alias("block"), zero.alias("later"), zero.cast("float").alias("turn"), "k", "error", "body")
    both = placed(whole, threshold, regrouped).unionByName(found.where(F.col("kind") == MEMBER))
    return both.select("k", "pivot", "unproven", "angle").dropDuplicates(["k"])


def tested(rows: DataFrame, wanted: np.ndarray):
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        return pd.Series(in_table(shared.value, s.to_numpy()))

    return maybe


def violating(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows (k, pivot) of a block that have less than the threshold with a row of the cluster."""
    x = np.stack(pdf["vector_values"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mine = np.flatnonzero(pdf["own"].to_numpy())
    bad = np.zeros(len(mine), dtype=bool)
    for s in range(0, len(mine), 512):
        for t in range(0, len(x), 4096):
            bad[s : s + 512] |= (x[mine[s : s + 512]] @ x[t : t + 4096].T < threshold).any(1)
    return pdf.iloc[mine[bad]][["k", "pivot"]]


def expelled(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows (k, pivot) to leave out so that all others have the threshold with each other.

    Rows are taken in order of `late` and the angle to the centre if similar to all taken."""
    pdf = pdf.sort_values(["late", "angle", "k"])
    x = np.stack(pdf["vector_values"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = np.zeros(len(x), dtype=bool)
    for s in range(0, len(x), 512):
        block = x[s : s + 512]
        for t in range(0, s, 4096):
            e = min(s, t + 4096)
            out[s : s + 512] |= (block @ x[t:e][~out[t:e]].T < threshold).any(1)
        near = block @ block.T >= threshold
        for i in range(len(block)):
            if not out[s + i]:
                out[s + i + 1 : s + 512] |= ~near[i, i + 1 :]
    return pdf.loc[out, ["k", "pivot"]]


def misfits(members: DataFrame, vectors_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(k) of the unproven members (k, pivot, angle, late) to leave out so that any two of a
    cluster have the threshold in DOUBLE: blocks of PAIR_ROWS of them are compared with all of
    them, and of those in a pair below it `expelled` chooses."""
    some = written(members.where("unproven").select("k", "pivot", "angle", "late"))
    if some.isEmpty():
        return some.select("k")
    some = written(some.join(vectors_of(some.select("k")), "k"))
    blocks = some.groupBy("pivot").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("blocks"))
    rows = some.join(blocks, "pivot").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("own", F.pmod("k", "blocks") == F.col("block"))
    pairs = rows.select("k", "pivot", "vector_values", "block", "own").groupBy("pivot", "block")
    bad = written(pairs.applyInPandas(lambda pdf: violating(pdf, threshold), "k bigint, pivot bigint"))
    if bad.isEmpty():
        return bad.select("k")
    tests = some.join(bad.select("k"), "k", "left_semi")
    return written(tests.groupBy("pivot").applyInPandas(lambda pdf: expelled(pdf, threshold), "k bigint, pivot bigint").select("k"))


def large(members: DataFrame, least: int) -> DataFrame:
    return members.join(members.groupBy("pivot").count().where(F.col("count") >= least).select("pivot"), "pivot", "left_semi")


def means(members: DataFrame) -> DataFrame:
    """(pivot, mean): sum of the unit vectors of each cluster (pivot, vector_values), combined before the shuffle."""
    parts = members.select("pivot", F.col("vector_values").cast("array<double>").alias("mean"))
    return parts.mapInArrow(summed(True), parts.schema).repartition("pivot").mapInArrow(summed(False), parts.schema)


def readmitted(found: DataFrame, gone: DataFrame, vectors_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(k, pivot) of rows of `gone` (k, c) that join the closest cluster of `found` (k, pivot, c)
    with all of which they have the threshold.

    The mean of such a cluster has the threshold too, so only those clusters are compared.
    """
    members = written(found.join(vectors_of(found.select("k")), "k"))
    centre = written(means(members).join(members.select("pivot", "c").distinct(), "pivot"))
    asked = gone.join(vectors_of(gone.select("k")), "k")
    near = asked.join(centre, "c").withColumn("cosine", cosine_similarity(F.col("vector_values"), F.col("mean")))
    near = written(near.where(F.col("cosine") >= threshold - FLOAT_ROUNDING).select("k", "pivot", "cosine", F.col("vector_values").alias("mine")))
    least_cosine = F.min(cosine_similarity(F.col("vector_values"), F.col("mine")))
    fits = near.join(members.select("pivot", "vector_values"), "pivot").groupBy("k", "pivot", "cosine").agg(least_cosine.alias("least")).where(F.col("least") >= threshold)
    best = written(fits.groupBy("k").agg(F.max(F.struct("cosine", "pivot")).alias("best")).select("k", "best.pivot"))
    if best.isEmpty():
        return best
    # those that joined one cluster are compared with each other
    late = best.select("k", "pivot", F.lit(0.0).cast("float").alias("angle"), F.lit(True).alias("late"), F.lit(True).alias("unproven"))
    return written(best.join(misfits(late, vectors_of, threshold), "k", "left_anti"))


def touched(rows: DataFrame, gone: DataFrame, vectors_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame | None:
    """(k) of rows with the threshold with one of `gone` (k, c); None if those are many."""
    if gone.count() > ASKED_MOST:
        return None
    held: dict[int, list] = {}
    for r in gone.join(vectors_of(gone.select("k")), "k").select("c", "vector_values").collect():
        held.setdefault(r[0], []).append(r[1])
    shared = rows.sparkSession.sparkContext.broadcast({c: unit_rows(np.array(v)) for c, v in held.items()})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, k, x in rows_of(batch):
                asked = shared.value.get(c)
                if asked is not None and asked.shape[1] == x.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(k[(x @ asked.T >= threshold - FLOAT_ROUNDING).any(1)])], ["k"])

    return rows.select("c", "k", "vector_values").mapInArrow(near, "k bigint").distinct()


def clusters(writes: DataFrame, collections: DataFrame, threshold: float = 0.75, least: int = 5) -> DataFrame:
    """(collection_name, vector_id, k, pivot) of live vectors in clusters of at least `least`.

    Unusable and deleted vectors are in no cluster, exact copies are in one; an empty
    table or collection gives no rows. Any two rows of a cluster have at least the
    threshold cosine, in DOUBLE. Rows that do not fit their cluster join the closest other
    one that they fit, or are settled again with the rows in no cluster that they resemble,
    until a round adds none.
    """
    k, c = F.xxhash64("vector_id", "ts_ns", F.xxhash64("vector_values")), F.xxhash64("collection_name").alias("c")
    dims = collections.groupBy("collection_name").agg(F.max("dimension").alias("dimension"))
    versions = writes.where("vector_id is not null and deleted = false").join(dims, "collection_name").where(F.size("vector_values") == F.col("dimension"))
    versions = versions.select(c, k.alias("k"), "vector_values")
    live = written(live_keys(writes, collections).select("vector_id", "collection_name", c, F.xxhash64("vector_id", "ts_ns", "content").alias("k")))

    def vectors_of(keys: DataFrame) -> DataFrame:
        return versions.where(bit_filter(keys)(F.col("k"))).join(keys.distinct(), "k", "left_semi").select("k", "vector_values").dropDuplicates(["k"])

    found, left, rows = None, live, None
    while True:
        counts = {r[0]: r[1] for r in left.groupBy("c").count().collect()}
        wanted = None
        if rows is None and sum(counts.values()) <= FILTER_BITS // 4:
            rows, wanted = versions, bit_table(left.select("k"))
        elif rows is None:  # the bits would let too many pass
            rows = versions.join(left.select("k"), "k", "left_semi")
        all_rows = written(assigned(rows, counts, wanted, threshold, least).join(left.select("k", "c"), "k").withColumn("late", F.lit(False)))
        members = written(large(all_rows, least))
        out = misfits(members, vectors_of, threshold)
        gone = all_rows.where(F.col("angle") == LOST).select("k", "c")
        if out.isEmpty() and gone.isEmpty():
            kept = members.select("k", "pivot", "c")
            found = kept if found is None else found.unionByName(kept)
            break
        kept = written(large(members.join(out, "k", "left_anti"), least).select("k", "pivot", "c"))
        added = not kept.isEmpty()
        found = kept if found is None else written(found.unionByName(kept))
        gone = written(gone.unionByName(members.select("k", "c").join(kept.select("k"), "k", "left_anti")).distinct())
        if added:
            late = readmitted(found, gone, vectors_of, threshold)
            found = written(found.unionByName(late.join(gone, "k").select("k", "pivot", "c")))
        left = written(live.join(found.select("k"), "k", "left_anti"))
        gone = written(gone.join(left.select("k"), "k", "left_semi"))
        if not added or gone.isEmpty():
            break
        rows = versions.join(left.select("k"), "k", "left_semi")
        close = touched(rows, gone, vectors_of, threshold)
        if close is not None:
            left = written(left.join(close, "k", "left_semi"))
            rows = written(versions.join(left.select("k"), "k", "left_semi"))
    return written(found.select("k", "pivot").join(live, "k").select("collection_name", "vector_id", "k", "pivot"))


def summed(normalize: bool, most: int = 4096):
    """Function for mapInArrow: (cluster, sum of its vectors), combined up to `most` clusters at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        kind = None

        def given() -> Iterator[pa.RecordBatch]:
            items = list(total.items())
            for s in range(0, len(items), 2000):
                some = items[s : s + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], kind.field(0).type), pa.array([v.tolist() for _, v in some], kind.field(1).type)], schema=kind)

        for batch in batches:
            kind = batch.schema
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            order = np.argsort(codes, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else []:
                x = flat[starts[part][:, None] + np.arange(starts[part[0] + 1] - starts[part[0]])]
                if normalize:
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                name = names.dictionary[codes[part[0]]].as_py()
                total[name] = total.get(name, 0) + x.sum(0)
            if normalize and len(total) > most:
                yield from given()
                total.clear()
        if total:
            yield from given()

    return run


def typical_members(writes: DataFrame, members: DataFrame, most: int = 3) -> DataFrame:
    """(collection_name, cluster_id, size, typical_ids) of clusters' members: each cluster's
    size and its most typical members, its medoids: those with the greatest cosine with its
    mean direction, ties to the smaller id. Means are sums of unit vectors, combined before the shuffle."""
    k = F.xxhash64("vector_id", "ts_ns", F.xxhash64("vector_values")).alias("k")
    ids = members.groupBy("pivot").agg(F.min("vector_id").alias("cluster_id"), F.count("*").alias("size"))
    named = members.join(ids, "pivot").drop("pivot")
    rows = writes.where("vector_id is not null").select(k, "vector_values")
    rows = rows.where(bit_filter(members.select("k"))(F.col("k")))
    vectors = written(rows.join(named, "k").dropDuplicates(["k"]))
    mean = means(vectors.select(F.col("cluster_id").alias("pivot"), "vector_values")).withColumnRenamed("pivot", "cluster_id")
    scored = vectors.join(mean, "cluster_id").select("collection_name", "cluster_id", "size", "vector_id", F.round(cosine_similarity(F.col("vector_values"), F.col("mean")), 9).alias("score"))
    best = top_n(scored, ["cluster_id"], [("score", "descending"), ("vector_id", "ascending")], most)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vector_id")))
    return best.groupBy("collection_name", "cluster_id", "size").agg(F.transform(order, lambda s: s.vector_id).alias("typical_ids"))
