"""Most similar vectors of every vector by an inverted file with product-quantized residuals.

Fitting, on a bounded sample of each collection: spherical k-means centroids of lists, lists
grouped into regions, and per subspace a codebook of residuals. Indexing covers every live
row: it goes to the region of its nearest centroid, and as a visitor to other regions with
lists that its neighbours may have as home. A region's queries are shared out to tasks, which
hold all rows of the region in 16 bits, by list, and take bounded blocks of queries, visitors
too. A block probes each list with those queries whose neighbours may lie there: asymmetric
distance tables of the query and the codes estimate the cosines, rows that may be among the k nearest so far
are reranked by 16-bit vectors, and a bounded number of the best stays with each query.
What leaves the regions is at most KEPT rows a query, compared in DOUBLE on the stored values.

Estimate: q.x = q.x' + q.e for x = x' + e. x.e and |e| are kept with the code, and for
q within distance D of x, q.e = x.e + (q-x).e, where (q-x).e is about D|e|/sqrt(dim).
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecledger.functions.distance import dot_product, norm
from vecledger.llm.topn import top_n
from vecledger.operators.liverows import live_keys
from vecledger.sources.tables import written

EXACT_ROWS, MOST_LISTS, SAMPLE_PER_LIST, ALL_SAMPLES = 4096, 4096, 32, 1 << 18
CODES, TRAIN_CODES_ROWS, ELEMENTS = 16, 8192, 2
VISIT, SLACK, ROUNDING, NEAREST, FARTHEST = 1.3, 1.5, 1e-4, 0.5, 1.2
QUERY_ELEMENTS, REGION_ROWS, LIST_AT_ONCE, QUERIES_AT_ONCE = 1 << 23, 1 << 18, 2048, 256
BLOCK_ELEMENTS, HELD_ELEMENTS, SCORES_AT_ONCE = 1 << 21, 1 << 25, 1 << 22
TIGHT = 0.7
SPARE, KEPT = 3, 64
FILTER_BITS, BROADCAST_KEYS = 1 << 26, 1 << 20


def unit_rows(values: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(values.astype(np.float64), axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(values / n).astype(np.float32)


def unit_from(small: np.ndarray) -> np.ndarray:
    """Unit rows from the integers of sixteen; cheaper than unit_rows."""
    x = small.astype(np.float32)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    n[n == 0] = 1
    x /= n[:, None]
    return x


def closest(x: np.ndarray, c: np.ndarray, spherical: bool = True) -> np.ndarray:
    """The row of c closest to each of x, SCORES_AT_ONCE products at a time."""
    at, step = np.empty(len(x), np.int64), max(1, SCORES_AT_ONCE // len(c))
    half = 0 if spherical else 0.5 * (c * c).sum(1)
    for s in range(0, len(x), step):
        at[s : s + step] = (x[s : s + step] @ c.T - half).argmax(1)
    return at


def kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = closest(x, c, spherical)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[filled])[:-1]]), axis=0)
        c[filled] = sums / n[filled, None]
        if spherical:
            c = unit_rows(c)
    return c


def split(x: np.ndarray) -> np.ndarray:
    """Rows by subspace: (subspaces, rows, ELEMENTS), the last one filled up with zeros."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % ELEMENTS)))
    return np.ascontiguousarray(x.reshape(len(x), -1, ELEMENTS).transpose(1, 0, 2))


def fit(values: np.ndarray, rows: int) -> dict:
    """Centroids, regions and codebooks of one collection of `rows` rows from a sample of it."""
    rng = np.random.default_rng(7)
    x = unit_rows(values)
    # lists grow with the root of the rows
    c = kmeans(x, int(np.clip(round(rows**0.5 / 2), 1, MOST_LISTS)), 6, True, rng)
    home = closest(x, c)
    part = rng.permutation(len(x))[:TRAIN_CODES_ROWS]
    res = (x - c[home])[part]
    books = np.stack([kmeans(r, min(CODES, len(res)), 5, False, rng) for r in split(res)])
    share = np.bincount(home, minlength=len(c)) / len(x) * rows
    many = -(-rows // REGION_ROWS)
    region = closest(c, kmeans(c, many, 4, True, rng)) if many > 1 else np.zeros(len(c), int)
    blocks = np.maximum(1, np.ceil(np.bincount(region, weights=share, minlength=region.max() + 1) * x.shape[1] / QUERY_ELEMENTS)).astype(int)
    return {"c": c, "books": books, "region": region, "blocks": blocks, "far": np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)).astype(np.float32)}


def fit_all(rows: DataFrame, counts: dict[int, int]) -> dict[int, dict]:
    """Models of the collections {c: live rows} of more than EXACT_ROWS of rows (c, k, vector_values).

    The sample has SAMPLE_PER_LIST rows a list, expected, and ALL_SAMPLES in all at most
    (but 64 a collection); a model has at most MOST_LISTS centroids.
    """
    large = {c: n for c, n in counts.items() if n > EXACT_ROWS}
    if not large:
        return {}
    want = {c: min(n, SAMPLE_PER_LIST * float(np.clip(round(n**0.5 / 2), 32, MOST_LISTS))) for c, n in large.items()}
    share = min(1.0, ALL_SAMPLES / sum(want.values()))
    spark = rows.sparkSession
    rates = spark.createDataFrame([(c, int(min(1.0, max(w * share, 64.0) / large[c]) * (1 << 20))) for c, w in want.items()], "c bigint, rate bigint")
    sent = spark.sparkContext.broadcast(large)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["c"].iloc[0])
        model = fit(np.stack(pdf.sort_values("k")["vector_values"].to_numpy()), sent.value[c])
        return pd.DataFrame({"c": [c], "model": [pickle.dumps(model)]})

    drawn = rows.join(F.broadcast(rates), "c").where(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 20)) < F.col("rate"))  # one row a large collection
    fitted = drawn.select("c", "k", "vector_values").groupBy("c").applyInPandas(train, "c bigint, model binary").collect()
    return {r[0]: pickle.loads(r[1]) for r in fitted}


def whole(dim: int) -> dict:
    """The model of a small collection: one list, searched exactly."""
    return {"c": np.zeros((1, dim), np.float32), "books": None, "region": np.zeros(1, int), "blocks": np.ones(1, int), "far": np.zeros((1, 1), np.float32)}


def true_places(test: np.ndarray) -> np.ndarray:
    """np.flatnonzero of booleans that are rarely true, eight at a time."""
    flat = test.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eight = np.flatnonzero(flat.view(np.uint64) != 0)
    at = np.flatnonzero(flat.reshape(-1, 8)[eight].ravel())
    return eight[at >> 3] * 8 + (at & 7)


def reached(model: dict, x: np.ndarray, home: np.ndarray, lists: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of `lists` (columns) a row's neighbours at `distance` may have as home."""
    c = model["c"]
    gap = np.einsum("ij,ij->i", x, c[home])[:, None] - x @ c[lists].T
    wide = VISIT * np.maximum(distance, NEAREST) / np.sqrt(x.shape[1])
    return (gap <= wide[:, None] * model["far"][:, lists][home]) | (lists == home[:, None])


class Rows:
    """The rows of a region by list, in 16 bits; those of a region beyond HELD_ELEMENTS lie in a file."""

    def __init__(self, model: dict, region: int):
        self.model, self.region = model, region
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bodies: list[np.ndarray] = []
        self.size, self.file = 0, None
        self.coded: dict[int, tuple] = {}

    def add(self, at: np.ndarray, h: np.ndarray, asked: np.ndarray, body: np.ndarray) -> None:
        """Rows in the order of their lists."""
        self.parts.append((at.copy(), h.copy(), asked))
        self.size += body.size
        self.dim = body.shape[1]
        if self.file is None and self.size > HELD_ELEMENTS:
            self.file = tempfile.TemporaryFile()
            for held in self.bodies:
                self.file.write(held.tobytes())
            self.bodies = []
        if self.file is None:
            self.bodies.append(body.copy())
        else:
            self.file.write(body.tobytes())

    def close(self) -> None:
        at, h, asked = (np.concatenate(v) for v in zip(*self.parts, strict=True))
        if self.file is None:
            self.body = np.concatenate(self.bodies)
        else:
            self.file.flush()
            self.body = np.memmap(self.file, np.int16, "r", shape=(len(h), self.dim))
        self.parts, self.bodies = [], []
        self.place = np.sort(np.unique(h, return_index=True)[1])  # a row may be repeated in the table
        self.at, self.h, self.asked = at[self.place], h[self.place], asked[self.place]
        self.lists, first = np.unique(self.at, return_index=True)
        self.bounds = dict(zip(self.lists.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(self.h)], strict=True), strict=True))

    def chunks(self, at: int) -> Iterator[tuple[int, int]]:
        """From where to where the rows of list `at` lie, at most LIST_AT_ONCE each."""
        a, b = self.bounds[at]
        for s in range(a, b, LIST_AT_ONCE):
            yield s, min(b, s + LIST_AT_ONCE)

    def vectors(self, some: np.ndarray | slice) -> np.ndarray:
        return unit_from(self.body[self.place[some]])

    def codes(self, first: int, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encoded() of a chunk whose first key is `first`, kept if the rows are."""
        made = self.coded.get(first) or encoded(self.model, c, x)
        if self.file is None:
            self.coded[first] = made
        return made


def encoded(model: dict, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the rows' residuals from c, products of the rows with their errors, spread of the errors."""
    books, res = model["books"], split(x - c)
    codes = (res @ books.transpose(0, 2, 1) - 0.5 * (books * books).sum(2)[:, None, :]).argmax(2).astype(np.uint8)
    e = res - books[np.arange(len(books))[:, None], codes]
    return codes, np.einsum("mni,mni->n", split(x), e), (SLACK / np.sqrt(x.shape[1])) * np.sqrt(np.einsum("mni,mni->n", e, e))


class Block:
    """The k nearest of a block's queries among the rows of a region, shown list by list."""

    def __init__(self, model: dict, region: int, k: int, h: np.ndarray, x: np.ndarray, home: np.ndarray):
        self.model, self.k = model, k
        order = np.argsort(home, kind="stable")
        self.h, self.x, self.home = h[order], x[order], home[order]
        lists = np.flatnonzero(model["region"] == region)
        n, dim = x.shape
        self.worst = np.full(n, -1.0, np.float32)  # the k-th best cosine so far
        edges = np.flatnonzero(np.diff(self.home)) + 1
        # a first bound from the queries of the same home
        for mine in np.split(np.arange(n), edges):
            if len(mine) > k:
                some = mine[:: max(1, len(mine) // 1024)]
                for s in range(0, len(mine), 1024):
                    part = mine[s : s + 1024]
                    sims = self.x[part] @ self.x[some].T
                    sims[part[:, None] == some] = -1
                    if len(some) > k:
                        self.worst[part] = np.partition(sims, -k, axis=1)[:, -k] - ROUNDING
        probe: dict[int, list[np.ndarray]] = {}
        for s in range(0, n, 4096):
            distance = np.sqrt(np.maximum(0, 2 - 2 * self.worst[s : s + 4096]))
            at, row = np.nonzero(reached(model, self.x[s : s + 4096], self.home[s : s + 4096], lists, np.minimum(distance, FARTHEST)).T)
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                if len(part):
                    probe.setdefault(int(lists[at[part[0]]]), []).append(row[part] + s)
        self.probe = {at: np.concatenate(rows) for at, rows in probe.items()}
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.tables()

    def search(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """result() after all of the region's rows."""
        for at in rows.lists.tolist():
            if at in self.probe:
                for a, b in rows.chunks(at):
                    self.show(at, rows.h[a:b], rows.vectors(slice(a, b)), rows)
        return self.result()

    def tables(self) -> None:
        """Asymmetric distance tables of the queries that have close neighbours, in 16 bits of
        one scale: (codes of all subspaces, queries)."""
        self.place = np.full(len(self.x), -1)
        books = self.model["books"]
        if books is None:
            return
        tight = np.flatnonzero(self.worst >= TIGHT)
        self.place[tight] = np.arange(len(tight))
        self.high = np.linalg.norm(books, axis=2).max(1) + 1e-6
        self.scale = 60000 / (2 * float(self.high.sum()) + 2.0)
        self.table = np.empty((*books.shape[:2], len(tight)), np.uint16)
        for s in range(0, len(tight), 4096):
            q = split(self.x[tight[s : s + 4096]])
            self.table[:, :, s : s + 4096] = (books @ q.transpose(0, 2, 1) + self.high[:, None, None]) * self.scale + 0.5

    def show(self, at: int, h: np.ndarray, x: np.ndarray, rows: Rows | None = None) -> None:
        """Rows of list `at`, at most LIST_AT_ONCE; `rows` keeps their codes."""
        mine = self.probe.get(at)
        if mine is None or not len(h):
            return
        tight = self.place[mine] >= 0
        if tight.any():
            c = self.model["c"][at]
            codes = encoded(self.model, c, x) if rows is None else rows.codes(int(h[0]), c, x)
            self.look_up(c, mine[tight], h, x, *codes)
        # neighbours of the others are far: the error of the codes would let too many rows pass
        far, scores, test = mine[~tight], np.empty(0, np.float32), np.empty(0, bool)
        for s in range(0, len(far), QUERIES_AT_ONCE):
            part = far[s : s + QUERIES_AT_ONCE]
            n = len(x) * len(part)
            if len(scores) < n:  # used again, as new memory costs more than the comparison
                scores, test = np.empty(n, np.float32), np.empty(n, bool)
            sims = np.matmul(x, self.x[part].T, out=scores[:n].reshape(len(x), -1))
            hits = true_places(np.greater_equal(sims, self.worst[part], out=test[:n].reshape(sims.shape)))
            r, i = np.divmod(hits, len(part))
            self.keep(part[i], h[r], scores[hits])
        if self.waiting > 8 * len(self.x):
            self.compact()

    def look_up(self, c: np.ndarray, mine: np.ndarray, h: np.ndarray, x: np.ndarray, codes: np.ndarray, xe: np.ndarray, spread: np.ndarray) -> None:
        for s in range(0, len(mine), QUERIES_AT_ONCE):
            part = mine[s : s + QUERIES_AT_ONCE]
            q, worst = self.x[part], self.worst[part]
            own = np.clip(xe + spread * np.sqrt(max(0.0, 2 - 2 * float(worst.min()))), -1, 1)
            estimate = np.repeat(((own + 1) * self.scale).astype(np.uint16)[:, None], len(part), axis=1)
            buffer = np.empty_like(estimate)
            at = self.place[part]
            # queries of one home lie side by side
            table = self.table[:, :, at[0] : at[-1] + 1] if at[-1] - at[0] + 1 == len(at) else self.table[:, :, at]
            for t, code in zip(table, codes, strict=True):
                np.take(t, code, axis=0, out=buffer, mode="clip")
                estimate += buffer
            least = (worst - q @ c + self.high.sum() + 1) * self.scale - 4  # what rounding may lose
            hits = true_places(estimate >= np.clip(least, 0, 65535).astype(np.uint16))
            if not len(hits):
                continue
            r, i = np.divmod(hits, len(part))
            # rerank; for many rows one product is cheaper than gathering them
            cosine = np.einsum("ij,ij->i", x[r], q[i]) if len(hits) < estimate.size // 256 else (x @ q.T).ravel()[hits]
            self.keep(part[i], h[r], cosine)

    def keep(self, row: np.ndarray, h: np.ndarray, cosine: np.ndarray) -> None:
        some = (cosine >= self.worst[row]) & (h != self.h[row])
        if some.any():
            self.found.append((row[some], h[some], cosine[some]))
            self.waiting += int(some.sum())

    def compact(self) -> None:
        """Of each query the k best and those within ROUNDING of them, KEPT at most."""
        if not self.found:
            return
        row, h, cosine = (np.concatenate(parts) for parts in zip(*self.found, strict=True))
        # by row, then the greatest cosine, in one number
        order = np.argsort((row << 32) + ((2 - cosine) * (1 << 29)).astype(np.int64))
        row, h, cosine = row[order], h[order], cosine[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])  # a row repeated in the table
        row, h, cosine = row[new], h[new], cosine[new]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(start, len(row)))
        rank = np.arange(len(row)) - np.repeat(start, size)
        full = size >= self.k
        last = np.full(len(start), -1.0, np.float32)
        last[full] = cosine[start[full] + self.k - 1] - 2 * ROUNDING
        self.worst[row[start]] = np.maximum(self.worst[row[start]], last)
        keep = (rank < self.k + SPARE) | ((cosine >= np.repeat(last, size)) & (rank < KEPT))
        self.found = [(row[keep], h[keep], cosine[keep])]
        self.waiting = 0  # of new ones

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.compact()
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        row, h, cosine = self.found[0]
        return self.h[row], h, cosine


SHIPPED = pa.schema([("c", pa.int64()), ("region", pa.int32()), ("block", pa.int32()), ("role", pa.int32()), ("list", pa.int32()), ("h", pa.int64()), ("body", pa.binary())])
SHIPPED_DDL = "c bigint, region int, block int, role int, list int, h bigint, body binary"
FOUND = pa.schema([("c", pa.int64()), ("me", pa.int64()), ("other", pa.int64()), ("near", pa.float32())])
BOTH, QUERY, ROW = 0, 1, 2  # roles of a row in a block


def sixteen(x: np.ndarray) -> np.ndarray:
    """int16 rows in the direction of unit rows."""
    scale = np.abs(x).max(1, keepdims=True) / 32767
    scale[scale == 0] = 1
    return np.round(x / scale).astype(np.int16)


def searched(batches: Iterator[pa.RecordBatch], models: dict[int, dict], k: int, at_least: float) -> Iterator[pa.RecordBatch]:
    """FOUND rows of SHIPPED rows, which come by region and block: its rows by list, then the visitors."""
    held, rows, waiting = None, None, []

    def answered(h: np.ndarray, x: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        me, other, near = Block(rows.model, rows.region, k, h, x, home).search(rows)
        some = near >= at_least - ROUNDING
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), held[0])), pa.array(me[some]), pa.array(other[some]), pa.array(near[some])], schema=FOUND)

    def complete() -> Iterator[pa.RecordBatch]:
        """All rows are there: answers its own queries."""
        rows.close()
        own, most = np.flatnonzero(rows.asked), max(1, BLOCK_ELEMENTS // rows.dim)
        for s in range(0, len(own), most):
            some = own[s : s + most]
            yield from answered(rows.h[some], rows.vectors(some), rows.at[some])

    def visited() -> Iterator[pa.RecordBatch]:
        nonlocal waiting
        if waiting:
            h, x, home = (np.concatenate(parts) for parts in zip(*waiting, strict=True))
            waiting = []
            first = np.unique(h, return_index=True)[1]
            yield from answered(h[first], x[first], home[first])

    def closed() -> Iterator[pa.RecordBatch]:
        if rows is not None and rows.parts:
            yield from complete()
        yield from visited()

    for batch in batches:
        c, region, number, role, at, h = (batch.column(i).to_numpy() for i in range(6))
        offsets = np.frombuffer(batch.column(6).buffers()[1], np.int32)[batch.column(6).offset :]
        raw = batch.column(6).buffers()[2]
        visit = role == QUERY
        edges = np.flatnonzero((c[1:] != c[:-1]) | (region[1:] != region[:-1]) | (number[1:] != number[:-1]) | (visit[1:] != visit[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(h)], strict=True):
            if a == b:
                continue
            key = (int(c[a]), int(region[a]), int(number[a]))
            body = np.frombuffer(raw, np.int16, (offsets[b] - offsets[a]) // 2, offsets[a]).reshape(b - a, -1)
            if key != held:
                if held is not None:
                    yield from closed()
                held, rows = key, None
            if not visit[a]:
                if rows is None:
                    rows = Rows(models.get(key[0]) or whole(body.shape[1]), key[1])
                rows.add(at[a:b], h[a:b], role[a:b] == BOTH, body)
            elif rows is not None:  # else no row lies in the region
                if rows.parts:
                    yield from complete()
                waiting.append((h[a:b], unit_from(body), at[a:b]))
                if sum(len(w[0]) for w in waiting) * rows.dim >= BLOCK_ELEMENTS:
                    yield from visited()
    if held is not None:
        yield from closed()


def candidates(rows: DataFrame, counts: dict[int, int], k: int, wanted: np.ndarray | None, asks: Callable[[np.ndarray], np.ndarray] | None = None, at_least: float = -1.0) -> DataFrame:
    """(c, me, other, near): of every row at most KEPT others a region, which the index holds for the k nearest.

    rows: (c, k BIGINT, vector_values) of which those in the bit table `wanted` count.
    asks: which keys are queries, all if None. at_least only drops pairs from the result.
    """
    spark = rows.sparkSession
    # rows that are not live may be drawn for the sample; they are not indexed
    shared = spark.sparkContext.broadcast(fit_all(rows, counts))
    wanted = spark.sparkContext.broadcast(wanted)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, h, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            size = np.diff(starts)
            live = np.ones(len(h), bool) if wanted.value is None else in_table(wanted.value, h)
            for name, dim in np.unique(np.column_stack([c[live], size[live]]), axis=0).tolist():
                model = shared.value.get(name) or whole(dim)
                if model["c"].shape[1] != dim:
                    continue
                mine = np.flatnonzero(live & (c == name) & (size == dim))
                step = int(np.clip((1 << 23) // (dim * model["blocks"].max()), 16, 2048))
                for s in range(0, len(mine), step):
                    part = mine[s : s + step]
                    yield from given(model, name, h[part], unit_rows(flat[starts[part][:, None] + np.arange(dim)]))

    def given(model: dict, c: int, h: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        home = (x @ model["c"].T).argmax(1)
        body = sixteen(x)
        region, blocks = model["region"][home], model["blocks"]
        asked = np.ones(len(h), bool) if asks is None else asks(h)
        mark = h.view(np.uint64) // np.uint64(64)
        # every row to all blocks of its region; one of them owns it as a query
        n = blocks[region]
        each = np.repeat(np.arange(len(h)), n)
        block = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        own = asked[each] & (mark[each] % n[each].astype(np.uint64) == block.astype(np.uint64))
        yield packed(c, region[each], block, np.where(own, BOTH, ROW), home[each], h[each], body[each])
        if len(blocks) > 1:  # visits of other regions, by a guess of the distance of neighbours
            some = np.flatnonzero(asked)
            guess = 1.2 * np.linalg.norm(x[some] - model["c"][home[some]], axis=1)
            row, at = np.nonzero(reached(model, x[some], home[some], np.arange(len(model["c"])), guess))
            visits = np.unique(np.column_stack([some[row], model["region"][at]]), axis=0)
            r, to = visits[visits[:, 1] != region[visits[:, 0]]].T
            yield packed(c, to, (mark[r] % blocks[to].astype(np.uint64)).astype(int), np.full(len(r), QUERY), home[r], h[r], body[r])

    def packed(c: int, region: np.ndarray, block: np.ndarray, role: np.ndarray, at: np.ndarray, h: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
        n, width = len(h), body.shape[1] * 2
        offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes())
        raw = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(body.tobytes())])
        small = [pa.array(v.astype(np.int32)) for v in (region, block, role, at)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, c)), *small, pa.array(h), raw], schema=SHIPPED)

    places = ["c", "region", "block"]
    parts = rows.select("c", "k", "vector_values").mapInArrow(index, SHIPPED_DDL)
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, so that heavy blocks are not put together
    return parts.repartition(tasks, *places).sortWithinPartitions(*places, F.col("role") == QUERY, "list").mapInArrow(lambda batches: searched(batches, shared.value, k, at_least), "c bigint, me bigint, other bigint, near float")


def bit_table(hashes: DataFrame) -> np.ndarray:
    """The bits, by value mod FILTER_BITS, of all values of `hashes` (one column)."""
    bits = hashes.toDF("h").where("h is not null").select(F.pmod(F.col("h"), F.lit(FILTER_BITS)).alias("bit"))
    found = bits.groupBy(F.expr("cast(shiftright(bit, 5) as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    v = values % (32 * len(table))
    return (table[v >> 5] >> (v & 31).astype(np.uint32)) & 1 == 1


def bit_filter(hashes: DataFrame):
    """A test of BIGINT columns: true for all values of `hashes` (one column) and few others.

    The filter has FILTER_BITS bits at most; beyond its capacity it lets more rows pass
    to the join that follows, never fewer.
    """
    return bit_test(hashes.sparkSession.sparkContext.broadcast(bit_table(hashes)))


def bit_test(used: Broadcast):
    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        return pd.Series(in_table(used.value, s.to_numpy()))

    return maybe


def nearest(writes: DataFrame, collections: DataFrame, k: int, at_least: float = -1.0, asks: Callable[[Column], Column] | None = None) -> DataFrame:
    """(collection_name, me, other, cosine, rank): the k most similar other live vectors of
    its collection of every live vector, by cosine in DOUBLE rounded to six decimals, ties to
    the smaller id.

    The search is for k neighbours whatever their cosine; at_least drops pairs below it from
    the result. asks: from vector_id whether a vector is a query, all are if None.
    Deleted, unusable and superseded rows are neither; an empty table gives no rows, a
    collection of n vectors n - 1 neighbours at most. Precision is that of DOUBLE, recall that
    of the index: see the README. Of more than KEPT rows that differ in cosine to a query by
    less than 2e-4 at its k-th place, KEPT are compared exactly.

    Exact copies: of more than k + 1 live vectors with the same values only the k + 1
    smallest ids are indexed. They include all that can be a neighbour of anything, and
    the others have the neighbours of the smallest one, and that one.
    """
    key, c = F.xxhash64("vector_id", "ts_ns", F.xxhash64("vector_values")), F.xxhash64("collection_name")
    live = live_keys(writes, collections).select("vector_id", "collection_name", "content", c.alias("c"), F.xxhash64("vector_id", "ts_ns", "content").alias("k"))
    live = written(live)
    crowds = written(live.groupBy("collection_name", "content").count().where(F.col("count") > k + 1).select("collection_name", "content"))  # mostly few
    members = written(live.join(crowds, ["collection_name", "content"]))
    crowded = not members.isEmpty()
    indexed = live
    if crowded:
        kept = written(top_n(members.select("collection_name", "content", "vector_id", "k"), ["collection_name", "content"], [("vector_id", "ascending")], k + 1))
        surplus = written(members.join(kept.select("vector_id"), "vector_id", "left_anti"))
        indexed = written(live.join(surplus.select("vector_id"), "vector_id", "left_anti"))
    counts = {r[0]: r[1] for r in indexed.groupBy("c").count().collect()}
    dims = collections.groupBy("collection_name").agg(F.max("dimension").alias("dimension"))
    versions = writes.where("vector_id is not null and deleted = false").join(dims, "collection_name").where(F.size("vector_values") == F.col("dimension"))
    versions = versions.select(c.alias("c"), key.alias("k"), "vector_values", "vector_id", "collection_name")
    exact = sum(counts.values()) > FILTER_BITS // 4  # the bits would let too many pass
    rows = versions.join(indexed.select("k"), "k", "left_semi") if exact else versions
    wanted = None if exact else bit_table(indexed.select("k"))
    keys_asked = None
    if asks is not None:
        asking = indexed.where(asks(F.col("vector_id")))
        if crowded:
            # the smallest copy answers for the others
            stand = kept.groupBy("collection_name", "content").agg(F.min("vector_id").alias("vector_id"))
            asking = asking.select("k").unionByName(indexed.join(stand.select("vector_id"), "vector_id", "left_semi").select("k"))
        sent = writes.sparkSession.sparkContext.broadcast(bit_table(asking.select("k")))
        keys_asked = lambda h: in_table(sent.value, h)
    # a pair is compared once, whichever of the two has found it
    found = candidates(rows, counts, k, wanted, keys_asked, at_least)
    pairs = written(found.select(F.least("me", "other").alias("me"), F.greatest("me", "other").alias("other")).distinct())
    keys = pairs.select(F.explode(F.array("me", "other")).alias("k")).distinct().join(indexed.select("k"), "k", "left_semi")
    # repeated rows give repeated pairs, which are dropped without their vectors
    if 2 * pairs.count() <= BROADCAST_KEYS:
        some = versions.join(F.broadcast(keys), "k", "left_semi")
    else:
        keys = written(keys)
        some = versions.where(bit_filter(keys)(F.col("k"))).join(keys, "k", "left_semi")
    held = written(some.select("k", "vector_id", "collection_name", "vector_values", norm(F.col("vector_values")).alias("norm")))
    mine = held.select(F.col("k").alias("me"), "collection_name", F.col("vector_id").alias("a"), F.col("vector_values").alias("va"), F.col("norm").alias("na"))
    theirs = held.select(F.col("k").alias("other"), F.col("vector_id").alias("b"), F.col("vector_values").alias("vb"), F.col("norm").alias("nb"))
    cosine = dot_product(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))
    compared = written(pairs.join(mine, "me").join(theirs, "other").select("collection_name", F.col("a").alias("me"), F.col("b").alias("other"), cosine.alias("cosine")).dropDuplicates(["me", "other"]))
    scored = compared.unionByName(compared.select("collection_name", F.col("other").alias("me"), F.col("me").alias("other"), "cosine"))
    order = [F.round("cosine", 6).desc(), F.col("other")]
    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("me").orderBy(*order))).where((F.col("rank") <= k) & (F.col("cosine") >= at_least))
    out = ranked(scored)
    if crowded:
        first = kept.groupBy("collection_name", "content").agg(F.min("vector_id").alias("first"))
        rest = surplus.join(first, ["collection_name", "content"]).select("vector_id", "first")
        own = first.select("collection_name", F.col("first").alias("me"), F.col("first").alias("other"), F.lit(1.0).alias("cosine"))
        lists = ranked(scored.join(first.select(F.col("first").alias("me")), "me", "left_semi").select("collection_name", "me", "other", "cosine").unionByName(own))
        copies = rest if asks is None else rest.where(asks(F.col("vector_id")))
        out = out.unionByName(copies.join(lists, copies["first"] == lists["me"]).select("collection_name", F.col("vector_id").alias("me"), "other", "cosine", "rank"))
    return out if asks is None else out.where(asks(F.col("me")))


def neighbour_pairs(writes: DataFrame, collections: DataFrame, min_cosine: float, k: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of at least min_cosine of which one is among the k
    nearest of the other, see nearest."""
    out = nearest(writes, collections, k, min_cosine)
    return out.select(F.least("me", "other").alias("id_a"), F.greatest("me", "other").alias("id_b")).distinct()
