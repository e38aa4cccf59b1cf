"""Messages delivered more than once: exact quotient tables over permuted identifiers.

An identifier is two 64-bit words and a string. A Feistel network whose round function
is xxhash64 permutes the words (a bijection whatever the round function is, so nothing
can collide); the hash of the string is mixed into the first word and the string is carried
whole. The top bits of the permuted first word are the quotient, which names the shard of
the table; the remainder, all other bits and the string, is stored completely, so there are
no false matches. Tables are sorted arrays of remainders. Each task inserts its rows into
tables of its own first: of an identifier one row a task leaves it, however often it was
repeated; all others are known to be copies. The shards, sorted by quotient and remainder,
then insert each identifier once as their rows stream by, in memory of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = (0x51ED, 0x2A7F, 0x6B43, 0x0F95)
QUOTIENT_BITS = 16
TABLE_ROWS = 1 << 19
COPY = -1  # in place of a quotient: a row that is known to be a copy


def permute(word_a: Column, word_b: Column, rounds: tuple[int, ...] = ROUNDS) -> tuple[Column, Column]:
    """Bijection on pairs of BIGINTs."""
    for k, seed in enumerate(rounds):
        if k % 2 == 0:
            word_a = word_a.bitwiseXOR(F.xxhash64(word_b, F.lit(seed)))
        else:
            word_b = word_b.bitwiseXOR(F.xxhash64(word_a, F.lit(seed)))
    return word_a, word_b


def unpermute(word_a: Column, word_b: Column, rounds: tuple[int, ...] = ROUNDS) -> tuple[Column, Column]:
    """Inverse of permute: the same rounds backwards."""
    for k in reversed(range(len(rounds))):
        if k % 2 == 0:
            word_a = word_a.bitwiseXOR(F.xxhash64(word_b, F.lit(rounds[k])))
        else:
            word_b = word_b.bitwiseXOR(F.xxhash64(word_a, F.lit(rounds[k])))
    return word_a, word_b


def permuted(df: DataFrame, words: tuple[str, str], text: str, order: str) -> DataFrame:
    """(quotient, high, low, text_part, place) of rows with a whole identifier and an order."""
    a, b = F.col(words[0]).cast("bigint"), F.col(words[1]).cast("bigint")
    known = df.where(a.isNotNull() & b.isNotNull() & F.col(text).isNotNull() & F.col(order).isNotNull())
    rows = known.select(a.alias("a"), b.alias("b"), F.col(text).alias("text_part"), F.col(order).cast("bigint").alias("place"))
    for k, seed in enumerate(ROUNDS):  # each round is a projection of its own, so its hash is computed once
        word, other = ("a", "b") if k % 2 == 0 else ("b", "a")
        rows = rows.withColumn(word, F.col(word).bitwiseXOR(F.xxhash64(other, F.lit(seed))))
    rows = rows.withColumn("a", F.col("a").bitwiseXOR(F.xxhash64("text_part")))
    return rows.select(
        F.shiftrightunsigned("a", 64 - QUOTIENT_BITS).cast("int").alias("quotient"), F.col("a").bitwiseAND(F.lit((1 << (64 - QUOTIENT_BITS)) - 1)).alias("high"),
        F.col("b").alias("low"), "text_part", "place")


def inserted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first row, by place, of each identifier in the table, and of the other places."""
    quotient, high, low, place = (rows.column(c).to_numpy() for c in ("quotient", "high", "low", "place"))
    texts = rows.column("text_part").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((place, texts, low, high, quotient))
    q, h, lo, t, p = quotient[order], high[order], low[order], texts[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (q[1:] != q[:-1]) | (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (t[1:] != t[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    return order[new], order[~new & (p != p[start])]


def own_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows the first of each identifier, and the places of the others as copies;
    a table takes TABLE_ROWS rows at most, then another is begun."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(waiting)
        first, others = inserted(rows)
        yield from rows.take(first).combine_chunks().to_batches(max_chunksize=10_000)
        n = len(others)
        if n:
            place = rows.column("place").take(pa.array(others)).combine_chunks()
            # copies pass on to any task
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, COPY, np.int32)), place, place, pa.array([""] * n), place], schema=rows.schema)

    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= TABLE_ROWS:
            yield from given()
            waiting, size = [], 0
    if waiting:
        yield from given()


def shard_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of all rows of sorted shards but the first of each identifier."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        quotient, high, low, place = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
        texts = batch.column(3)
        same = np.zeros(len(place), bool)
        text_same = np.zeros(len(place), bool)
        if len(place) > 1:
            codes = texts.dictionary_encode().indices.to_numpy()
            text_same[1:] = codes[1:] == codes[:-1]
            same[1:] = (quotient[1:] == quotient[:-1]) & (high[1:] == high[:-1]) & (low[1:] == low[:-1]) & text_same[1:]
        key = (int(quotient[0]), int(high[0]), int(low[0]), texts[0].as_py())
        same[0] = last is not None and key == last[0]
        # the place of the first of a run of one identifier, which may lie in an earlier batch
        start = np.maximum.accumulate(np.where(same, -1, np.arange(len(place))))
        first = np.where(start >= 0, place[np.maximum(start, 0)], last[1] if last is not None else 0)
        copies = (quotient == COPY) | (same & (place != first))
        last = ((int(quotient[-1]), int(high[-1]), int(low[-1]), texts[-1].as_py()), int(first[-1]))
        if copies.any():
            yield pa.RecordBatch.from_arrays([pa.array(place[copies])], ["place"])


def redelivered(df: DataFrame, words: tuple[str, str], text: str, order: str) -> DataFrame:
    """The `order` values (integers) of all rows with an identifier that are not its first delivery.

    Rows with the same identifier and the same `order` are one row. Rows that lack a part of
    the identifier or the order are never among them; an empty table gives none. Narrow rows
    are shuffled once, at most one a task's table and identifier, and the copies' orders.
    """
    rows = permuted(df, words, text, order)
    kind = "quotient int, high bigint, low bigint, text_part string, place bigint"
    first = rows.mapInArrow(own_tables, kind).withColumn("shard", F.when(F.col("quotient") == COPY, F.col("place")).otherwise(F.col("quotient")))
    sorted_shards = first.repartition("shard").sortWithinPartitions("quotient", "high", "low", "text_part", "place").drop("shard")
    found = sorted_shards.mapInArrow(shard_tables, "place bigint")
    return found.distinct().select(F.col("place").cast(df.schema[order].dataType).alias(order))


def first_deliveries(df: DataFrame, words: tuple[str, str], text: str, order: str) -> DataFrame:
    """The rows of `df` to keep: of each identifier the row with the smallest `order`.

    `order` must identify a row. Rows without a complete identifier are kept, since
    nothing proves them to be copies. Rows without `order` but with an identifier are
    dropped (they have no place in the order of arrival). Rows repeated with the same
    `order` are one row and come out once. An empty table gives an empty table; extra
    columns pass through whatever their names.
    """
    whole = F.col(words[0]).isNotNull() & F.col(words[1]).isNotNull() & F.col(text).isNotNull()
    named = df.where(whole & F.col(order).isNotNull()).join(redelivered(df, words, text, order), order, "left_anti")
    return named.select(df.columns).dropDuplicates([order]).unionByName(df.where(~whole))
