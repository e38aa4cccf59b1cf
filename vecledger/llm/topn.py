"""The N best rows of every group by a mergeable aggregate with bounded state.

The state of a group is its N best rows so far. It is built in each task before the
shuffle, so a group with a third of all rows ships at most N rows a task, and merged by
the same code after it. Rows are compared by vectorized sorts of Arrow batches, at
least as many new rows as the state holds at a time, so the cost is amortized. The states
of a task before the shuffle have MOST_STATE rows at most: beyond, they are sent on and
begun anew. After it groups come sorted, and only that of the last row is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BUFFER_ROWS, MOST_STATE = 200_000, 1_000_000


def best_rows(rows: pa.Table, group: list[str], order: list[tuple[str, str]], n: int) -> pa.Table:
    """The first n rows of each group; nulls and NaN come last, in either direction."""
    if rows.num_rows == 0:
        return rows
    keys = [(g, "ascending") for g in group] + order
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end"))
    new = np.zeros(rows.num_rows, dtype=bool)
    new[0] = True
    for g in group:
        codes = rows.column(g).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(new)
    rank = np.arange(rows.num_rows) - np.repeat(starts, np.diff(np.append(starts, rows.num_rows)))
    return rows.filter(pa.array(rank < n))


def top_n(df: DataFrame, group: list[str], order: list[tuple[str, str]], n: int) -> DataFrame:
    """Of each group the first n rows in `order`, a list of (column, "ascending"|"descending").

    The order should end with a column that is unique in its group; rows that tie in all
    of it are interchangeable. Null and NaN values come after all others; a null group
    is a group. Groups of fewer rows come out whole, an empty table gives an empty one.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= max(BUFFER_ROWS, 0 if state is None else state.num_rows):
                new = pa.Table.from_batches(waiting)
                state = best_rows(new if state is None else pa.concat_tables([state, new]), group, order, n)
                waiting, rows = [], 0
                if state.num_rows > MOST_STATE:
                    yield from state.combine_chunks().to_batches(max_chunksize=10_000)
                    state = None
        if waiting:
            new = pa.Table.from_batches(waiting)
            state = best_rows(new if state is None else pa.concat_tables([state, new]), group, order, n)
        if state is not None:
            yield from state.combine_chunks().to_batches(max_chunksize=10_000)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # the last group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = best_rows(rows if kept is None else pa.concat_tables([kept, rows]), group, order, n)
            last = np.ones(rows.num_rows, dtype=bool)
            for g in group:
                codes = rows.column(g).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                value = batch.column(g)[batch.num_rows - 1]
                same = pc.is_null(rows.column(g), nan_is_null=False) if not value.is_valid else pc.equal(rows.column(g), value)
                first = np.flatnonzero(pc.fill_null(same, False).to_numpy(zero_copy_only=False))
                last &= codes == codes[first[0]] if len(first) else False
            kept = rows.filter(pa.array(last))
            yield from rows.filter(pa.array(~last)).combine_chunks().to_batches()
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    part = df.mapInArrow(bounded, df.schema)
    return part.repartition(*group).sortWithinPartitions(*group).mapInArrow(merged, df.schema)
