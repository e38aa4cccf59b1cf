"""Linearizability of key/value histories, one key at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GET, PUT, APPEND = 0, 1, 2
OK, ILLEGAL, UNKNOWN = "Ok", "Illegal", "Unknown"


def kv_step(state: str, op: int, value: str, output: str) -> tuple[bool, str]:
    """Whether an operation is possible in a state, and the state after it."""
    if op == GET:
        return output == state, state
    return True, value if op == PUT else state + value


def check(ops: list[tuple[int, str, str, int, int]], step=kv_step, start: str = "", budget: int = 1_000_000) -> tuple[str, list[int]]:
    """Verdict on operations (op, value, output, call, return), and the longest order found."""
    verdict, partial = partial_orders(ops, step, start, budget)
    return verdict, max(partial, key=len, default=[])


def partial_orders(ops: list[tuple[int, str, str, int, int]], step=kv_step, start: str = "", budget: int = 1_000_000) -> tuple[str, list[list[int]]]:
    """Verdict, and the longest orders found such that each operation found is in one.

    Searches for an order that respects both time and the model: the next operation is
    one that was called before any other open one returned. States already reached with
    the same set of done operations are not searched again. More than `budget` steps
    give Unknown.
    """
    n = len(ops)
    by_call = sorted(range(n), key=lambda i: (ops[i][3], i))
    by_return = sorted(range(n), key=lambda i: ops[i][4])
    seen: set[tuple[int, str]] = set()
    best: dict[int, list[int]] = {}
    path: list[int] = []

    def partial() -> list[list[int]]:
        return [list(o) for o in sorted({tuple(o) for o in best.values()}, key=lambda o: (-len(o), o))]

    def note() -> None:
        order = list(path)
        for i in path:
            if len(best.get(i, ())) < len(order):
                best[i] = order

    def choices(done: int) -> Iterator[int]:
        first_return = next((ops[i][4] for i in by_return if not done >> i & 1), 0)
        for i in by_call:
            if ops[i][3] > first_return:
                break
            if not done >> i & 1:
                yield i

    stack = [(0, start, choices(0))]
    while stack:
        done, state, rest = stack[-1]
        if len(path) == n:
            note()
            return OK, partial()
        for i in rest:
            budget -= 1
            if budget < 0:
                note()
                return UNKNOWN, partial()
            possible, after = step(state, ops[i][0], ops[i][1], ops[i][2])
            key = (done | 1 << i, after)
            if possible and key not in seen:
                seen.add(key)
                path.append(i)
                stack.append((key[0], after, choices(key[0])))
                break
        else:
            note()  # a dead end
            stack.pop()
            if path:
                path.pop()
    return ILLEGAL, partial()


def linearizable(history: DataFrame, budget: int = 1_000_000, step: Callable = kv_step, start: str = "") -> DataFrame:
    """(key, verdict, operations, longest, partials) of a history (client_id, op, key, value, output, call_ns, return_ns).

    Keys are independent, so each is checked on its own; a key's operations come into one
    task, as the search needs them all. Null values and outputs count as ''. `longest` is
    the longest prefix of an order, as positions by call time; `partials` has for each operation
    found a longest one with it. step and start are the model, as kv_step.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["call_ns", "return_ns", "client_id"])
        ops = list(zip(pdf["op"].astype(int), pdf["value"].fillna(""), pdf["output"].fillna(""), pdf["call_ns"], pdf["return_ns"], strict=True))
        verdict, partials = partial_orders(ops, step, start, budget)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "verdict": [verdict], "operations": [len(ops)], "longest": [max(partials, key=len, default=[])], "partials": [partials]})

    rows = history.where("key is not null").select("client_id", "op", "key", "value", "output", "call_ns", "return_ns")
    return rows.groupBy("key").applyInPandas(run, "key string, verdict string, operations bigint, longest array<int>, partials array<array<int>>")


def history_verdict(verdicts: DataFrame) -> DataFrame:
    """One row: Illegal if a key is, else Unknown if a key is, else Ok."""
    bad, unsure = F.count_if(F.col("verdict") == ILLEGAL), F.count_if(F.col("verdict") == UNKNOWN)
    return verdicts.agg(F.when(bad > 0, ILLEGAL).when(unsure > 0, UNKNOWN).otherwise(OK).alias("verdict"))
