"""The apply loop as a stream: ordered commands folded into keyed state, exactly once.

Two stateful steps follow each other. The first is keyed by client and lets pass the writes
whose sequence number is above all earlier ones of the client, whatever their keys; the
second is keyed by key and folds them. Both states are in the checkpoint, in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WRITE = "log_index bigint, op string, key string, value string"
OUTPUT = "key string, value string, log_index bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Sets the state store that chained stateful steps need; call it before start()."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Once(StatefulProcessor):
    """Writes of a client above its last log_index and seq_id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "log_index bigint, seq_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        index, seq = self.last.get() if self.last.exists() else (None, None)
        some = pd.concat(list(rows)).sort_values("log_index", kind="stable")
        passed = []
        for at, number in zip(some["log_index"].tolist(), some["seq_id"].tolist(), strict=True):
            later = index is None or at > index
            passed.append(later and (seq is None or number > seq))
            index = at if later else index
            seq = number if passed[-1] else seq
        self.last.update((index, seq))
        yield some.loc[passed, ["log_index", "op", "key", "value"]]

    def close(self) -> None:
        pass


class Fold(StatefulProcessor):
    """Value of a key after its writes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string, log_index bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        value, last = self.state.get() if self.state.exists() else (None, None)
        some = pd.concat(list(rows)).sort_values("log_index", kind="stable")
        changed = False
        for index, op, v in zip(some["log_index"].tolist(), some["op"], some["value"], strict=True):
            if last is not None and index <= last:
                continue
            last, changed = index, True
            v = v if isinstance(v, str) else ""
            value = v if op == "Put" else (value or "") + v
        if changed:
            self.state.update((value, last))
            yield pd.DataFrame({"key": [key[0]], "value": [value], "log_index": [last]})

    def close(self) -> None:
        pass


def fresh_writes(commands: DataFrame) -> DataFrame:
    """Stream (log_index, op, key, value) of the writes that take effect.

    commands: a stream (log_index, op, key, value, client_id, seq_id) whose batches follow
    the log. A write whose seq_id is not above its client's last, on any key, is skipped, and
    so is one at or below the client's last log_index. Writes without client or seq_id pass
    without state; reads and rows without op or log_index are dropped.
    """
    writes = commands.where("log_index is not null and op <> 'Get'")
    named = F.col("client_id").isNotNull() & F.col("seq_id").isNotNull()
    rows = writes.where(named).select("client_id", "log_index", "op", "key", "value", "seq_id")
    passed = rows.groupBy("client_id").transformWithStateInPandas(Once(), WRITE, "Append", "None")
    return passed.unionByName(writes.where(~named).select("log_index", "op", "key", "value"))


def applied(commands: DataFrame) -> DataFrame:
    """Stream of (key, value, log_index) after each batch for the keys it changed, in append mode.

    commands as for fresh_writes. Put replaces, Append extends, a missing key starts at '';
    a null value counts as ''. Within a key, writes at or below the last applied index are
    skipped. A restarted query goes on where its checkpoint stopped.
    """
    prepare(commands.sparkSession)
    writes = fresh_writes(commands).where("key is not null and op in ('Put', 'Append')")
    return writes.groupBy("key").transformWithStateInPandas(Fold(), OUTPUT, "Append", "None")
