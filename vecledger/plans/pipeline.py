"""Queries p2 and p4: redelivered messages and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecledger.operators.changefeed import apply_feed
from vecledger.operators.redelivery import redelivered
from vecledger.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return redelivered(table(spark, sf, "put_append_msgs"), ("client_id", "seq_id"), "kv_key", "arrival_no")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    state = apply_feed(table(spark, sf, "apply_feed"))
    return state.select("gid", "kv_key", F.md5(F.col("value").cast("binary")).alias("value_md5"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found}

SQL = {
    "p2_found": """
        WITH m AS (SELECT arrival_no, min(arrival_no) OVER (PARTITION BY client_id, seq_id, kv_key) AS kept
                   FROM put_append_msgs
                   WHERE client_id IS NOT NULL AND seq_id IS NOT NULL AND kv_key IS NOT NULL)
        SELECT arrival_no FROM m WHERE arrival_no <> kept""",
    "p4_found": """
        WITH e AS (SELECT gid, command_index, command_valid, command FROM apply_feed
                   QUALIFY row_number() OVER (PARTITION BY gid, command_index ORDER BY log_term DESC, command_valid DESC, feed_no) = 1),
        p AS (SELECT gid, command_index, json_extract_string(command, '$.Key') AS kv_key,
                     coalesce(json_extract_string(command, '$.Value'), '') AS val,
                     lower(json_extract_string(command, '$.OpType')) AS op,
                     json_extract_string(command, '$.ClientId') AS client, json_extract_string(command, '$.SeqId') AS seq
              FROM (SELECT * FROM e WHERE command_valid) v),
        w AS (SELECT * FROM p WHERE op NOT IN ('get', '0')
              QUALIFY row_number() OVER (PARTITION BY gid, client, seq ORDER BY command_index) = 1),
        r AS (SELECT *, max(CASE WHEN op NOT IN ('append', '2') THEN command_index END) OVER (PARTITION BY gid, kv_key) AS reset FROM w),
        k AS (SELECT * FROM r WHERE reset IS NULL OR command_index >= reset)
        SELECT gid, kv_key, md5(string_agg(val, '' ORDER BY command_index)) AS value_md5
        FROM k WHERE op NOT IN ('delete', '3') GROUP BY gid, kv_key""",
}
