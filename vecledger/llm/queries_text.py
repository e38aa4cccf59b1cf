"""Queries p3, p6, p7 and p8, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecledger.functions.distance import DistanceMetric, metric_of
from vecledger.llm.leaks import leaked
from vecledger.llm.textstats import text_statistics, text_types
from vecledger.llm.tokens import token_ids
from vecledger.llm.topn import top_n
from vecledger.sources.tables import table, written


def ranked_items(results: DataFrame, collections: DataFrame) -> DataFrame:
    """(query_id, vector_id, score, badness): the answers that count, see p3_found.

    badness orders distances, smaller is better; null for a null or NaN distance.
    Should one attempt have several values for an item, the greatest counts.
    """
    low = metric_of(F.col("metric")).isin(int(DistanceMetric.EUCLIDEAN), int(DistanceMetric.MANHATTAN))
    metrics = collections.groupBy("collection_name").agg(F.max(low).alias("low"))
    answers = results.where("query_id is not null and vector_id is not null").join(metrics, "collection_name", "left")
    answers = answers.select(
        "query_id", "vector_id",
        F.struct("attempt", "score", F.when(F.isnan("distance"), None).otherwise(F.when(F.col("low"), F.col("distance")).otherwise(-F.col("distance"))).alias("badness")).alias("a"),
    )
    last = answers.groupBy("query_id", "vector_id").agg(F.max("a").alias("a"))
    return last.select("query_id", "vector_id", "a.score", "a.badness").where(F.col("score").isNotNull() & ~F.isnan("score"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    items = ranked_items(table(spark, sf, "search_results"), table(spark, sf, "collections"))
    order = [("score", "descending"), ("badness", "ascending"), ("vector_id", "ascending")]
    return top_n(items, ["query_id"], order, 5).select("query_id", "vector_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(table(spark, sf, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text")


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_statistics(table(spark, sf, "documents"), "doc_id", "text").drop("votes")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    stats = written(text_statistics(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "votes"))
    return text_types(stats, "doc_id").where("p_prose < 0.5").select("doc_id")


QUERIES = {"p3_found": p3_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_statistics": p8_statistics, "p8_found": p8_found}

SQL = {
    "p3_found": """
        WITH m AS (SELECT collection_name, lower(metric) IN ('euclidean', 'euclid', 'l2', 'manhattan', 'taxicab', 'cityblock', 'l1') AS low FROM collections),
        a AS (SELECT query_id, vector_id, score, CASE WHEN isnan(distance) THEN NULL WHEN low THEN distance ELSE -distance END AS badness
              FROM search_results LEFT JOIN m USING (collection_name)
              QUALIFY row_number() OVER (PARTITION BY query_id, vector_id ORDER BY attempt DESC) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, badness ASC NULLS LAST, vector_id) AS n
              FROM a WHERE score IS NOT NULL AND NOT isnan(score))
        SELECT query_id, vector_id FROM r WHERE n <= 5""",
}
