"""Queries p1 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecledger.llm.ivfpq import nearest, neighbour_pairs
from vecledger.llm.pivots import clusters, typical_members
from vecledger.sources.tables import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_pairs(table(spark, sf, "vectors"), table(spark, sf, "collections"), 0.98, 5)


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest, whatever their cosine, of each vector whose number, hexadecimal in its id, is divisible by 100."""
    asks = lambda v: F.coalesce(F.conv(F.substring_index(v, "-", -1), 16, 10).cast("bigint") % 100 == 0, F.lit(False))
    found = nearest(table(spark, sf, "vectors"), table(spark, sf, "collections"), 5, asks=asks)
    return found.select(F.col("me").alias("vector_id"), F.col("other").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    members = clusters(table(spark, sf, "vectors"), table(spark, sf, "collections"))
    ids = members.groupBy("pivot").agg(F.min("vector_id").alias("cluster_id"))
    return members.join(ids, "pivot").select("vector_id", "cluster_id")


def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    vectors, collections = table(spark, sf, "vectors"), table(spark, sf, "collections")
    return typical_members(vectors, clusters(vectors, collections))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p5_found": p5_found, "p5_neighbours": p5_neighbours}
_LIVE = """w AS (SELECT v.*, c.dimension FROM vectors v LEFT JOIN collections c USING (collection_name)
      QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY ts_ns DESC) = 1),
    l AS (SELECT collection_name AS c, vector_id AS id, vector_values::DOUBLE[] AS v FROM w
      WHERE NOT deleted AND vector_values IS NOT NULL AND len(vector_values) = dimension
        AND len(list_filter(vector_values, lambda x: isnan(x))) = 0 AND len(list_filter(vector_values, lambda x: x <> 0)) > 0)"""

#: Brute force over all pairs of a collection; the first takes similarity to be mutual, as it is in these tables.
SQL: dict[str, str] = {
    "p1_found": f"""WITH {_LIVE},
        s AS (SELECT a.id, min(b.id) AS cluster_id FROM l a JOIN l b USING (c) WHERE list_cosine_similarity(a.v, b.v) >= 0.75 GROUP BY a.id)
        SELECT id AS vector_id, cluster_id FROM s QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 5""",
    "p1_clusters": f"""WITH {_LIVE},
        s AS (SELECT a.id, min(b.id) AS cluster_id FROM l a JOIN l b USING (c) WHERE list_cosine_similarity(a.v, b.v) >= 0.75 GROUP BY a.id),
        f AS (SELECT id, c, v, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size FROM s JOIN l USING (id) QUALIFY size >= 5),
        e AS (SELECT cluster_id, unnest(v) / sqrt(list_inner_product(v, v)) AS x, generate_subscripts(v, 1) AS i FROM f),
        m AS (SELECT cluster_id, list(t ORDER BY i) AS mean FROM (SELECT cluster_id, i, sum(x) AS t FROM e GROUP BY ALL) GROUP BY cluster_id),
        r AS (SELECT c, f.cluster_id, size, id, row_number() OVER (PARTITION BY f.cluster_id ORDER BY round(list_cosine_similarity(v, mean), 9) DESC, id) AS n FROM f JOIN m USING (cluster_id))
        SELECT c AS collection_name, cluster_id, size, list(id ORDER BY n) AS typical_ids FROM r WHERE n <= 3 GROUP BY ALL""",
    "p5_neighbours": f"""WITH {_LIVE},
        p AS (SELECT a.id AS me, b.id AS other, list_cosine_similarity(a.v, b.v) AS cosine FROM l a JOIN l b USING (c) WHERE ('0x' || split_part(a.id, '-', 2))::BIGINT % 100 = 0 AND a.id <> b.id)
        SELECT me AS vector_id, other AS neighbour_id, row_number() OVER (PARTITION BY me ORDER BY round(cosine, 6) DESC, other) AS rank, round(cosine, 6) AS cosine FROM p QUALIFY rank <= 5""",
    "p5_found": f"""WITH {_LIVE},
        p AS (SELECT a.id AS me, b.id AS other, list_cosine_similarity(a.v, b.v) AS cosine FROM l a JOIN l b USING (c) WHERE a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.98),
        n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY me ORDER BY round(cosine, 6) DESC, other) <= 5)
        SELECT DISTINCT least(me, other) AS id_a, greatest(me, other) AS id_b FROM n""",
}
