"""All core queries by name, with the SQL that must give the same rows."""

from vecledger.plans import log_queries, pipeline, vector_queries

QUERIES = {**vector_queries.QUERIES, **log_queries.QUERIES, **pipeline.QUERIES}
SQL = {**vector_queries.SQL, **log_queries.SQL, **pipeline.SQL}
