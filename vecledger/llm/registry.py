"""All queries of this subpackage by name, with SQL where it can express them."""

from vecledger.llm import queries_text, queries_vectors

QUERIES = {**queries_text.QUERIES, **queries_vectors.QUERIES}
SQL = {**queries_text.SQL, **queries_vectors.SQL}
