"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from glossa.llm import join_queries, learned_queries, native_queries

QUERIES = {**native_queries.QUERIES, **learned_queries.QUERIES, **join_queries.QUERIES}
ORACLE_SQL = {**native_queries.ORACLE_SQL, **join_queries.ORACLE_SQL}
