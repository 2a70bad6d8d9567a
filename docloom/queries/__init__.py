"""Named queries over the test tables, and DuckDB SQL for those that it can express."""

from . import functions_queries, index_queries, page_queries, registry_queries, retrieval_queries, scope_queries, search_queries, service_queries

MODULES = [functions_queries, retrieval_queries, index_queries, page_queries, search_queries, registry_queries, service_queries, scope_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
