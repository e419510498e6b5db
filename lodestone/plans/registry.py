"""All queries of the engine and their SQL."""

from __future__ import annotations

from lodestone.plans import contract_queries, index_queries, job_queries, result_queries, retrieval_queries, text_queries

MODULES = (text_queries, retrieval_queries, job_queries, result_queries, index_queries, contract_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
