"""Where queries are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The mappings of procgraph.sources.tables in SQL.
CTE = {
    "conv": "conv AS (SELECT 'p' || conv_id AS process_id, 't_' || conv_id || '_' || turn AS task_id, turn::INT AS ord, turn AS seq, role, text, coalesce(text, '') AS name FROM conversations)",
    "li": "li AS (SELECT 'o' || l_orderkey AS process_id, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS task_id, l_linenumber AS ord, l_partkey * 100000 + l_suppkey AS seq, 's' || l_suppkey AS role_id, l_returnflag || l_linestatus AS decision_id, l_returnflag AS condition FROM lineitem)",
    "ev": "ev AS (SELECT 'u' || user_id AS process_id, 'e' || event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CASE WHEN event_type = 'error' THEN 'gateway' ELSE 'task' END AS kind, event_type, value, props FROM events)",
    "nx": "nx AS (SELECT process_id, task_id AS src, dst FROM (SELECT process_id, task_id, lead(task_id) OVER (PARTITION BY process_id ORDER BY ord NULLS LAST, seq) AS dst FROM conv) WHERE dst IS NOT NULL)",
    "lnx": "lnx AS (SELECT process_id, task_id AS src, dst FROM (SELECT process_id, task_id, lead(task_id) OVER (PARTITION BY process_id ORDER BY ord NULLS LAST, seq) AS dst FROM li) WHERE dst IS NOT NULL)",
    "enx": "enx AS (SELECT process_id, id AS src, dst FROM (SELECT process_id, id, lead(id) OVER (PARTITION BY process_id ORDER BY seq) AS dst FROM ev) WHERE dst IS NOT NULL)",
}


def query(sql: str | None = None, *ctes: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = ("WITH RECURSIVE " + ", ".join(CTE[c] for c in ctes) + " " if ctes else "") + sql
        return f

    return register
