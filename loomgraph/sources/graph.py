"""The code graph: nodes and typed edges of two repositories, one of order data (acyclic), one of Java members.

One SQL text serves Spark and the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.sources.tables import table

_TABLES = ("orders", "customer", "supplier", "nation", "region", "lineitem", "part", "events")

EDGES_SQL = """
SELECT 'O:' || CAST(o_orderkey AS STRING) AS source_id, 'C:' || CAST(o_custkey AS STRING) AS target_id, 'ACCEPTS' AS kind, 'tpch' AS repo FROM orders
UNION ALL SELECT 'C:' || CAST(c_custkey AS STRING), 'N:' || CAST(c_nationkey AS STRING), 'USES', 'tpch' FROM customer
UNION ALL SELECT 'S:' || CAST(s_suppkey AS STRING), 'N:' || CAST(s_nationkey AS STRING), 'INJECTS', 'tpch' FROM supplier
UNION ALL SELECT 'N:' || CAST(n_nationkey AS STRING), 'R:' || CAST(n_regionkey AS STRING), 'EXTENDS', 'tpch' FROM nation
UNION ALL SELECT DISTINCT 'P:' || CAST(l_partkey AS STRING), 'S:' || CAST(l_suppkey AS STRING), 'INJECTS', 'tpch' FROM lineitem
UNION ALL SELECT DISTINCT 'E:' || s, 'E:' || t, 'USES', 'events' FROM (SELECT event_type AS s, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) x WHERE t IS NOT NULL
"""

NODES_SQL = """
SELECT 'R:' || CAST(r_regionkey AS STRING) AS node_id, 'INTERFACE' AS node_type, 'tpch' AS repo, 'geo.region.' || r_name AS fqn, r_name AS simple_name, 'geo.region' AS package_name, 'src/geo/' || r_name || '.java' AS file_path, 'Roles: root' AS summary, CAST(NULL AS STRING) AS domain, CAST(NULL AS STRING) AS features, CAST(NULL AS STRING) AS concepts FROM region
UNION ALL SELECT 'N:' || CAST(n_nationkey AS STRING), 'CLASS', 'tpch', 'geo.nation.' || n_name, n_name, 'geo.nation', 'src/geo/' || n_name || '.java', 'Roles: node', 'geo', NULL, NULL FROM nation
UNION ALL SELECT 'C:' || CAST(c_custkey AS STRING), 'CLASS', 'tpch', 'crm.' || lower(c_mktsegment) || '.' || c_name, c_name, 'crm.' || lower(c_mktsegment), 'src/crm/' || c_name || '.java', '', lower(c_mktsegment), NULL, NULL FROM customer
UNION ALL SELECT 'S:' || CAST(s_suppkey AS STRING), 'METHOD', 'tpch', 'sup.' || s_name, s_name, 'sup', 'src/sup/' || s_name || '.java', NULL, 'supply', NULL, NULL FROM supplier
UNION ALL SELECT 'P:' || CAST(p_partkey AS STRING), 'FIELD', 'tpch', 'cat.' || lower(p_type) || '.' || p_name, p_name, 'cat.' || lower(p_type), 'src/cat/' || CAST(p_partkey AS STRING) || '.java', p_brand, lower(p_type), replace(p_name, ' ', ','), replace(lower(p_brand), '#', ',') FROM part
"""


def _view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    named = {t: table(spark, d, t) for t in _TABLES}
    for t in sorted(_TABLES, key=len, reverse=True):
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **named)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source_id, target_id, kind, repo; repo 'events' has cycles."""
    return _view(spark, d, EDGES_SQL)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """node_id, node_type, repo, fqn, simple_name, package_name, file_path, summary, domain, features, concepts."""
    return _view(spark, d, NODES_SQL)
