"""The reference check of the workflow tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.references import orphan_references, orphans_by_month
from loomgraph.sources.tables import table

#: referring table, its key, its reference, the table referred to, its own time
REFERENCES = (
    ("workflows", "workflow_id", "conversation_id", "conversations", "started_at"),
    ("agent_executions", "id", "conversation_id", "conversations", "created_at"),
    ("llm_call_metrics", "id", "conversation_id", "conversations", "call_ts"),
    ("workflow_branches", "branch_id", "parent_workflow_id", "workflows", "created_at"),
)
#: table referred to, its key, its own time
PARENTS = (("conversations", "conversation_id", "created_at"), ("workflows", "workflow_id", "started_at"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    references = reduce(
        DataFrame.unionByName,
        (
            table(spark, d, name).select(
                F.lit(name).alias("table_name"),
                F.col(key).cast("string").alias("row_key"),
                F.lit(to).alias("ref_table"),
                F.col(ref).alias("ref_key"),
                F.col(time).alias("ref_time"),
            )
            for name, key, ref, to, time in REFERENCES
        ),
    )
    parents = reduce(
        DataFrame.unionByName,
        (
            table(spark, d, name).select(F.lit(name).alias("ref_table"), F.col(key).alias("parent_key"), F.col(time).alias("parent_time"))
            for name, key, time in PARENTS
        ),
    )
    deletions = table(spark, d, "deletion_log").select(F.col("table_name").alias("ref_table"), F.col("record_key").alias("deleted_key"))
    return orphan_references(references, parents, deletions)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_key", "kind")


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_month(_orphans(spark, d))


_SQL = """
WITH refs AS (
  SELECT 'workflows' AS table_name, CAST(workflow_id AS VARCHAR) AS row_key, 'conversations' AS rt, lower(trim(conversation_id, ' ' || chr(9))) AS k, started_at AS ts FROM workflows
  UNION ALL SELECT 'agent_executions', CAST(id AS VARCHAR), 'conversations', lower(trim(conversation_id, ' ' || chr(9))), created_at FROM agent_executions
  UNION ALL SELECT 'llm_call_metrics', CAST(id AS VARCHAR), 'conversations', lower(trim(conversation_id, ' ' || chr(9))), call_ts FROM llm_call_metrics
  UNION ALL SELECT 'workflow_branches', CAST(branch_id AS VARCHAR), 'workflows', lower(trim(parent_workflow_id, ' ' || chr(9))), created_at FROM workflow_branches
), parents AS (
  SELECT rt, k, min(ts) AS first_ts FROM (
    SELECT 'conversations' AS rt, lower(trim(conversation_id, ' ' || chr(9))) AS k, created_at AS ts FROM conversations
    UNION ALL SELECT 'workflows', lower(trim(workflow_id, ' ' || chr(9))), started_at FROM workflows
  ) p GROUP BY rt, k
), gone AS (
  SELECT DISTINCT table_name AS rt, lower(trim(record_key, ' ' || chr(9))) AS k FROM deletion_log
), orphans AS (
  SELECT r.table_name, r.row_key, min(CASE WHEN p.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END) AS kind, min(r.ts) AS ts
  FROM refs r LEFT JOIN parents p ON p.rt = r.rt AND p.k = r.k LEFT JOIN gone g ON g.rt = r.rt AND g.k = r.k
  WHERE r.k <> '' AND (p.k IS NULL OR p.first_ts > r.ts)
  GROUP BY r.table_name, r.row_key
)
"""

SQL = {
    "p5_found": _SQL + "SELECT table_name, row_key, kind FROM orphans",
    "p5_by_month": _SQL
    + """SELECT table_name, strftime(ts, '%Y-%m') AS month, count(*) AS orphans,
  count(CASE WHEN kind = 'deleted' THEN 1 END) AS deleted, count(CASE WHEN kind = 'missing' THEN 1 END) AS missing,
  count(CASE WHEN kind = 'late' THEN 1 END) AS late
FROM orphans GROUP BY table_name, strftime(ts, '%Y-%m')""",
}
QUERIES = {"p5_found": p5_found, "p5_by_month": p5_by_month}
