"""The engine's tables, with each record once and clean keys.

Repeated rows of executions, calls and workflows are alike but for the time they arrived; a conversation that is there
again holds with its earliest row. Keys are compared without case and surrounding white space, a blank one is null.
Copies are alike, so filters (``where``) come before the shuffle that makes ids unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.tables import table


def clean_key(c: str) -> Column:
    return F.nullif(F.lower(F.btrim(c, F.lit(" \t"))), F.lit(""))


def _once(df: DataFrame, key: str, where: Column | str | None, *clean: str) -> DataFrame:
    df = df.withColumns({c: clean_key(c) for c in clean})
    return (df if where is None else df.filter(where)).dropDuplicates([key])


def executions(spark: SparkSession, d: str, where: Column | str | None = None) -> DataFrame:
    columns = ("id", "agent_name", "conversation_id", "decision", "confidence", "token_usage_input", "token_usage_output", "latency_ms", "status", "error_message", "created_at")
    return _once(table(spark, d, "agent_executions", *columns), "id", where, "conversation_id")


def calls(spark: SparkSession, d: str, where: Column | str | None = None) -> DataFrame:
    """LLM calls without their texts."""
    columns = (
        "id", "agent_name", "conversation_id", "call_ts", "model", "success", "latency_ms", "input_tokens", "output_tokens", "total_tokens", "estimated_cost",
        "context_relevance_score", "answer_relevance_score", "faithfulness_score", "response_quality_score", "retry_count", "http_status_code",
    )
    return _once(table(spark, d, "llm_call_metrics", *columns), "id", where, "conversation_id")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "conversations").withColumn("conversation_id", clean_key("conversation_id"))
    first = F.min_by(F.struct("user_id", "repo_url", "repo_name", "mode", "is_active", "created_at"), "created_at").alias("c")
    return df.groupBy("conversation_id").agg(first, F.max("last_activity").alias("last_activity")).select("conversation_id", "c.*", "last_activity")


def workflows(spark: SparkSession, d: str, where: Column | str | None = None) -> DataFrame:
    return _once(table(spark, d, "workflows"), "workflow_id", where, "workflow_id", "conversation_id")


def messages(spark: SparkSession, d: str, *texts: str) -> DataFrame:
    """conversation_id, id, said_at, part, role and, if asked for, text: the prompts (user) and responses (assistant) of a conversation in their order.

    A call gives a message for its prompt and one for its response, unless that is null.
    """
    c = _once(table(spark, d, "llm_call_metrics", "id", "conversation_id", "call_ts", "prompt", "response"), "id", "conversation_id is not null", "conversation_id")
    both = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(role).alias("role"), F.col(text).alias("text")) for k, (role, text) in enumerate((("user", "prompt"), ("assistant", "response")))))
    rows = c.select("conversation_id", "id", F.col("call_ts").alias("said_at"), F.inline(F.filter(both, lambda m: m["text"].isNotNull())))
    return rows.select("conversation_id", "id", "said_at", "part", "role", *texts)


_KEY = "nullif(lower(trim({0}, ' ' || chr(9))), '')"
_CONV = _KEY.format("conversation_id")

#: The same for DuckDB, as common table expressions.
SQL_MODEL = f"""
executions AS (SELECT DISTINCT id, agent_name, {_CONV} AS conversation_id, decision, confidence, token_usage_input, token_usage_output, latency_ms, status, error_message, created_at FROM agent_executions),
calls AS (SELECT DISTINCT id, agent_name, {_CONV} AS conversation_id, call_ts, model, success, latency_ms, input_tokens, output_tokens, total_tokens, estimated_cost, context_relevance_score,
  answer_relevance_score, faithfulness_score, response_quality_score, retry_count, http_status_code FROM llm_call_metrics),
convs AS (SELECT {_CONV} AS conversation_id, arg_min(user_id, created_at) AS user_id, arg_min(repo_url, created_at) AS repo_url, arg_min(repo_name, created_at) AS repo_name, arg_min(mode, created_at) AS mode,
  arg_min(is_active, created_at) AS is_active, min(created_at) AS created_at, max(last_activity) AS last_activity FROM conversations GROUP BY {_CONV}),
wfs AS (SELECT DISTINCT ON (workflow_id) * FROM (SELECT * REPLACE ({_KEY.format("workflow_id")} AS workflow_id, {_CONV} AS conversation_id) FROM workflows)),
messages AS (SELECT conversation_id, id, said_at, part, role, text FROM (
  SELECT {_CONV} AS conversation_id, id, call_ts AS said_at, 0 AS part, 'user' AS role, prompt AS text FROM llm_call_metrics UNION SELECT {_CONV}, id, call_ts, 1, 'assistant', response FROM llm_call_metrics) m
  WHERE conversation_id IS NOT NULL AND text IS NOT NULL)
"""
