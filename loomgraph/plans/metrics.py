"""Queries over executions and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import metrics as m
from loomgraph.sources import model
from loomgraph.sources.tables import table

_CTE = "WITH " + model.SQL_MODEL
QUERIES, SQL = {}, {}


def query(sql: str):
    """Registers a query with its SQL, which may use the CTEs of the model."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _CTE + sql
        return f

    return add


def _last(spark, d, name, time, days):
    """The condition for rows of the last days of a table."""
    return F.col(time) > m.last_time(table(spark, d, name, time), time) - F.make_dt_interval(F.lit(days))


_PERFORMANCE = """agent_name, count(*) AS executions, avg(latency_ms) AS avg_latency, max(latency_ms) AS max_latency, min(latency_ms) AS min_latency,
 avg(token_usage_input + token_usage_output) AS avg_tokens, count(CASE WHEN status = 'SUCCESS' THEN 1 END) AS successes, count(CASE WHEN status = 'FAILED' THEN 1 END) AS failures,
 round(count(CASE WHEN status = 'SUCCESS' THEN 1 END) * 100.0 / count(*), 2) AS success_rate FROM executions"""


@query(f"SELECT {_PERFORMANCE} GROUP BY agent_name")
def agent_performance(spark, d):
    return m.agent_performance(model.executions(spark, d))


@query(f"SELECT {_PERFORMANCE} WHERE created_at > (SELECT max(created_at) FROM executions) - INTERVAL 7 DAY GROUP BY agent_name")
def agent_performance_7d(spark, d):
    return m.agent_performance(model.executions(spark, d, _last(spark, d, "agent_executions", "created_at", 7)))


@query("""SELECT agent_name, CAST(coalesce(sum(token_usage_input), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(token_usage_output), 0) AS BIGINT) AS tokens_out,
 CAST(coalesce(sum(token_usage_input), 0) + coalesce(sum(token_usage_output), 0) AS BIGINT) AS tokens FROM executions GROUP BY agent_name""")  # fmt: skip
def token_usage_by_agent(spark, d):
    return m.token_usage(model.executions(spark, d))


@query("SELECT agent_name, decision, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(12,4))) AS DOUBLE) / nullif(count(confidence), 0) AS avg_confidence FROM executions WHERE decision IS NOT NULL GROUP BY agent_name, decision")
def decision_breakdown(spark, d):
    return m.decision_breakdown(model.executions(spark, d))


@query("SELECT status, count(*) AS n FROM executions GROUP BY status")
def executions_by_status(spark, d):
    return model.executions(spark, d).groupBy("status").agg(F.count("*").alias("n"))


_USAGE = """count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out, CAST(sum(total_tokens) AS BIGINT) AS tokens,
 CAST(sum(CAST(estimated_cost AS DECIMAL(18,8))) AS DOUBLE) AS cost, avg(CASE WHEN latency_ms >= 0 THEN latency_ms END) AS avg_latency, count(CASE WHEN NOT success THEN 1 END) AS failed,
 round(count(CASE WHEN NOT success THEN 1 END) * 100.0 / count(*), 2) AS error_rate FROM calls"""


@query(f"SELECT agent_name, {_USAGE} GROUP BY agent_name")
def llm_usage_by_agent(spark, d):
    return m.call_usage(model.calls(spark, d), "agent_name")


@query(f"SELECT agent_name, {_USAGE} WHERE call_ts > (SELECT max(call_ts) FROM calls) - INTERVAL 7 DAY GROUP BY agent_name")
def llm_usage_7d(spark, d):
    return m.call_usage(model.calls(spark, d, _last(spark, d, "llm_call_metrics", "call_ts", 7)), "agent_name")


@query(f"SELECT model, date_trunc('month', call_ts) AS month, {_USAGE} GROUP BY model, date_trunc('month', call_ts)")
def llm_usage_by_model_month(spark, d):
    return m.call_usage(model.calls(spark, d).withColumn("month", F.date_trunc("month", "call_ts").cast("timestamp_ntz")), "model", "month")


@query(f"SELECT conversation_id, {_USAGE} WHERE conversation_id IS NOT NULL GROUP BY conversation_id")
def conversation_metrics(spark, d):
    return m.call_usage(model.calls(spark, d, "conversation_id is not null"), "conversation_id")


@query(f"SELECT {_USAGE} WHERE call_ts > (SELECT max(call_ts) FROM calls) - INTERVAL 1 DAY")
def llm_error_rate_24h(spark, d):
    return m.call_usage(model.calls(spark, d, _last(spark, d, "llm_call_metrics", "call_ts", 1)))


@query("""SELECT agent_name, CAST(sum(CAST(context_relevance_score AS DECIMAL(12,4))) AS DOUBLE) / nullif(count(context_relevance_score), 0) AS context_relevance_score, CAST(sum(CAST(answer_relevance_score AS DECIMAL(12,4))) AS DOUBLE) / nullif(count(answer_relevance_score), 0) AS answer_relevance_score,
 CAST(sum(CAST(faithfulness_score AS DECIMAL(12,4))) AS DOUBLE) / nullif(count(faithfulness_score), 0) AS faithfulness_score, CAST(sum(CAST(response_quality_score AS DECIMAL(12,4))) AS DOUBLE) / nullif(count(response_quality_score), 0) AS response_quality_score FROM calls WHERE success GROUP BY agent_name""")  # fmt: skip
def quality_by_agent(spark, d):
    return m.quality_scores(model.calls(spark, d))


@query("""SELECT id, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens,
 round(CASE WHEN latency_ms > 0 THEN (coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) * 1000.0E0 / latency_ms ELSE 0.0E0 END, 4) AS tokens_per_second FROM calls""")  # fmt: skip
def llm_call_derived(spark, d):
    return m.derived_calls(model.calls(spark, d))


@query("SELECT id, agent_name, latency_ms FROM executions WHERE latency_ms IS NOT NULL ORDER BY latency_ms DESC, id LIMIT 20")
def slowest_executions(spark, d):
    return m.slowest(model.executions(spark, d).select("id", "agent_name", "latency_ms"), 20)


@query("SELECT id, agent_name, created_at FROM executions WHERE status = 'FAILED' ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_failures(spark, d):
    return model.executions(spark, d, "status = 'FAILED'").select("id", "agent_name", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(50)


@query("SELECT id, agent_name, call_ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY call_ts DESC, id DESC) AS rank FROM calls) t WHERE rank <= 10")
def recent_llm_calls(spark, d):
    return m.top_per_group(model.calls(spark, d).select("id", "agent_name", "call_ts"), ["agent_name"], [F.desc("call_ts"), F.desc("id")], 10)


@query("SELECT id, agent_name, retry_count, http_status_code FROM calls WHERE retry_count > 2")
def llm_calls_high_retry(spark, d):
    return model.calls(spark, d, "retry_count > 2").select("id", "agent_name", "retry_count", "http_status_code")


@query("SELECT id, agent_name, call_ts FROM calls WHERE NOT success AND call_ts BETWEEN TIMESTAMP '2025-06-01' AND TIMESTAMP '2025-12-31'")
def llm_calls_failed_between(spark, d):
    return model.calls(spark, d, "not success and call_ts between timestamp_ntz '2025-06-01' and timestamp_ntz '2025-12-31'").select("id", "agent_name", "call_ts")


@query("""SELECT agent_name, day, calls, CAST(sum(calls) OVER (PARTITION BY agent_name ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_calls
 FROM (SELECT agent_name, CAST(call_ts AS DATE) AS day, count(*) AS calls FROM calls WHERE call_ts IS NOT NULL GROUP BY agent_name, CAST(call_ts AS DATE)) t""")  # fmt: skip
def llm_rolling_week(spark, d):
    return m.rolling_usage(model.calls(spark, d), 7)


@query("""SELECT conversation_id, CAST(session AS BIGINT) AS session, min(call_ts) AS started, max(call_ts) AS ended, count(*) AS calls FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR call_ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY call_ts, id) AS session FROM (
    SELECT *, lag(call_ts) OVER (PARTITION BY conversation_id ORDER BY call_ts, id) AS prev FROM calls WHERE conversation_id IS NOT NULL) a) b GROUP BY conversation_id, session""")  # fmt: skip
def llm_sessions(spark, d):
    return m.sessions(model.calls(spark, d, "conversation_id is not null").select("id", "conversation_id", "call_ts"), 30)


@query("""SELECT 'conversations' AS table_name, (SELECT count(*) FROM convs) AS n UNION ALL SELECT 'workflows', (SELECT count(*) FROM wfs) UNION ALL SELECT 'agent_executions', (SELECT count(*) FROM executions)
 UNION ALL SELECT 'llm_call_metrics', (SELECT count(*) FROM calls)""")  # fmt: skip
def table_row_counts(spark, d):
    counts = None
    for name, df in (("conversations", model.conversations), ("workflows", model.workflows), ("agent_executions", model.executions), ("llm_call_metrics", model.calls)):
        one = df(spark, d).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("""SELECT c.conversation_id, c.user_id, count(w.workflow_id) AS workflows, max(w.started_at) AS last_started FROM convs c LEFT JOIN wfs w ON w.conversation_id = c.conversation_id
 GROUP BY c.conversation_id, c.user_id""")  # fmt: skip
def conversation_workflow_rollup(spark, d):
    w = model.workflows(spark, d, "conversation_id is not null").groupBy("conversation_id").agg(F.count("*").alias("workflows"), F.max("started_at").alias("last_started"))
    return model.conversations(spark, d).join(w, "conversation_id", "left").select("conversation_id", "user_id", F.coalesce("workflows", F.lit(0)).alias("workflows"), "last_started")


@query("SELECT conversation_id, user_id FROM convs c WHERE EXISTS (SELECT 1 FROM wfs w WHERE w.conversation_id = c.conversation_id AND w.status IN ('RUNNING', 'PAUSED'))")
def conversations_with_running_workflows(spark, d):
    running = model.workflows(spark, d, F.col("status").isin("RUNNING", "PAUSED"))
    return model.conversations(spark, d).join(running, "conversation_id", "left_semi").select("conversation_id", "user_id")


@query("SELECT user_id, count(*) AS active FROM convs WHERE is_active GROUP BY user_id")
def active_conversations_per_user(spark, d):
    return model.conversations(spark, d).filter("is_active").groupBy("user_id").agg(F.count("*").alias("active"))


@query("SELECT conversation_id, last_activity FROM convs WHERE is_active AND last_activity < (SELECT max(last_activity) FROM convs) - INTERVAL 90 DAY")
def conversations_stale(spark, d):
    c = model.conversations(spark, d)
    before = m.last_time(table(spark, d, "conversations", "last_activity"), "last_activity") - F.make_dt_interval(F.lit(90))
    return c.filter("is_active").filter(F.col("last_activity") < before).select("conversation_id", "last_activity")


@query("SELECT conversation_id, workflow_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY started_at DESC, workflow_id DESC) AS n FROM wfs WHERE started_at IS NOT NULL AND conversation_id IS NOT NULL) w WHERE n = 1")
def latest_workflow_per_conversation(spark, d):
    """Of workflows with the same start the one with the larger id."""
    w = model.workflows(spark, d, "started_at is not null and conversation_id is not null")
    return w.groupBy("conversation_id").agg(F.max(F.struct("started_at", "workflow_id")).alias("w")).select("conversation_id", "w.workflow_id", "w.started_at")


@query("SELECT status, count(*) AS n, round(avg(CASE WHEN completed_at >= started_at THEN epoch_ms(completed_at) - epoch_ms(started_at) END) / 1000.0, 1) AS avg_seconds FROM wfs GROUP BY status")
def workflows_by_status(spark, d):
    took = F.when(F.col("completed_at") >= F.col("started_at"), F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp")))
    return model.workflows(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(took) / 1000.0, 1).alias("avg_seconds"))


@query("SELECT workflow_id, json_extract_string(state_json, '$.repo') AS repo, CAST(json_extract_string(state_json, '$.step') AS INT) AS step FROM wfs")
def workflow_state_fields(spark, d):
    return model.workflows(spark, d).select("workflow_id", F.get_json_object("state_json", "$.repo").alias("repo"), F.get_json_object("state_json", "$.step").cast("int").alias("step"))


@query("SELECT id, created_at FROM executions WHERE created_at >= (SELECT max(created_at) FROM executions) - INTERVAL 180 DAY")
def retention_filter(spark, d):
    e = model.executions(spark, d, F.col("created_at") >= m.last_time(table(spark, d, "agent_executions", "created_at"), "created_at") - F.make_dt_interval(F.lit(180)))
    return e.select("id", "created_at")


@query("""SELECT agent_name, count(*) AS calls, count(CASE WHEN NOT success THEN 1 END) AS failed, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, coalesce(CAST(sum(CAST(estimated_cost AS DECIMAL(18,8))) AS DOUBLE), 0) AS cost,
 coalesce(avg(CASE WHEN latency_ms >= 0 THEN latency_ms END), 0) AS avg_latency, round(count(CASE WHEN success THEN 1 END) * 100.0 / count(*), 2) AS success_rate, """
 + ", ".join(f"CAST(sum(CASE WHEN success THEN CAST({c} AS DECIMAL(12,4)) END) AS DOUBLE) / nullif(count(CASE WHEN success THEN {c} END), 0) AS {c}" for c in m.SCORES) + " FROM calls GROUP BY agent_name")
def agent_stats(spark, d):
    return m.agent_stats(model.calls(spark, d))
