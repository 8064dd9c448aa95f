"""Conversations, workflows and executions: finders, joins, timelines and messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import finders as f
from loomgraph.operators import metrics as m
from loomgraph.sources import graph, model
from loomgraph.sources.tables import table

_CTE = "WITH " + model.SQL_MODEL + f", nodes AS ({graph.NODES_SQL}), edges AS ({graph.EDGES_SQL}) "
QUERIES, SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = _CTE + sql
        return fn

    return add


@query("SELECT node_id, fqn FROM nodes WHERE repo = 'tpch' AND node_type = 'FIELD' AND domain = 'medium'")
def nodes_by(spark, d):
    return f.where_all(graph.nodes(spark, d), repo="tpch", node_type="FIELD", domain="medium").select("node_id", "fqn")


@query("SELECT node_id, node_type FROM nodes WHERE repo = 'tpch' AND domain = 'supply' AND node_type IN ('METHOD', 'CLASS')")
def nodes_by_domain_types_in(spark, d):
    return f.where_all(graph.nodes(spark, d), repo="tpch", domain="supply", node_type=["METHOD", "CLASS"]).select("node_id", "node_type")


@query("SELECT node_id, node_type, simple_name FROM nodes WHERE lower(simple_name) LIKE '%supplier%'")
def nodes_name_search(spark, d):
    return f.name_contains(graph.nodes(spark, d), "simple_name", "Supplier").select("node_id", "node_type", "simple_name")


@query("SELECT node_id, features FROM nodes WHERE list_contains(string_split(features, ','), 'red')")
def nodes_by_feature(spark, d):
    return f.listed(graph.nodes(spark, d), "features", "red").select("node_id", "features")


@query("SELECT node_id, concepts FROM nodes WHERE list_contains(string_split(concepts, ','), '12')")
def nodes_by_concept(spark, d):
    return f.listed(graph.nodes(spark, d), "concepts", "12").select("node_id", "concepts")


@query("SELECT node_id FROM nodes WHERE contains(summary, 'Roles:') AND contains(summary, 'root')")
def find_by_role(spark, d):
    return f.has_role(graph.nodes(spark, d), "root").select("node_id")


@query("SELECT source_id, target_id FROM edges WHERE kind IN ('USES', 'INJECTS') AND repo = 'tpch' AND target_id IN ('N:3', 'S:7')")
def edges_by(spark, d):
    return f.where_all(graph.edges(spark, d), kind=["USES", "INJECTS"], repo="tpch", target_id=["N:3", "S:7"]).select("source_id", "target_id")


@query("SELECT repo, count(*) AS n FROM nodes GROUP BY repo")
def nodes_per_repo(spark, d):
    return graph.nodes(spark, d).groupBy("repo").agg(F.count("*").alias("n"))


@query("SELECT id, conversation_id, created_at, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS place FROM executions WHERE conversation_id IS NOT NULL AND created_at >= TIMESTAMP '2025-03-01'")
def executions_by_conversation(spark, d):
    """The timeline of each conversation, from a date on."""
    e = model.executions(spark, d, "conversation_id is not null and created_at >= timestamp_ntz '2025-03-01'").select("id", "conversation_id", "created_at")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "id")))


@query("SELECT id, agent_name, created_at FROM executions WHERE agent_name IN (SELECT min(agent_name) FROM executions) AND created_at BETWEEN TIMESTAMP '2025-02-01' AND TIMESTAMP '2026-02-01'")
def executions_agent_between(spark, d):
    first = table(spark, d, "agent_executions", "agent_name").agg(F.min("agent_name")).scalar()
    return model.executions(spark, d, (F.col("agent_name") == first) & F.expr("created_at between timestamp_ntz '2025-02-01' and timestamp_ntz '2026-02-01'")).select("id", "agent_name", "created_at")


@query("SELECT workflow_id, status FROM wfs WHERE status IN ('PAUSED', 'FAILED')")
def workflows_by_status_in(spark, d):
    return model.workflows(spark, d, F.col("status").isin("PAUSED", "FAILED")).select("workflow_id", "status")


@query("SELECT workflow_id, started_at FROM wfs WHERE status IN ('RUNNING', 'PAUSED') AND started_at < (SELECT max(started_at) FROM wfs) - INTERVAL 30 DAY")
def workflow_states_stale(spark, d):
    last = m.last_time(table(spark, d, "workflows", "started_at"), "started_at") - F.make_dt_interval(F.lit(30))
    return model.workflows(spark, d, F.col("status").isin("RUNNING", "PAUSED") & (F.col("started_at") < last)).select("workflow_id", "started_at")


@query("SELECT c.conversation_id, EXISTS (SELECT 1 FROM wfs w WHERE w.conversation_id = c.conversation_id) AS has_workflow FROM convs c")
def workflow_exists(spark, d):
    w = model.workflows(spark, d, "conversation_id is not null").select("conversation_id", F.lit(True).alias("has_workflow")).distinct()
    return model.conversations(spark, d).select("conversation_id").join(w, "conversation_id", "left").fillna(False)


@query("SELECT workflow_id, started_at FROM wfs WHERE completed_at IS NULL OR status IN ('RUNNING', 'PAUSED') OR completed_at >= (SELECT max(completed_at) FROM wfs) - INTERVAL 120 DAY")
def workflow_retention(spark, d):
    """Only ended workflows are removed when they are old; running and paused ones stay."""
    last = m.last_time(table(spark, d, "workflows", "completed_at"), "completed_at") - F.make_dt_interval(F.lit(120))
    return model.workflows(spark, d, F.col("completed_at").isNull() | F.col("status").isin("RUNNING", "PAUSED") | (F.col("completed_at") >= last)).select("workflow_id", "started_at")


@query("SELECT w.workflow_id, w.conversation_id, c.user_id, c.created_at FROM wfs w LEFT JOIN convs c ON c.conversation_id = w.conversation_id")
def workflow_with_conversation(spark, d):
    w = model.workflows(spark, d).select("workflow_id", "conversation_id")
    return w.join(model.conversations(spark, d).select("conversation_id", "user_id", "created_at"), "conversation_id", "left")


@query("""SELECT c.conversation_id, count(w.workflow_id) AS workflows, array_to_string(list(w.workflow_id || ':' || w.status ORDER BY w.started_at, w.workflow_id) FILTER (WHERE w.workflow_id IS NOT NULL), ' ') AS listing
 FROM convs c LEFT JOIN wfs w ON w.conversation_id = c.conversation_id GROUP BY c.conversation_id""")  # fmt: skip
def conversation_with_workflows(spark, d):
    """Each conversation with the list of its workflows in the order of their start, nested and here as text; workflows without a status aren't named."""
    w = model.workflows(spark, d, "conversation_id is not null").select("conversation_id", F.struct("started_at", "workflow_id", F.concat_ws(":", "workflow_id", "status").alias("text")).alias("w"))
    nested = w.groupBy("conversation_id").agg(F.count("*").alias("workflows"), F.array_join(F.transform(F.sort_array(F.collect_list("w")), lambda x: x["text"]), " ").alias("listing"))
    return model.conversations(spark, d).select("conversation_id").join(nested, "conversation_id", "left").fillna(0, ["workflows"])


@query("SELECT conversation_id, min(started_at) AS created_at, count(*) AS workflows FROM wfs w WHERE conversation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM convs c WHERE c.conversation_id = w.conversation_id) GROUP BY conversation_id")
def migrate_conversations(spark, d):
    """Conversations to be made for the workflows that refer to none."""
    w = model.workflows(spark, d, "conversation_id is not null").select("conversation_id", "started_at")
    return w.join(model.conversations(spark, d), "conversation_id", "left_anti").groupBy("conversation_id").agg(F.min("started_at").alias("created_at"), F.count("*").alias("workflows"))


@query("SELECT (SELECT count(*) FROM convs) AS conversations, (SELECT count(*) FROM wfs) AS workflows, (SELECT count(*) FROM executions) AS executions")
def scalar_subquery_counts(spark, d):
    one = lambda df: df.agg(F.count("*")).scalar()
    return spark.range(1).select(one(model.conversations(spark, d)).alias("conversations"), one(model.workflows(spark, d)).alias("workflows"), one(model.executions(spark, d)).alias("executions"))


@query("SELECT conversation_id, user_id, last_activity, row_number() OVER (PARTITION BY user_id ORDER BY last_activity DESC NULLS LAST, conversation_id) AS place FROM convs")
def conversations_by_user(spark, d):
    c = model.conversations(spark, d).select("conversation_id", "user_id", "last_activity")
    return c.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("last_activity"), "conversation_id")))


@query("SELECT workflow_id, completed_at FROM wfs ORDER BY completed_at DESC NULLS LAST, workflow_id LIMIT 100")
def recently_completed(spark, d):
    return model.workflows(spark, d).select("workflow_id", "completed_at").orderBy(F.desc_nulls_last("completed_at"), "workflow_id").limit(100)


@query("SELECT id, coalesce(token_usage_input, 0) + coalesce(token_usage_output, 0) AS tokens, latency_ms / 1000.0E0 AS seconds FROM executions")
def execution_helpers(spark, d):
    tokens = F.coalesce("token_usage_input", F.lit(0)) + F.coalesce("token_usage_output", F.lit(0))
    return model.executions(spark, d).select("id", tokens.alias("tokens"), (F.col("latency_ms") / 1000.0).alias("seconds"))


@query("SELECT agent_name, array_to_string(list(DISTINCT decision ORDER BY decision), ', ') AS decisions, count(DISTINCT decision) AS n FROM executions WHERE decision IS NOT NULL GROUP BY agent_name")
def decisions_listed(spark, d):
    e = model.executions(spark, d, "decision is not null").groupBy("agent_name").agg(F.sort_array(F.collect_set("decision")).alias("x"))
    return e.select("agent_name", F.array_join("x", ", ").alias("decisions"), F.size("x").cast("bigint").alias("n"))


_ORDERED = "SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY said_at, id, part) AS turn, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages"


def _turns(spark, d):
    """Messages with their turn: hours of a conversation are numbered by themselves, and the messages before each hour added, so that no conversation is one task's."""
    msg = model.messages(spark, d).withColumn("hour", F.date_trunc("hour", "said_at"))
    own = Window.partitionBy("conversation_id", "hour").orderBy("said_at", "id", "part")
    before = Window.partitionBy("conversation_id").orderBy("hour")
    hours = msg.groupBy("conversation_id", "hour").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hours = hours.withColumn("total", F.sum("n").over(Window.partitionBy("conversation_id"))).select("conversation_id", F.col("hour").alias("_h"), "before", "total")
    numbered = msg.withColumn("place", F.row_number().over(own)).withColumnRenamed("conversation_id", "_c")
    joined = numbered.join(hours, (F.col("_c") == F.col("conversation_id")) & F.col("hour").eqNullSafe(F.col("_h")))
    return joined.select("conversation_id", (F.col("before") + F.col("place")).alias("turn"), "role", "id", "total")


@query(f"SELECT conversation_id, turn, role, id FROM ({_ORDERED}) x")
def message_history(spark, d):
    """Messages of each conversation in their order; prompts are the user's, responses the assistant's."""
    return _turns(spark, d).select("conversation_id", "turn", "role", "id")


@query(f"SELECT conversation_id, turn, role, id FROM ({_ORDERED}) x WHERE turn > (SELECT count(*) FROM messages s WHERE s.conversation_id = x.conversation_id AND s.said_at < TIMESTAMP '2025-09-01')")
def new_messages_since(spark, d):
    """What is to be appended to a store that has the messages before a date: everything beyond its number of messages, by position."""
    stored = model.messages(spark, d).filter("said_at < timestamp_ntz '2025-09-01'").groupBy("conversation_id").agg(F.count("*").alias("stored"))
    return _turns(spark, d).join(stored, "conversation_id", "left").filter("turn > coalesce(stored, 0)").select("conversation_id", "turn", "role", "id")


@query(f"SELECT conversation_id, max(n) AS messages, coalesce(max(CASE WHEN turn = n THEN role END) = 'user' AND max(n) >= 2, false) AS responded FROM ({_ORDERED}) x GROUP BY conversation_id")
def user_just_responded(spark, d):
    last = F.max(F.struct("said_at", "id", "part", "role"))["role"]
    return model.messages(spark, d).groupBy("conversation_id").agg(F.count("*").alias("messages"), (last == "user").alias("u")).select("conversation_id", "messages", F.coalesce(F.col("u") & (F.col("messages") >= 2), F.lit(False)).alias("responded"))


_BRANCH = r"regexp_extract(p, '/(?:-/)?(?:tree|src)/(.+)$', 1)"
_BASE = r"regexp_replace(regexp_replace(p, '/(?:-/)?(?:tree|src)/.*$', ''), '\.git$', '')"


@query(rf"""SELECT conversation_id, CASE WHEN ok THEN base END AS clone_url, CASE WHEN ok THEN CASE WHEN {_BRANCH} <> '' THEN {_BRANCH} ELSE 'main' END END AS branch, CASE WHEN ok THEN name END AS repo_name FROM (
 SELECT *, coalesce(name <> '' AND regexp_matches(base, '[/:]'), false) AS ok FROM (SELECT *, regexp_extract(base, '([^/:]+)$', 1) AS name FROM (SELECT *, {_BASE} AS base FROM (
  SELECT conversation_id, regexp_replace(regexp_replace(trim(repo_url, ' ' || chr(9)), '[?#].*$', ''), '/+$', '') AS p FROM convs WHERE repo_url IS NOT NULL) a) b) c) e""")  # fmt: skip
def parse_git_url(spark, d):
    c = model.conversations(spark, d).filter("repo_url is not null")
    return c.select("conversation_id", f.parse_git_url(F.col("repo_url")).alias("u")).select("conversation_id", "u.*")


@query(r"""SELECT conversation_id, coalesce(length(u) BETWEEN 1 AND 2048 AND NOT regexp_matches(u, '[\s;|&$`<>\\''"(){}]') AND NOT contains(u, '..') AND regexp_matches(u, '^(?:(?:https?|ssh|git)://[\w.@:\-]+/|[\w.\-]+@[\w.\-]+:)[\w.\-/~?=%]+$'), false) AS valid FROM (SELECT conversation_id, repo_url AS u FROM convs) c""")
def git_input_valid(spark, d):
    return model.conversations(spark, d).select("conversation_id", f.valid_git_url(F.col("repo_url")).alias("valid"))


@query("SELECT doc_id, file_path FROM documents WHERE source <> 'DELETE' AND file_path LIKE '%Parser.md'")
def changed_files(spark, d):
    """The kind of change is taken from ``source`` here: the tables have no list of changes."""
    return f.changed_files(table(spark, d, "documents", "doc_id", "source", "file_path"), "source", "file_path", "Parser.md").select("doc_id", "file_path")


@query("SELECT DISTINCT id FROM (SELECT id, annotations FROM classes UNION ALL SELECT id, annotations FROM methods) a WHERE list_has_all(annotations, ['Entity'])")
def containment(spark, d):
    both = table(spark, d, "classes", "id", "annotations").unionByName(table(spark, d, "methods", "id", "annotations"))
    return both.filter(f.contains_all(F.col("annotations"), ["Entity"])).select("id").distinct()


@query("""SELECT c.user_id, count(*) AS calls, count(DISTINCT c.conversation_id) AS conversations FROM calls k JOIN convs c ON c.conversation_id = k.conversation_id GROUP BY c.user_id""")
def calls_per_user(spark, d):
    """Calls are counted by conversation before they are joined, so that a busy conversation is no hot key."""
    k = model.calls(spark, d, "conversation_id is not null").groupBy("conversation_id").agg(F.count("*").alias("n"))
    return model.conversations(spark, d).join(k, "conversation_id").groupBy("user_id").agg(F.sum("n").alias("calls"), F.count("*").alias("conversations"))
