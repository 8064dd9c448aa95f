"""Writes, followed by a read of what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import metrics as m
from loomgraph.operators import sinks as s
from loomgraph.session import scratch
from loomgraph.sources import graph, model
from loomgraph.sources.tables import table

_CTE = "WITH " + model.SQL_MODEL + f", nodes AS ({graph.NODES_SQL}), edges AS ({graph.EDGES_SQL}) "
QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _CTE + sql
        return f

    return add


def _nodes(spark, d):
    """The repositories of the graph are the kinds of its nodes here, so that there are several to be replaced."""
    return graph.nodes(spark, d).select("node_id", F.element_at(F.split("node_id", ":"), 1).alias("repo"), "simple_name")


def _edges(spark, d):
    return graph.edges(spark, d).select("source_id", "target_id", "kind", F.element_at(F.split("source_id", ":"), 1).alias("repo"))


@query("""SELECT node_id, split_part(node_id, ':', 1) AS repo, CASE WHEN node_id LIKE 'S:%' THEN upper(simple_name) || '!' ELSE simple_name END AS simple_name FROM nodes""")
def replace_repo_partition(spark, d):
    """A table of nodes by repository, in which one repository is written again with other names; twice, as after a failure."""
    path, nodes = scratch(spark, "nodes"), _nodes(spark, d)
    s.replace_partitions(nodes, path)
    for _ in range(2):
        s.replace_partitions(nodes.filter("repo = 'S'").withColumn("simple_name", F.concat(F.upper("simple_name"), F.lit("!"))), path)
    return spark.read.schema(nodes.schema).parquet(path)


@query("""SELECT id, max(name) AS name, max(class_type) AS class_type, count(*) AS n FROM (SELECT DISTINCT id, CASE WHEN class_type = 'INTERFACE' THEN lower(name) ELSE name END AS name, class_type FROM classes
 UNION SELECT 'new-' || id, name, class_type FROM classes) c GROUP BY id""")  # fmt: skip
def upsert_entities(spark, d):
    """Classes with those whose key is there changed, and others added; ``n`` shows that each is there once."""
    old = table(spark, d, "classes", "id", "name", "class_type").distinct()
    new = old.filter("class_type = 'INTERFACE'").withColumn("name", F.lower("name")).unionByName(old.withColumn("id", F.concat(F.lit("new-"), F.col("id"))))
    return s.merge_entities(old, new).groupBy("id").agg(F.max("name").alias("name"), F.max("class_type").alias("class_type"), F.count("*").alias("n"))


@query("""SELECT source_id, target_id, kind, CASE WHEN kind = 'USES' AND source_id LIKE 'C:%' THEN '2' ELSE '1' END AS weight, '1' AS since FROM edges WHERE repo = 'tpch'
 UNION ALL SELECT DISTINCT target_id, source_id, 'BACK', '3', NULL FROM edges WHERE repo = 'tpch' AND kind = 'EXTENDS'""")  # fmt: skip
def upsert_relationships(spark, d):
    """Edges with properties: those of one kind get a new weight and keep what else they have, new ones are added if both their ends are nodes."""
    text = lambda **kv: F.create_map(*(F.lit(x) for pair in kv.items() for x in pair))
    e = graph.edges(spark, d).filter("repo = 'tpch'").select("source_id", "target_id", "kind")
    old = e.withColumn("properties", text(weight="1", since="1"))
    changed = e.filter("kind = 'USES' and source_id like 'C:%'").withColumn("properties", text(weight="2"))
    back = e.filter("kind = 'EXTENDS'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("BACK").alias("kind"), text(weight="3").alias("properties"))
    nowhere = e.filter("kind = 'EXTENDS'").select("source_id", F.concat("target_id", F.lit("?")).alias("target_id"), "kind", text(weight="4").alias("properties"))
    merged = s.merge_relationships(old, changed.unionByName(back).unionByName(nowhere), graph.nodes(spark, d))
    get = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return merged.select("source_id", "target_id", "kind", get("weight"), get("since"))


@query("SELECT source_id, target_id, kind FROM edges e WHERE source_id IN (SELECT node_id FROM nodes) AND target_id IN (SELECT node_id FROM nodes)")
def edges_with_endpoints(spark, d):
    """Orders and events are no nodes, so their edges are left out."""
    return s.with_endpoints(graph.edges(spark, d), graph.nodes(spark, d)).select("source_id", "target_id", "kind")


@query("""SELECT 'node' AS part, node_id AS a, '' AS b FROM nodes WHERE node_id NOT LIKE 'N:%' UNION ALL SELECT 'edge', source_id, target_id FROM edges WHERE source_id NOT LIKE 'N:%' AND target_id NOT LIKE 'N:%'""")
def delete_repository(spark, d):
    """Nodes and edges after one repository was deleted with all that hangs on it."""
    nodes, edges = s.delete_repository(_nodes(spark, d), _edges(spark, d), "N")
    return nodes.select(F.lit("node").alias("part"), F.col("node_id").alias("a"), F.lit("").alias("b")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("a"), F.col("target_id").alias("b")))


@query("SELECT id, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS tokens, 2 AS copies FROM calls")
def append_metric_rows(spark, d):
    """Derived rows of calls, appended to a table twice."""
    path = scratch(spark, "calls")
    rows = m.derived_calls(model.calls(spark, d)).select("id", "tokens")
    for _ in range(2):
        s.append(rows, path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("id", "tokens").agg(F.count("*").alias("copies"))


@query("SELECT id, created_at FROM executions WHERE created_at >= TIMESTAMP '2025-06-01'")
def retention_delete(spark, d):
    """A stored table after its rows before a date were deleted."""
    path = scratch(spark, "executions")
    s.append(model.executions(spark, d).select("id", "created_at"), path)
    s.retain(path, spark.read.parquet(path), F.col("created_at") >= F.expr("timestamp_ntz '2025-06-01'"))
    return spark.read.parquet(path)
