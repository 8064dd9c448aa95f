"""From questions to nodes and files; sources as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import scope as s
from loomgraph.operators.metrics import top_per_group
from loomgraph.sources import files, graph
from loomgraph.sources.tables import table

_CTE = f"WITH nodes AS ({graph.NODES_SQL}), edges AS ({graph.EDGES_SQL}) "
QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _CTE + sql
        return f

    return add


#: Questions and hits are taken from the orders' parts: each supplier asks for its parts, whose brands are the names that were found.
_HITS = "hits AS (SELECT 'S:' || CAST(l_suppkey AS VARCHAR) AS asked, 'cat.x.' || p_name AS name, round(max(l_quantity) / 50.0E0, 4) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


def _hits(spark, d, least=None):
    """Lines below ``least`` are left out before they are summed up: a part has that score if one of its lines has it."""
    lines = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity")
    if least is not None:
        lines = lines.filter(F.round(F.col("l_quantity") / 50.0, 4) >= least)
    lines = lines.groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    rows = lines.join(table(spark, d, "part", F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return rows.groupBy(F.concat(F.lit("S:"), F.col("l_suppkey").cast("string")).alias("asked"), F.concat(F.lit("cat.x."), "p_name").alias("name")).agg(F.round(F.max("q") / 50.0, 4).alias("score"))


_MATCHED = "m AS (SELECT asked, n, rank, node_id FROM (SELECT asked, split_part(name, '.', -1) AS n, row_number() OVER (PARTITION BY asked ORDER BY max(score) DESC, split_part(name, '.', -1)) AS rank FROM hits {} GROUP BY asked, split_part(name, '.', -1)) h JOIN nodes ON simple_name = n WHERE rank <= 3)"


@query(f", {_HITS}, {_MATCHED.format('')} SELECT DISTINCT asked, rank AS place, node_id FROM m")
def match_to_nodes(spark, d):
    return s.match_to_nodes(_hits(spark, d), graph.nodes(spark, d))


@query(f", {_HITS} SELECT asked, split_part(name, '.', -1) AS name FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, split_part(name, '.', -1)) AS n FROM hits) h WHERE n <= 3")
def top_classes(spark, d):
    hits = _hits(spark, d).select("asked", F.element_at(F.split("name", r"\."), -1).alias("name"), "score")
    return top_per_group(hits, ["asked"], [F.desc("score"), F.col("name")], 3).select("asked", "name")


@query("SELECT domain, node_id FROM nodes WHERE domain IS NOT NULL UNION SELECT a.domain, b.node_id FROM nodes a JOIN edges e ON e.source_id = a.node_id JOIN nodes b ON b.node_id = e.target_id WHERE a.domain = b.domain")
def expand_same_domain(spark, d):
    n = graph.nodes(spark, d)
    return s.expand_same_domain(n.filter("domain is not null").select("domain", "node_id"), graph.edges(spark, d), n)


@query("SELECT p.path, min(n.node_id) AS node_id FROM (SELECT DISTINCT file_path AS path FROM nodes) p LEFT JOIN nodes n ON n.simple_name = regexp_extract(p.path, '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1) GROUP BY p.path")
def node_by_path(spark, d):
    n = graph.nodes(spark, d)
    return s.node_by_path(n.select(F.col("file_path").alias("path")).distinct(), n)


@query("SELECT DISTINCT source_id, target_id, split_part(source_id, ':', 1) AS from_repo, split_part(target_id, ':', 1) AS to_repo FROM edges WHERE split_part(source_id, ':', 1) <> split_part(target_id, ':', 1) AND source_id IN (SELECT node_id FROM nodes) AND target_id IN (SELECT node_id FROM nodes)")
def callers_cross_repo(spark, d):
    """The kinds of nodes are the repositories here."""
    n = graph.nodes(spark, d).withColumn("repo", F.element_at(F.split("node_id", ":"), 1))
    return s.callers_cross_repo(graph.edges(spark, d), n)


@query(f""", {_HITS}, {_MATCHED.format("WHERE score >= 0.9")}, asked AS (SELECT 'S:' || CAST(s_suppkey AS VARCHAR) AS asked, CASE WHEN s_suppkey % 2 = 0 THEN 'GEO' ELSE 'None' END AS domain FROM supplier),
 found AS (SELECT asked, node_id FROM asked a JOIN nodes n ON lower(n.domain) = lower(a.domain) UNION SELECT asked, node_id FROM m),
 scope AS (SELECT asked, node_id FROM found UNION SELECT f.asked, b.node_id FROM found f JOIN asked a ON a.asked = f.asked JOIN edges e ON e.source_id = f.node_id JOIN nodes b ON b.node_id = e.target_id WHERE lower(b.domain) = lower(a.domain)),
 files AS (SELECT x.asked, x.node_id, n.file_path AS file FROM scope x JOIN nodes n ON n.node_id = x.node_id)
 SELECT f.asked, node_id, file, accepted FROM files f JOIN (SELECT asked, count(DISTINCT file) <= 7 AS accepted FROM files GROUP BY asked) c ON c.asked = f.asked""")  # fmt: skip
def scope_candidates(spark, d):
    """Each supplier asks; every second one for a domain, and all with what was found for them at or above 0.9."""
    asked = table(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("asked"), F.when(F.col("s_suppkey") % 2 == 0, "GEO").otherwise("None").alias("domain"))
    return s.scope_candidates(asked, _hits(spark, d, 0.9), graph.nodes(spark, d), graph.edges(spark, d), 0.9)


@query("SELECT doc_id, doc_kind, place FROM (SELECT doc_id, doc_kind, row_number() OVER (PARTITION BY doc_kind ORDER BY created_at DESC NULLS LAST, doc_id) AS place FROM documents WHERE doc_kind IN ('readme', 'config', 'build_log')) x WHERE place <= CASE doc_kind WHEN 'readme' THEN 1 WHEN 'config' THEN 2 ELSE 5 END")
def first_of_each_kind(spark, d):
    docs = table(spark, d, "documents", "doc_id", "doc_kind", "created_at")
    return s.first_of_each(docs, {"readme": 1, "config": 2, "build_log": 5}, "doc_kind", [F.desc_nulls_last("created_at"), F.col("doc_id")]).select("doc_id", "doc_kind", "place")


@query("SELECT doc_id, md5('=== ' || coalesce(file_path, 'unknown') || ' ===' || chr(10) || text) AS log FROM documents WHERE doc_kind = 'build_log' AND text <> ''")
def log_source(spark, d):
    logs = table(spark, d, "documents", "doc_id", "file_path", "doc_kind", "text").filter("doc_kind = 'build_log' and text <> ''")
    return logs.select("doc_id", F.md5(files.with_header(F.col("file_path"), F.col("text"))).alias("log"))
