"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph as g
from loomgraph.session import checkpointed
from loomgraph.sources import graph as s
from loomgraph.sources.tables import table

_CTE = f"WITH RECURSIVE edges AS ({s.EDGES_SQL}), nodes AS ({s.NODES_SQL}) "
QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql if sql.startswith("WITH") else _CTE + sql
        return f

    return add


def _recursive(anchor: str, step: str, rest: str) -> str:
    return f"{_CTE.rstrip()}, c(start, node, depth) AS ({anchor} UNION {step}) {rest}"


_BOTH = "(SELECT source_id AS start FROM edges UNION SELECT target_id FROM edges)"


def _reach(depth: int, back: bool = False, where: str = "true") -> str:
    """The closure over all starts in SQL: c(start, node, depth)."""
    a, b = ("target_id", "source_id") if back else ("source_id", "target_id")
    return _recursive(f"SELECT e.{a}, e.{b}, 1 FROM edges e WHERE {where}", f"SELECT c.start, e.{b}, c.depth + 1 FROM c JOIN edges e ON e.{a} = c.node WHERE c.depth < {depth}", "")


_LEAST = "SELECT start, node, min(depth) AS depth FROM c GROUP BY start, node"


def _starts(edges):
    """All nodes that have edges."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("start")).distinct()


@query("SELECT DISTINCT source_id AS start, target_id AS node, kind FROM edges")
def direct_dependencies(spark, d):
    e = s.edges(spark, d)
    return g.neighbours(e, _starts(e))


@query("SELECT DISTINCT target_id AS start, source_id AS node, kind FROM edges")
def direct_dependents(spark, d):
    e = s.edges(spark, d)
    return g.neighbours(g.reverse(e), _starts(e))


@query(_reach(4) + _LEAST)
def transitive_dependencies(spark, d):
    e = checkpointed(s.edges(spark, d))
    return g.closure(e, _starts(e), 4)


@query(_reach(5, where="e.repo = 'tpch' AND e.kind = 'ACCEPTS'") + _LEAST)
def transitive_dependencies_of_orders(spark, d):
    """All orders are the starts, taken from their own table."""
    orders = table(spark, d, "orders", "o_orderkey").select(F.concat(F.lit("O:"), F.col("o_orderkey").cast("string")).alias("start"))
    return g.closure(s.edges(spark, d), orders, 5)


@query(_reach(5, back=True) + _LEAST)
def transitive_dependents(spark, d):
    e = checkpointed(s.edges(spark, d))
    return g.closure(g.reverse(e), _starts(e), 5)


@query(_reach(5, back=True) + "SELECT start, node, min(depth) AS depth FROM c WHERE start <> node GROUP BY start, node")
def dependents_without_start(spark, d):
    e = checkpointed(s.edges(spark, d))
    return g.closure(g.reverse(e), _starts(e), 5, keep_start=False)


@query(f"""{_CTE.rstrip()}, p(start, node, path, hops) AS (SELECT start, start, start, 0 FROM {_BOTH} b
 UNION SELECT p.start, e.target_id, p.path || '->' || e.target_id, p.hops + 1 FROM p JOIN edges e ON e.source_id = p.node WHERE p.hops < 5 AND e.repo = 'tpch')
 SELECT start, path, hops FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, path) AS n FROM p WHERE node = 'R:1') t WHERE n = 1""")  # fmt: skip
def shortest_path(spark, d):
    """From every node to one end, which is an argument of the search."""
    e = checkpointed(s.edges(spark, d))
    return g.shortest_paths(e, _starts(e), "R:1", 5)


@query("""SELECT repo, node, CAST(sum(i) AS BIGINT) AS dependents, CAST(sum(o) AS BIGINT) AS dependencies FROM (
 SELECT repo, target_id AS node, 1 AS i, 0 AS o FROM (SELECT DISTINCT repo, source_id, target_id FROM edges) a UNION ALL SELECT repo, source_id, 0, 1 FROM (SELECT DISTINCT repo, source_id, target_id FROM edges) b) t GROUP BY repo, node""")  # fmt: skip
def node_degree(spark, d):
    return g.degrees(s.edges(spark, d))


@query(_reach(5, back=True).rstrip() + f""", n AS (SELECT start, node, min(depth) AS depth FROM c WHERE start <> node GROUP BY start, node), many AS (SELECT DISTINCT target_id AS node FROM edges GROUP BY repo, target_id HAVING count(DISTINCT source_id) > 3),
  r AS (SELECT n.start, count(CASE WHEN depth = 1 THEN 1 END) AS direct, count(*) AS transitive, count(many.node) AS critical FROM n LEFT JOIN many ON many.node = n.node GROUP BY n.start)
  SELECT s.start, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, coalesce(critical, 0) AS critical, least(10.0E0, 2.0E0 * coalesce(direct, 0) + 0.5E0 * coalesce(transitive, 0)) AS score,
  CASE WHEN coalesce(transitive, 0) > 20 THEN 'CRITICAL' WHEN coalesce(transitive, 0) > 10 THEN 'HIGH' WHEN coalesce(transitive, 0) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM {_BOTH} s LEFT JOIN r ON r.start = s.start""")  # fmt: skip
def impact_analysis(spark, d):
    e = checkpointed(s.edges(spark, d))
    return g.impact(e, _starts(e))


@query(f"{_reach(2).rstrip()}, u(start, node, depth) AS (SELECT e.target_id, e.source_id, 1 FROM edges e UNION SELECT u.start, e.source_id, u.depth + 1 FROM u JOIN edges e ON e.target_id = u.node WHERE u.depth < 1) SELECT start, node FROM c UNION SELECT start, node FROM u UNION SELECT start, start FROM {_BOTH} b")
def full_context(spark, d):
    e = checkpointed(s.edges(spark, d))
    return g.full_context(e, _starts(e), 2, 1)


@query("SELECT source_id AS start, target_id AS node, kind FROM edges UNION ALL SELECT target_id, source_id, kind FROM edges")
def related_entities(spark, d):
    e = s.edges(spark, d)
    return g.related(e, _starts(e))


@query("SELECT target_id AS start, source_id AS node, kind, 1 AS depth FROM edges WHERE kind = 'USES'")
def search_find_dependencies(spark, d):
    e = s.edges(spark, d)
    return g.related(e, _starts(e), "INCOMING", "USES").withColumn("depth", F.lit(1))


@query("SELECT DISTINCT source_id AS caller, target_id AS callee FROM edges WHERE kind = 'USES'")
def service_topology(spark, d):
    return s.edges(spark, d).filter("kind = 'USES'").select(F.col("source_id").alias("caller"), F.col("target_id").alias("callee")).distinct()


@query(_recursive("SELECT e.source_id, e.target_id, 1 FROM edges e WHERE e.kind IN ('ACCEPTS', 'USES') AND e.repo = 'tpch'", "SELECT c.start, e.target_id, c.depth + 1 FROM c JOIN edges e ON e.source_id = c.node WHERE c.depth < 10 AND e.kind IN ('ACCEPTS', 'USES') AND e.repo = 'tpch'", "") + _LEAST)
def request_trace(spark, d):
    """What calls go through, over edges of two kinds, at most ten."""
    e = checkpointed(s.edges(spark, d).filter(F.col("kind").isin("ACCEPTS", "USES") & (F.col("repo") == "tpch")))
    return g.closure(e, _starts(e), 10)


@query("SELECT repo, kind, count(*) AS n FROM edges GROUP BY repo, kind")
def edges_per_repo(spark, d):
    return s.edges(spark, d).groupBy("repo", "kind").agg(F.count("*").alias("n"))


@query("SELECT repo, count(*) AS n, count(domain) AS with_domain, count(summary) AS with_summary, count(features) AS with_features, count(concepts) AS with_concepts FROM nodes GROUP BY repo")
def kg_coverage(spark, d):
    """By repository: nodes, and how many have a domain, a summary, features and concepts."""
    columns = ("domain", "summary", "features", "concepts")
    return s.nodes(spark, d).groupBy("repo").agg(F.count("*").alias("n"), *(F.count(c).alias(f"with_{c}") for c in columns))


@query("SELECT DISTINCT domain FROM nodes WHERE domain IS NOT NULL")
def distinct_domains(spark, d):
    return s.nodes(spark, d).select("domain").filter("domain is not null").distinct()


@query("SELECT domain, node_type, count(*) AS n FROM nodes WHERE domain IS NOT NULL GROUP BY domain, node_type")
def domain_counts(spark, d):
    return s.nodes(spark, d).filter("domain is not null").groupBy("domain", "node_type").agg(F.count("*").alias("n"))


@query("""SELECT n.domain AS from_domain, m.domain AS to_domain, e.kind, count(*) AS n FROM edges e JOIN nodes n ON n.node_id = e.source_id JOIN nodes m ON m.node_id = e.target_id
 WHERE n.domain <> m.domain GROUP BY n.domain, m.domain, e.kind""")  # fmt: skip
def cross_domain_calls(spark, d):
    n = s.nodes(spark, d).select("node_id", "domain")
    e = s.edges(spark, d)
    both = e.join(n.select(F.col("node_id").alias("source_id"), F.col("domain").alias("from_domain")), "source_id").join(n.select(F.col("node_id").alias("target_id"), F.col("domain").alias("to_domain")), "target_id")
    return both.filter("from_domain <> to_domain").groupBy("from_domain", "to_domain", "kind").agg(F.count("*").alias("n"))
