"""Traversal of a graph of typed edges (source_id, target_id, kind, repo).

Closures advance by whole frontiers: one join with the edges and one anti join with what was reached before for each
level, checkpointed, so that a node is expanded once and the plan doesn't grow with the depth. Starts are a DataFrame:
any number of them advance together. Where many starts have met on a few nodes, the edges of these nodes are few, and
they are broadcast after a check of their size, so that no such node becomes a hot key of a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import checkpointed

#: The edges that leave a frontier are broadcast if their ids have so many bytes at most.
BROADCAST_BYTES = 16 << 20


def reverse(edges: DataFrame) -> DataFrame:
    other = {"source_id": "target_id", "target_id": "source_id"}
    return edges.select(*(F.col(other.get(c, c)).alias(c) for c in edges.columns))


def neighbours(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, node, kind: distinct targets of the out-edges of each start."""
    return edges.join(starts.select(F.col("start").alias("source_id")).distinct(), "source_id").select(F.col("source_id").alias("start"), F.col("target_id").alias("node"), "kind").distinct()


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct (source_id, target_id), written once: the edges may be a view over many tables. Null ids are no nodes."""
    return checkpointed(edges.select("source_id", "target_id").filter("source_id is not null and target_id is not null").distinct())


def _step(frontier: DataFrame, pairs: DataFrame) -> DataFrame:
    """The frontier joined with the edges that leave it."""
    near = checkpointed(pairs.join(frontier.select(F.col("node").alias("source_id")).distinct(), "source_id", "left_semi"))
    size = near.agg(F.sum(F.octet_length("source_id") + F.octet_length("target_id") + 32).alias("bytes")).first()["bytes"] or 0
    return frontier.join(F.broadcast(near) if size <= BROADCAST_BYTES else near, F.col("node") == F.col("source_id"))


def closure(edges: DataFrame, starts: DataFrame, depth: int, keep_start: bool = True) -> DataFrame:
    """start, node, depth (the least) of all nodes within ``depth`` edges; a start itself only if it lies on a cycle.

    Null ids are no nodes. Starts without edges give nothing.
    """
    pairs = _pairs(edges)
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    levels: list[DataFrame] = []
    for level in range(1, depth + 1):
        step = _step(frontier, pairs).select("start", F.col("target_id").alias("node")).distinct()
        if levels:
            step = step.join(reduce(DataFrame.unionByName, levels).select("start", "node"), ["start", "node"], "left_anti")
        found = checkpointed(step.withColumn("depth", F.lit(level)))
        levels.append(found)
        if found.isEmpty():
            break
        frontier = found.select("start", "node")
    reached = reduce(DataFrame.unionByName, levels)
    return reached if keep_start else reached.filter("start <> node")


def shortest_paths(edges: DataFrame, starts: DataFrame, end: str, most: int) -> DataFrame:
    """start, path ('a->b->c') and hops of the shortest path to ``end`` of at most ``most`` edges; of several the least
    in the order of text. Each node keeps one path for each start. The end itself has a path of no edges."""
    pairs = _pairs(edges)
    frontier = starts.select("start", F.col("start").alias("node"), F.col("start").alias("path")).distinct()
    seen, found = [frontier.select("start", "node")], [frontier.filter(F.col("node") == end).select("start", "path", F.lit(0).alias("hops"))]
    frontier = frontier.filter(F.col("node") != end)
    for level in range(1, most + 1):
        step = _step(frontier, pairs).select("start", F.col("target_id").alias("node"), F.concat_ws("->", "path", "target_id").alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path")).join(reduce(DataFrame.unionByName, seen), ["start", "node"], "left_anti")
        step = checkpointed(step)
        found.append(step.filter(F.col("node") == end).select("start", "path", F.lit(level).alias("hops")))
        frontier = step.filter(F.col("node") != end)
        if frontier.isEmpty():
            break
        seen.append(step.select("start", "node"))
    return reduce(DataFrame.unionByName, found).filter(F.col("path").isNotNull())


def full_context(edges: DataFrame, starts: DataFrame, dependencies: int, dependents: int) -> DataFrame:
    """start, node: each start, what it depends on within so many edges, and what depends on it."""
    own = starts.select("start", F.col("start").alias("node"))
    down, up = closure(edges, starts, dependencies), closure(reverse(edges), starts, dependents)
    return own.unionByName(down.select("start", "node")).unionByName(up.select("start", "node")).distinct()


def relationships(edges: DataFrame, asked: DataFrame, most: int = 5) -> DataFrame:
    """start, end, hops and explanation for each pair of ``asked`` (start, end): are they connected within ``most`` edges, whatever their direction?

    Both sides advance half of the way, over edges in both directions, and meet; hops are null if they don't.
    """
    both = edges.unionByName(reverse(edges))
    near = lambda c, depth: closure(both, asked.select(F.col(c).alias("start")), depth, keep_start=False).select(F.col("start").alias(c), "node", "depth")
    own = lambda c: asked.select(c, F.col(c).alias("node"), F.lit(0).alias("depth")).distinct()
    left = near("start", most - most // 2).unionByName(own("start")).withColumnRenamed("depth", "a")
    right = near("end", most // 2).unionByName(own("end")).withColumnRenamed("depth", "b")
    pairs = asked.select("start", "end").distinct()
    met = pairs.join(left, "start").join(right, ["end", "node"]).groupBy("start", "end").agg(F.min(F.col("a") + F.col("b")).alias("hops"))
    text = F.when(F.col("hops").isNotNull(), F.lit("Connected via 1 path(s)")).otherwise("No direct relationship found between these entities")
    return pairs.join(met, ["start", "end"], "left").withColumn("explanation", text)


def degrees(edges: DataFrame) -> DataFrame:
    """node, dependents, dependencies: distinct neighbours by direction, of every node that has any."""
    pairs = edges.select("repo", "source_id", "target_id").distinct()
    both = pairs.select("repo", F.col("target_id").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(pairs.select("repo", F.col("source_id").alias("node"), F.lit(0), F.lit(1)))
    return both.groupBy("repo", "node").agg(F.sum("i").alias("dependents"), F.sum("o").alias("dependencies"))


def impact(edges: DataFrame, starts: DataFrame, depth: int = 5, critical_above: int = 3) -> DataFrame:
    """By start: direct and transitive dependents, those of them with many dependents of their own, score and risk."""
    edges = checkpointed(edges.select("repo", "source_id", "target_id").distinct())
    near = closure(reverse(edges), starts, depth, keep_start=False)
    many = degrees(edges).filter(F.col("dependents") > critical_above).select("node").withColumn("_many", F.lit(1))
    direct, all_ = F.count_if(F.col("depth") == 1), F.count("node")
    found = near.join(many, "node", "left").groupBy("start").agg(direct.alias("direct"), all_.alias("transitive"), F.count("_many").alias("critical"))
    rows = starts.select("start").distinct().join(found, "start", "left").na.fill(0, ["direct", "transitive", "critical"])
    return rows.withColumn("score", F.least(F.lit(10.0), 2.0 * F.col("direct") + 0.5 * F.col("transitive"))).withColumn("risk", risk(F.col("transitive")))


def risk(transitive: Column) -> Column:
    return F.when(transitive > 20, "CRITICAL").when(transitive > 10, "HIGH").when(transitive > 5, "MEDIUM").otherwise("LOW")


def related(edges: DataFrame, starts: DataFrame, direction: str = "BOTH", kind: str | None = None) -> DataFrame:
    """start, node, kind of one hop, one row for each edge; direction INCOMING, OUTGOING or BOTH."""
    kept = edges.filter(F.col("kind") == kind) if kind else edges
    ways = {"OUTGOING": [kept], "INCOMING": [reverse(kept)], "BOTH": [kept, reverse(kept)]}[direction]
    return reduce(DataFrame.unionByName, ways).join(starts.select(F.col("start").alias("source_id")), "source_id").select(F.col("source_id").alias("start"), F.col("target_id").alias("node"), "kind")
