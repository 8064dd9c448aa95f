"""Sinks: tables of nodes and edges in Parquet folders, replaced by repository, merged by key, or appended to.

All writes are idempotent: a job that is run again after a failure leaves the same table. A folder that is read and written in
one step is first written beside itself and read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import checkpointed


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table."""
    rows.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str = "repo") -> None:
    """Replaces the partitions of a table whose values of ``by`` are in ``rows``; all others stay as they are."""
    rows.repartition(by, F.pmod(F.xxhash64(*(c for c in rows.columns if c != by)), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_entities(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key: the new one if there is any. Of several new ones the largest in the order of all columns."""
    values = [c for c in existing.columns if c != key]
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(key).agg(F.max(F.struct("_new", *values)).alias("v")).select(*(key if c == key else f"v.{c}" for c in existing.columns))


def with_endpoints(edges: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select(node).distinct()
    return edges.join(ids.withColumnRenamed(node, "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed(node, "target_id"), "target_id", "left_semi").select(*edges.columns)


def merge_relationships(existing: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, kind, properties (map<string,string>), one row for each of the first three.

    New edges count only if both ends are nodes; their properties are put over those that are there, so that others stay.
    Of several new rows for an edge, the larger value of a property holds.
    """
    keys = ["source_id", "target_id", "kind"]
    both = existing.select(*keys, "properties", F.lit(0).alias("_new")).unionByName(with_endpoints(new.select(*keys, "properties"), nodes).withColumn("_new", F.lit(1)))
    each = both.select(*keys, "_new", F.explode_outer("properties").alias("k", "v"))
    held = each.groupBy(*keys, "k").agg(F.max_by("v", F.struct("_new", "v")).alias("v"))
    return held.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("properties"))


def delete_repository(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a repository: its nodes, its edges, and the edges of others to or from its nodes are gone."""
    gone = nodes.filter(F.col("repo") == repo).select("node_id").distinct()
    left = edges.filter(F.coalesce(F.col("repo") != repo, F.lit(True)))
    for end in ("source_id", "target_id"):
        left = left.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    return nodes.filter(F.coalesce(F.col("repo") != repo, F.lit(True))), left.select(*edges.columns)


def retain(path: str, rows: DataFrame, keep: Column) -> None:
    """Rewrites a table with the rows that are kept."""
    checkpointed(rows.filter(keep)).write.mode("overwrite").parquet(path)
