"""From search hits to the nodes and files that a change is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import BROADCAST_BYTES
from loomgraph.operators.metrics import top_per_group
from loomgraph.session import checkpointed


def _first_names(hits: DataFrame, classes: int) -> DataFrame:
    """asked, simple_name, rank: the first ``classes`` distinct names of each question by their best score, ties in the order of text."""
    best = hits.select("asked", F.element_at(F.split("name", r"\."), -1).alias("simple_name"), "score").groupBy("asked", "simple_name").agg(F.max("score").alias("score"))
    return top_per_group(best, ["asked"], [F.desc("score"), F.col("simple_name")], classes).select("asked", "simple_name", "rank")


def match_to_nodes(hits: DataFrame, nodes: DataFrame, classes: int = 3) -> DataFrame:
    """asked, place, node_id: the nodes named like the hits (last segment of ``name``) of the first ``classes`` distinct names of each question.

    ``hits``: asked, name, score; names count by their best score, ties in the order of text. ``nodes``: node_id, simple_name.
    """
    first = _first_names(hits, classes)
    return first.join(nodes.select("node_id", "simple_name").distinct(), "simple_name").select("asked", F.col("rank").alias("place"), "node_id")


def expand_same_domain(candidates: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """domain, node_id, each once: candidates of a domain, and what they depend on directly within it."""
    near = candidates.join(edges.select(F.col("source_id").alias("node_id"), "target_id"), "node_id").select("domain", "target_id").distinct()
    inside = nodes.select(F.col("node_id").alias("target_id"), F.col("domain").alias("_d"))
    return candidates.select("domain", "node_id").unionByName(near.join(inside, "target_id").filter("domain = _d").select("domain", F.col("target_id").alias("node_id"))).distinct()


def node_by_path(paths: DataFrame, nodes: DataFrame, path: str = "path") -> DataFrame:
    """The paths with the first node (least id, null if there is none) whose simple name is the name of the file without its ending: an equi-join."""
    stem = F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    first = nodes.groupBy(F.col("simple_name").alias("_stem")).agg(F.min("node_id").alias("node_id"))
    return paths.withColumn("_stem", stem).join(first, "_stem", "left").drop("_stem")


def callers_cross_repo(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_id, target_id, from_repo, to_repo of the edges between nodes of different repositories."""
    at = lambda end, repo: nodes.select(F.col("node_id").alias(end), F.col("repo").alias(repo))
    both = edges.select("source_id", "target_id").distinct().join(at("source_id", "from_repo"), "source_id").join(at("target_id", "to_repo"), "target_id")
    return both.filter("from_repo <> to_repo").select("source_id", "target_id", "from_repo", "to_repo")


def _inside(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """source_id, target_id, domain of the edges to ``targets`` (node_id, domain); where these are few, edges are filtered where they are read."""
    targets = checkpointed(targets.select(F.col("node_id").alias("target_id"), "domain").distinct())
    size = targets.agg(F.sum(F.octet_length("target_id") + F.octet_length("domain") + 32).alias("bytes")).first()["bytes"] or 0
    few = F.broadcast(targets) if size <= BROADCAST_BYTES else targets
    return edges.select("source_id", "target_id").join(few, "target_id", "left_semi").distinct().join(few, "target_id")


#: The nodes of a name are dealt to so many parts, as a few names may have most of the nodes; questions are copied to each.
PARTS = 8


def scope_candidates(asked: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float, most_files: int = 7, classes: int = 3) -> DataFrame:
    """asked, node_id, file, accepted: nodes of the asked domain (whatever the case) and those named like hits at or above ``threshold``, with their
    direct dependencies in the domain; accepted if they lie in at most ``most_files`` files.

    ``asked``: asked, domain. ``hits``: asked, name, score; their questions needn't be in ``asked``. ``nodes``: node_id, simple_name, domain, file_path.

    The nodes of a name are as many as there are, for every question that hits it. So these rows, most of the result, are made
    last, by the join that returns them, each once, and never shuffled: what is accepted is known before from names alone.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = asked.select("asked", F.lower("domain").alias("domain")).dropna().distinct()
    named = checkpointed(_first_names(hits.filter((F.col("score") >= threshold) & F.col("asked").isNotNull()), classes).select("asked", "simple_name"))
    # an id that is there again has all the names and domains of its rows
    known = nodes.filter("node_id is not null").groupBy("node_id").agg(
        F.sort_array(F.collect_set("simple_name")).alias("names"), F.collect_set(F.lower("domain")).alias("domains"), F.collect_list(F.struct(F.col("file_path").alias("file"))).alias("files")
    )

    of_domain = known.select("node_id", F.explode("domains").alias("domain"))
    key = lambda kind, c: F.concat(F.lit(kind), c)
    asked_keys = named.select("asked", key("n", F.col("simple_name")).alias("key")).unionByName(wanted.select("asked", key("d", F.col("domain")).alias("key")))
    node_keys = known.select(F.col("node_id").alias("source_id"), F.explode(F.concat(F.transform("names", lambda x: key("n", x)), F.transform("domains", lambda x: key("d", x)))).alias("key"))
    node_keys = node_keys.join(asked_keys.select("key").distinct(), "key", "left_semi")
    leading = _inside(edges, of_domain.join(wanted.select("domain").distinct(), "domain", "left_semi")).join(node_keys, "source_id")
    leading = checkpointed(leading.select("key", F.col("target_id").alias("node_id"), "domain").distinct())
    deps = leading.join(asked_keys, "key").join(wanted, ["asked", "domain"], "left_semi").select("asked", "node_id")
    inside = wanted.join(of_domain, "domain").select("asked", "node_id").unionByName(deps).distinct().join(known.select("node_id", F.inline("files")), "node_id")

    by_name = known.select("node_id", "names", F.posexplode("names").alias("_at", "simple_name"), "files")
    # one file more than are accepted tells of a name that it has too many
    files = top_per_group(by_name.select("simple_name", F.inline("files")).dropna().distinct(), ["simple_name"], [F.col("file")], most_files + 1)
    files = named.join(files, "simple_name").select("asked", "file").unionByName(inside.select("asked", "file")).groupBy("asked").agg(F.countDistinct("file").alias("_files"))
    accepted = (F.coalesce("_files", F.lit(0)) <= most_files).alias("accepted")

    questions = named.groupBy("asked").agg(F.collect_list("simple_name").alias("_names")).join(wanted.groupBy("asked").agg(F.collect_list("domain").alias("_domains")), "asked", "left").join(files, "asked", "left")
    questions = questions.select("asked", "_names", F.coalesce("_domains", F.array().cast("array<string>")).alias("_domains"), accepted, F.explode("_names").alias("simple_name"))
    questions = questions.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(tasks, "simple_name", "_part")
    by_name = by_name.select("node_id", F.slice("names", F.lit(1), F.col("_at")).alias("_before"), "simple_name", F.inline("files")).join(named.select("simple_name").distinct(), "simple_name", "left_semi")
    theirs = of_domain.join(wanted.select("domain").distinct(), "domain", "left_semi").groupBy("node_id").agg(F.collect_list("domain").alias("_theirs"))
    by_name = by_name.join(theirs, "node_id", "left").withColumn("_part", F.pmod(F.hash("node_id"), F.lit(PARTS))).repartition(tasks, "simple_name", "_part")
    # by the first of its names that is asked for, and not if it is there by its domain; most nodes have one name, of no asked domain
    once = (F.size("_before") == 0) | ~F.arrays_overlap("_before", "_names")
    hit = by_name.join(questions, ["simple_name", "_part"]).filter(once & (F.col("_theirs").isNull() | ~F.arrays_overlap("_theirs", "_domains")))
    return inside.join(files, "asked", "left").select("asked", "node_id", "file", accepted).unionByName(hit.select("asked", "node_id", "file", "accepted"))


def first_of_each(df: DataFrame, limits: dict[str, int], part: str, order: list) -> DataFrame:
    """Of each value of ``part`` so many rows as ``limits`` say (others none), in an order."""
    allowed = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    ranked = df.filter(F.col(part).isin(*limits)).withColumn("place", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return ranked.filter(F.col("place") <= allowed[F.col(part)])
