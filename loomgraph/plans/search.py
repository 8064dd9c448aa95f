"""Searches over the entities of the tables, with arguments; the SQL is written from the meaning of each search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.operators import retrieval as r
from loomgraph.operators import search as s
from loomgraph.operators.metrics import top_per_group
from loomgraph.sources.tables import table

QUERIES, SQL = {}, {}

_REPO = r"regexp_extract(coalesce(package_name, ''), '^(\w+\.\w+)', 1)"
_CTE = f"""WITH ent AS (
 SELECT DISTINCT id, {_REPO} AS repo, name, fully_qualified_name, package_name, source_file_path AS path, annotations, source_code, javadoc, class_type AS label FROM classes
 UNION ALL SELECT DISTINCT id, {_REPO}, name, fully_qualified_name, package_name, source_file_path, annotations, source_code, javadoc, 'METHOD' FROM (SELECT *, regexp_extract(coalesce(class_name, ''), '^(.*)\\.[^.]*$', 1) AS package_name FROM methods) m)
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _CTE + sql
        return f

    return add


def entities(spark, d):
    """Classes and methods as entities; the repository is the first two segments of the package."""
    columns = ("id", "name", "fully_qualified_name", F.col("source_file_path").alias("path"), "annotations", "source_code", "javadoc")
    package = F.regexp_extract(F.coalesce("class_name", F.lit("")), r"^(.*)\.[^.]*$", 1).alias("package_name")
    c = table(spark, d, "classes", *columns, "package_name", F.col("class_type").alias("label"))
    m = table(spark, d, "methods", *columns, package, F.lit("METHOD").alias("label"))
    repo = F.regexp_extract(F.coalesce("package_name", F.lit("")), r"^(\w+\.\w+)", 1)
    return c.unionByName(m).withColumn("repo", repo).withColumn("summary", F.lit(None).cast("string"))


_HIT = lambda c, k: f"contains(lower(coalesce({c}, '')), '{k}')"


def _score(*words):
    return "least(1.0E0, (" + " + ".join(f"CASE WHEN {_HIT('name', k)} THEN 3 WHEN {_HIT('fully_qualified_name', k)} THEN 2 WHEN {_HIT('source_code', k)} THEN 1 ELSE 0 END" for k in words) + f") / {3 * len(words)}.0E0)"


def _keyword(words, where="true", k=20):
    return f"SELECT DISTINCT id, round({_score(*words)}, 6) AS score FROM ent WHERE {where} AND {_score(*words)} > 0 ORDER BY score DESC, id LIMIT {k}"


_NAMED = "SELECT DISTINCT id, 1.0E0 AS score FROM ent WHERE {} ORDER BY id LIMIT 50"


@query(_keyword(("refund", "ledger")))
def keyword_search(spark, d):
    return s.keyword_search(entities(spark, d), "Where is the refund ledger?")


@query(_keyword(("token", "budget", "retry"), "repo IN ('net.brindle', 'org.quillmark')", 30))
def keyword_search_in_repositories(spark, d):
    return s.keyword_search(entities(spark, d), "token budget of a retry", ["net.brindle", "org.quillmark"], 30)


@query("SELECT DISTINCT id FROM ent WHERE contains(source_code, 'TimeoutException') OR contains(javadoc, 'TimeoutException') ORDER BY id LIMIT 100")
def full_text_search(spark, d):
    return s.full_text_search(entities(spark, d), "TimeoutException", 100)


@query("SELECT DISTINCT id, path FROM ent WHERE regexp_matches(path, '(Parser|Route)[^/]*\\.java$') ORDER BY id LIMIT 20")
def file_pattern(spark, d):
    return s.file_pattern(entities(spark, d), r"(Parser|Route)[^/]*\.java$")


@query("SELECT DISTINCT id FROM ent WHERE list_has_any(annotations, ['Service', 'Component', 'Entity']) AND (contains(name, 'Ledger') OR contains(name, 'Token') OR contains(name, 'Build')) ORDER BY id LIMIT 50")
def metadata_filter(spark, d):
    return s.metadata_filter(entities(spark, d), annotations="Service, Component,Entity", name="Ledger | Token|Build")


@query("SELECT DISTINCT id FROM ent WHERE package_name IN (SELECT min(package_name) FROM ent WHERE package_name <> '') ORDER BY id LIMIT 50")
def package_filter(spark, d):
    """The entities of one package, the first in the order of names, which the engine looks up first."""
    e = entities(spark, d)
    first = e.filter("package_name <> ''").agg(F.min("package_name").alias("p")).first()["p"]
    return s.metadata_filter(e, package=first or "-")


@query(_NAMED.format("(contains(name, 'Ledger') OR contains(name, 'Audit'))"))
def structural_search(spark, d):
    return s.structural_search(entities(spark, d), "which code calls Ledger or Audit")


@query(f"""SELECT id, score, origin FROM (SELECT id, score, 'structural' AS origin FROM ({_NAMED.format("contains(name, 'Ledger')")}) a UNION ALL SELECT id, score, 'semantic' FROM ({_keyword(("code", "ledger", "retry"), k=10)}) b
 WHERE id NOT IN (SELECT id FROM ({_NAMED.format("contains(name, 'Ledger')")}) c)) u""")  # fmt: skip
def hybrid_search(spark, d):
    e, asked = entities(spark, d), "code of the Ledger retry"
    return s.hybrid_search(s.structural_search(e, asked), s.keyword_search(e, asked, k=10))


@query(f"""SELECT 'structural' AS asked, id, score FROM ({_NAMED.format("contains(name, 'TokenBudget')").replace("contains(name, 'TokenBudget')", "contains(name, 'Token')")}) a UNION ALL SELECT 'semantic', id, score FROM ({_keyword(("refund", "policy"))}) b
 UNION ALL SELECT 'temporal', id, score FROM ({_keyword(("recent", "refund"))}) c""")  # fmt: skip
def search(spark, d):
    """Three queries, each sent to the search that its words ask for."""
    e = entities(spark, d)
    asked = {"structural": "what extends Token", "semantic": "where is the refund policy", "temporal": "recent refund"}
    out = [s.search(e, q).select(F.lit(k).alias("asked"), "id", "score") for k, q in asked.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""SELECT id, score, strategy FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strategy, score DESC) AS n FROM (
  SELECT id, 1.0E0 AS score, 0 AS strategy FROM (SELECT DISTINCT id FROM ent WHERE contains(name, 'Ledger') ORDER BY id LIMIT 50) a UNION ALL SELECT id, score, 2 FROM ({_keyword(("refund", "ledger"), k=60)}) b
  UNION ALL SELECT id, 1.0E0, 3 FROM (SELECT DISTINCT id FROM ent WHERE contains(source_code, 'null;') OR contains(javadoc, 'null;') ORDER BY id LIMIT 20) c
  UNION ALL SELECT id, 1.0E0, 4 FROM (SELECT DISTINCT id FROM ent WHERE regexp_matches(path, 'Audit') ORDER BY id LIMIT 20) c) u) v WHERE n = 1 ORDER BY score DESC, id LIMIT 50""")  # fmt: skip
def dedupe_first_then_rank(spark, d):
    """A retrieval plan of five strategies, one of them unknown."""
    plan = [("metadata_filter", {"name": "Ledger"}), ("graph_walk", {}), ("keyword_search", {"query": "refund ledger", "k": 60}), ("semantic_search", {"text": "null;"}), ("file_pattern", {"pattern": "Audit"})]
    return s.execute_plan(entities(spark, d), plan)


@query("""SELECT doc_id AS id, part FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) AS n FROM (SELECT doc_id, CASE WHEN lower(split_part(file_path, '/', -1)) LIKE 'readme%' OR lower(file_path) LIKE 'readme/%' THEN 'readme'
 WHEN contains(text, '@SpringBootApplication') THEN 'main' WHEN lower(split_part(file_path, '/', -1)) = 'pom.xml' THEN 'pom' WHEN lower(split_part(file_path, '/', -1)) LIKE 'build.gradle%' THEN 'gradle' END AS part FROM documents) p WHERE part IS NOT NULL) q
 WHERE (n = 1 OR (n = 2 AND part = 'main'))""")  # fmt: skip
def broad_overview(spark, d):
    return s.broad_overview(table(spark, d, "documents", F.col("doc_id").alias("id"), F.col("file_path").alias("path"), "text"))


@query("""SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
 SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0) a) b WHERE place <= 20""")  # fmt: skip
def vector_search(spark, d):
    """Every vector whose id is divisible by 20 is a query, against all vectors."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return s.nearest(v, v.filter("vec_id % 20 = 0"))


@query("""SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM (
 SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0) a) b WHERE place <= 20
 AND score > 0.7""")  # fmt: skip
def vector_search_above(spark, d):
    """The nearest ones that are nearer than 0.7."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    return s.nearest(v, v.filter("vec_id % 20 = 0")).filter("score > 0.7").select("query_id", "vec_id", "score")


_THRESHOLDS = """s AS (SELECT agent_name, list(faithfulness_score ORDER BY faithfulness_score DESC) AS x FROM (SELECT DISTINCT id, agent_name, faithfulness_score FROM llm_call_metrics WHERE faithfulness_score IS NOT NULL) c GROUP BY agent_name),
 g AS (SELECT agent_name, x, i, x[i + 1] - x[i + 2] AS gap FROM s, unnest(range(2, least(len(x) - 1, 10))) t(i) WHERE len(x) > 3),
 b AS (SELECT agent_name, arg_max(x[i + 1], struct_pack(a := gap, b := -i)) AS before_gap, max(gap) AS gap FROM g GROUP BY agent_name),
 h AS (SELECT s.agent_name, round(CASE WHEN len(x) <= 3 THEN greatest(0.5E0, 0.7E0 * x[1]) ELSE least(0.8E0, greatest(0.5E0, CASE WHEN gap >= 0.15 THEN before_gap ELSE 0.7E0 * x[1] END)) END, 6) AS threshold FROM s LEFT JOIN b ON b.agent_name IS NOT DISTINCT FROM s.agent_name)"""


def _thresholds(spark, d):
    scores = table(spark, d, "llm_call_metrics", "id", "agent_name", "faithfulness_score").filter("faithfulness_score is not null").dropDuplicates(["id"])
    ranked = top_per_group(scores, ["agent_name"], [F.desc("faithfulness_score"), F.col("id")], 12)  # the threshold looks at eleven scores at most
    lists = ranked.groupBy("agent_name").agg(F.sort_array(F.collect_list("faithfulness_score"), asc=False).alias("x"))
    return scores, lists.select("agent_name", F.round(r.adaptive_threshold(F.col("x")), 6).alias("threshold"))


@query(f", {_THRESHOLDS} SELECT agent_name, threshold FROM h")
def adaptive_threshold(spark, d):
    return _thresholds(spark, d)[1]


@query(f", {_THRESHOLDS} SELECT agent_name, id, score FROM (SELECT c.agent_name, c.id, c.faithfulness_score AS score, row_number() OVER (PARTITION BY c.agent_name ORDER BY c.faithfulness_score DESC, c.id) AS n FROM (SELECT DISTINCT id, agent_name, faithfulness_score FROM llm_call_metrics WHERE faithfulness_score IS NOT NULL) c JOIN h ON h.agent_name = c.agent_name WHERE c.faithfulness_score >= h.threshold) x WHERE n <= 10")
def threshold_hits(spark, d):
    """Of each agent the first ten calls with a score of its threshold or more."""
    scores, thresholds = _thresholds(spark, d)
    best = top_per_group(scores, ["agent_name"], [F.desc("faithfulness_score"), F.col("id")], 10)  # the first ten of those above are among the first ten
    return best.join(thresholds, "agent_name").filter("faithfulness_score >= threshold").select("agent_name", "id", F.col("faithfulness_score").alias("score"))


@query("SELECT DISTINCT id FROM ent WHERE contains(source_code, 'RestTemplate') OR contains(source_code, 'WebClient') OR contains(source_code, 'FeignClient') OR contains(source_code, '.record(')")
def service_call_scan(spark, d):
    """Sources that call a service: by its usual clients, or the audit service of these tables."""
    calls = ("RestTemplate", "WebClient", "FeignClient", ".record(")
    return entities(spark, d).filter(s._any_of([F.contains("source_code", F.lit(x)) for x in calls])).select("id").distinct()


@query("SELECT DISTINCT n.id, n.name, n.label FROM ent n WHERE lower(n.label) = 'method' AND n.repo = 'net.marrowby'")
def entities_by_type(spark, d):
    return entities(spark, d).filter("lower(label) = 'method' and repo = 'net.marrowby'").select("id", "name", "label").distinct()


@query("SELECT DISTINCT repo FROM ent WHERE repo <> ''")
def list_repositories(spark, d):
    return entities(spark, d).select("repo").filter("repo <> ''").distinct()


@query("SELECT DISTINCT id, name, label FROM ent WHERE id = (SELECT max(id) FROM classes)")
def entity_by_id(spark, d):
    """One entity by its id: here the largest one."""
    wanted = table(spark, d, "classes", "id").agg(F.max("id")).scalar()
    return entities(spark, d).filter(F.col("id") == wanted).select("id", "name", "label").distinct().limit(1)


@query("""SELECT DISTINCT coalesce(id, fully_qualified_name, 'unknown') AS id, label AS chunk_type, name AS class_name, CASE WHEN label = 'METHOD' THEN name END AS method_name, length(coalesce(source_code, '')) AS content_chars, 1.0E0 AS score FROM ent""")
def node_to_context(spark, d):
    content = F.length(F.coalesce("source_code", "summary", F.lit("")))
    rows = entities(spark, d).select(
        F.coalesce("id", "fully_qualified_name", F.lit("unknown")).alias("id"), F.col("label").alias("chunk_type"), F.col("name").alias("class_name"),
        F.when(F.col("label") == "METHOD", F.col("name")).alias("method_name"), content.alias("content_chars"), F.lit(1.0).alias("score"),
    )
    return rows.distinct()


@query("""SELECT id, path, score FROM (SELECT DISTINCT id, coalesce(path, 'unknown') AS path, CASE upper(label) WHEN 'CLASS' THEN 0.95E0 WHEN 'METHOD' THEN 0.9E0 WHEN 'FIELD' THEN 0.85E0 ELSE 0.8E0 END AS score FROM ent) x ORDER BY score DESC, id LIMIT 20""")
def fallback_context(spark, d):
    label = F.upper("label")
    score = F.when(label == "CLASS", 0.95).when(label == "METHOD", 0.9).when(label == "FIELD", 0.85).otherwise(0.8)
    rows = entities(spark, d).select("id", F.coalesce("path", F.lit("unknown")).alias("path"), score.alias("score")).distinct()
    return rows.orderBy(F.desc("score"), "id").limit(20)


@query("""SELECT DISTINCT id, label AS node_type, path, package AS package_name, lines AS line_count, summary FROM (
 SELECT id, class_type AS label, source_file_path AS path, regexp_extract(coalesce(fully_qualified_name, ''), '^(.*)\\.[^.]*$', 1) AS package, end_line - start_line AS lines, coalesce(javadoc, '') AS summary FROM classes
 UNION ALL SELECT id, 'METHOD', source_file_path, regexp_extract(coalesce(class_name, ''), '^(.*)\\.[^.]*$', 1), end_line - start_line, coalesce(javadoc, '') FROM methods) u""")  # fmt: skip
def entities_to_nodes(spark, d):
    """Types and methods as nodes: lines from start to end, the package of the type, the javadoc as summary."""
    shape = lambda label, fqn: (F.col("id"), label.alias("node_type"), F.col("source_file_path").alias("path"), t.package_of(fqn).alias("package_name"), (F.col("end_line") - F.col("start_line")).alias("line_count"), F.coalesce("javadoc", F.lit("")).alias("summary"))
    c = table(spark, d, "classes").select(*shape(F.col("class_type"), F.col("fully_qualified_name")))
    return c.unionByName(table(spark, d, "methods").select(*shape(F.lit("METHOD"), F.col("class_name")))).distinct()


@query("""SELECT id, cls, preview, annotations FROM (SELECT DISTINCT id, name AS cls, md5(CASE WHEN length(source_code) > 500 THEN left(source_code, 500) || '...' ELSE source_code END) AS preview, CASE WHEN len(annotations) > 0 THEN array_to_string(annotations, ',') END AS annotations FROM ent) x""")
def flat_metadata(spark, d):
    """Metadata as a map of texts without absent ones, read back: name, the first 500 characters of the source, annotations."""
    short = F.when(F.length("source_code") > 500, F.concat(F.substring("source_code", 1, 500), F.lit("..."))).otherwise(F.col("source_code"))
    listed = F.when(F.size("annotations") > 0, F.array_join("annotations", ","))
    made = F.map_filter(F.create_map(F.lit("class"), F.col("name"), F.lit("preview"), short, F.lit("annotations"), listed), lambda _, v: v.isNotNull())
    rows = entities(spark, d).select("id", made.alias("m"))
    return rows.select("id", F.try_element_at("m", F.lit("class")).alias("cls"), F.md5(F.try_element_at("m", F.lit("preview"))).alias("preview"), F.try_element_at("m", F.lit("annotations")).alias("annotations")).distinct()
