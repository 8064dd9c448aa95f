"""Queries over classes, methods, documents and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.functions.java import SKIPPED
from loomgraph.operators import retrieval as r
from loomgraph.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)


def _classes(spark, d, *columns):
    return table(spark, d, "classes").dropDuplicates(["id"]).select("id", *columns)


def _methods(spark, d, *columns):
    return table(spark, d, "methods").dropDuplicates(["id"]).select("id", *columns)


@query(f"""SELECT workflow_id, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(trim(goal)), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')),
 lambda w: length(w) > 2 AND w NOT IN ({_STOP})), ' ') AS tokens FROM (SELECT DISTINCT workflow_id, goal FROM workflows) w WHERE goal IS NOT NULL""")  # fmt: skip
def tokenize_query(spark, d):
    goals = table(spark, d, "workflows", "workflow_id", "goal").distinct().filter("goal is not null")
    return goals.select("workflow_id", F.array_join(t.tokenize_query(F.col("goal")), " ").alias("tokens"))


@query("""SELECT workflow_id, CASE WHEN regexp_matches(lower(goal), 'call|depend|extend|implement|relationship') THEN 'STRUCTURAL' WHEN regexp_matches(lower(goal), 'change|history|recent|modified|commit') THEN 'TEMPORAL'
 ELSE 'SEMANTIC' END AS mode FROM (SELECT DISTINCT workflow_id, goal FROM workflows) w WHERE goal IS NOT NULL""")  # fmt: skip
def detect_search_mode(spark, d):
    return table(spark, d, "workflows", "workflow_id", "goal").distinct().filter("goal is not null").select("workflow_id", t.search_mode(F.col("goal")).alias("mode"))



@query("SELECT id, regexp_extract(coalesce(fully_qualified_name, ''), '^(.*)\\.[^.]*$', 1) AS package_name FROM (SELECT DISTINCT id, fully_qualified_name FROM methods) m")
def package_of(spark, d):
    return _methods(spark, d, t.package_of(F.col("fully_qualified_name")).alias("package_name"))


_REPO = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(repo_url, ' ' || chr(9))), '^(?:[a-z+]+://)?(?:[^@/]+@)?', ''), '^([^/:]+):(?:[0-9]+/)?', '\\1/'), '[?#].*$', ''), '/*(?:\\.git)?/*$', '')"""


@query(f"SELECT repository, count(DISTINCT conversation_id) AS conversations FROM (SELECT conversation_id, {_REPO} AS repository FROM conversations) c WHERE contains(repository, '/') GROUP BY repository")
def conversations_by_repository(spark, d):
    rows = table(spark, d, "conversations", "conversation_id", "repo_url").select("conversation_id", t.repository(F.col("repo_url")).alias("repository")).filter("repository is not null")
    return rows.groupBy("repository").agg(F.countDistinct("conversation_id").alias("conversations"))


_TYPE = """CASE WHEN (regexp_extract(x, '^\\s*([\\w.$]+)', 1) IN ('List', 'Set', 'Collection', 'Iterable', 'Stream', 'Optional')) AND regexp_extract(x, '<\\s*([\\w.$]+)', 1) <> '' THEN regexp_extract(x, '<\\s*([\\w.$]+)', 1)
 ELSE regexp_extract(x, '^\\s*([\\w.$]+)', 1) END"""


@query(f"""SELECT kind, target, many, count(*) AS n FROM (SELECT kind, {_TYPE} AS target, (regexp_extract(x, '^\\s*([\\w.$]+)', 1) IN ('List', 'Set', 'Collection', 'Iterable', 'Stream') OR x LIKE '%[]') AS many FROM (
  SELECT id, 'ACCEPTS' AS kind, unnest(parameters).type AS x FROM (SELECT DISTINCT * FROM methods) a UNION ALL SELECT id, 'RETURNS', return_type FROM (SELECT DISTINCT id, return_type FROM methods) b
  UNION ALL SELECT id, 'THROWS', unnest(thrown_exceptions) FROM (SELECT DISTINCT id, thrown_exceptions FROM methods) c) u WHERE x IS NOT NULL) v
 WHERE target NOT IN ('void', 'boolean', 'byte', 'char', 'short', 'int', 'long', 'float', 'double', '') GROUP BY kind, target, many""")  # fmt: skip
def dependency_edges(spark, d):
    """Types that methods accept, return and throw, primitives left out: edges by kind, target and cardinality."""
    m = _methods(spark, d, "parameters", "return_type", "thrown_exceptions")
    kinds = [("ACCEPTS", F.explode("parameters.type")), ("RETURNS", F.col("return_type")), ("THROWS", F.explode("thrown_exceptions"))]
    edges = reduce(DataFrame.unionByName, (m.select("id", F.lit(k).alias("kind"), x.alias("x")) for k, x in kinds)).filter("x is not null")
    typed = edges.select("kind", t.simple_type(F.col("x")).alias("s")).select("kind", F.col("s.type").alias("target"), "s.many")
    return typed.filter(~F.col("target").isin(*t.PRIMITIVES, "")).groupBy("kind", "target", "many").agg(F.count("*").alias("n"))


@query("""SELECT name AS import_name, (SELECT max(p.package_name) FROM (SELECT DISTINCT package_name FROM classes) p WHERE i.name = p.package_name OR i.name LIKE p.package_name || '.%') AS package_name, n FROM (
  SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(source_code, '(?m)^import +(?:static +)?([\\w.]+) *;', 1)) AS name FROM (SELECT DISTINCT id, source_code FROM classes) c) x GROUP BY name) i""")  # fmt: skip
def library_prefix_join(spark, d):
    found = F.regexp_extract_all("source_code", F.lit(r"(?m)^import +(?:static +)?([\w.]+) *;"), F.lit(1))
    imports = _classes(spark, d, "source_code").select(F.explode(found).alias("import_name")).groupBy("import_name").agg(F.count("*").alias("n"))
    return r.prefix_join(imports, "import_name", table(spark, d, "classes", "package_name"), "package_name").select("import_name", "package_name", "n")


@query("""SELECT id, super_class_name, len(interfaces) AS interfaces, class_type, end_line - start_line + 1 AS lines FROM (SELECT DISTINCT id, super_class_name, interfaces, class_type, start_line, end_line FROM classes) c
 WHERE super_class_name IS NOT NULL OR len(interfaces) > 0""")  # fmt: skip
def class_hierarchy(spark, d):
    c = _classes(spark, d, "super_class_name", F.size("interfaces").alias("interfaces"), "class_type", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return c.filter("super_class_name is not null or interfaces > 0")


@query(r"""WITH c AS (SELECT DISTINCT id, regexp_replace(source_code, {skipped}, ' ', 'g') AS code FROM methods WHERE source_code <> ''),
 b AS (SELECT id, code, len(string_split(regexp_extract(code, '(?s)(\{{.*\}})', 1), chr(10))) AS lines, len(regexp_extract_all(code, '\breturn\s+null\s*;')) AS null_returns, len(regexp_extract_all(code, '\belse\s+if\s*\(')) AS else_ifs FROM c)
 SELECT id, lines, null_returns, else_ifs FROM b WHERE lines > 20 OR null_returns > 0 OR else_ifs > 0""".format(skipped="'" + SKIPPED.replace("'", "''") + "'"))  # fmt: skip
def code_quality_violations(spark, d):
    return r.code_quality(table(spark, d, "methods", "id", "source_code"), most=20)


@query("""SELECT doc_id, message, count(*) AS n FROM (SELECT doc_id, regexp_extract(line, '(?:\\[ERROR\\]|ERROR +\\[[^\\]]*\\])[ \\t]+(.+)', 1) AS message FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(text, 'ERROR')) l
 WHERE contains(line, 'ERROR')) m WHERE message <> '' AND NOT contains(message, 'Failed to execute goal') AND NOT contains(message, 'To see the full stack trace') GROUP BY doc_id, message""")  # fmt: skip
def build_errors(spark, d):
    logs = table(spark, d, "documents", "doc_id", "text").filter(F.contains("text", F.lit("ERROR")))
    lines = logs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.contains("line", F.lit("ERROR")))
    found = lines.select("doc_id", F.regexp_extract("line", r"(?:\[ERROR\]|ERROR +\[[^\]]*\])[ \t]+([^\n]+)", 1).alias("message"))
    noise = F.contains("message", F.lit("Failed to execute goal")) | F.contains("message", F.lit("To see the full stack trace"))
    return found.filter((F.col("message") != "") & ~noise).groupBy("doc_id", "message").agg(F.count("*").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE contains(text, 'Tests run:') OR contains(text, '<<< ')),
 m AS (SELECT doc_id, pos, TRY_CAST(regexp_extract(line, 'Tests run: *([0-9]{1,9})', 1) AS INT) AS run, coalesce(TRY_CAST(regexp_extract(line, 'Failures: *([0-9]{1,9})', 1) AS INT), 0) + coalesce(TRY_CAST(regexp_extract(line, 'Errors: *([0-9]{1,9})', 1) AS INT), 0) AS failed,
  coalesce(TRY_CAST(regexp_extract(line, 'Skipped: *([0-9]{1,9})', 1) AS INT), 0) AS skipped, nullif(regexp_extract(line, '([\w.$]+)[^<]*<<< (?:FAILURE|ERROR)!', 1), '') AS name FROM l)
 SELECT doc_id, arg_max(run, pos) AS run, CAST(sum(CASE WHEN run IS NOT NULL THEN failed END) AS BIGINT) AS failed, arg_max(CASE WHEN run IS NOT NULL THEN skipped END, CASE WHEN run IS NOT NULL THEN pos END) AS skipped,
  arg_max(run, pos) - CAST(sum(CASE WHEN run IS NOT NULL THEN failed END) AS BIGINT) AS passed, array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE name IS NOT NULL)), ',') AS failed_tests FROM m GROUP BY doc_id HAVING count(run) > 0"""  )  # fmt: skip
def test_summary(spark, d):
    return r.test_summary(table(spark, d, "documents", "doc_id", "text"), "doc_id").withColumn("failed_tests", F.when(F.size("failed_tests") > 0, F.array_join("failed_tests", ",")))


@query("""SELECT id, md5(trim(regexp_replace(regexp_replace(trim(response), '^```[A-Za-z]*\\s*', ''), '\\s*```$', ''))) AS body FROM (SELECT DISTINCT id, response FROM llm_call_metrics) c WHERE response LIKE '```%'""")
def strip_code_fence(spark, d):
    rows = table(spark, d, "llm_call_metrics", "id", "response").filter(F.col("response").startswith("```")).dropDuplicates(["id"])
    return rows.select("id", F.md5(t.strip_code_fence(F.col("response"))).alias("body"))


@query("""SELECT conversation_id, arg_max(is_active, last_activity) AS is_active, max(last_activity) AS last_activity FROM (SELECT conversation_id, is_active, created_at AS last_activity FROM conversations WHERE created_at IS NOT NULL
 UNION ALL SELECT conversation_id, is_active, last_activity FROM conversations WHERE last_activity IS NOT NULL) c GROUP BY conversation_id""")  # fmt: skip
def snapshot_upsert(spark, d):
    c = table(spark, d, "conversations")
    old = c.filter("created_at is not null").select("conversation_id", "is_active", F.col("created_at").alias("last_activity"))
    return r.upsert(old, c.filter("last_activity is not null").select("conversation_id", "is_active", "last_activity"), ["conversation_id"], "last_activity")


@query("SELECT source, doc_kind, count(*) AS documents, count(text) AS with_text, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source, doc_kind")
def documents_by_source(spark, d):
    return table(spark, d, "documents", "source", "doc_kind", "text").groupBy("source", "doc_kind").agg(F.count("*").alias("documents"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("chars"))
