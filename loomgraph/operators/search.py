"""Search over entities: by metadata, text, path, structure, keywords and vectors; dispatch, union and ranking.

``entities``: id, repo, name, fully_qualified_name, package_name, path, annotations, source_code, summary, javadoc, label. Hits are found
and scored where a row is read, and only ids and scores are shuffled; repeated rows are alike and count once.
Every limit is a parameter, and what is within it is defined by score and id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.operators.metrics import top_per_group
from loomgraph.operators.retrieval import first_then_rank


def _any_of(tests: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in tests), F.lit(False)), F.lit(False))


def _first(hits: DataFrame, limit: int | None) -> DataFrame:
    once = hits.distinct()
    return once if limit is None else once.orderBy("id").limit(limit)


def in_repositories(entities: DataFrame, repos: list[str] | None) -> DataFrame:
    return entities.filter(F.col("repo").isin(*repos)) if repos else entities


def metadata_filter(entities: DataFrame, annotations: str | None = None, name: str | None = None, package: str | None = None, limit: int | None = 50) -> DataFrame:
    """Ids that fulfil all given conditions: one of the comma-separated annotations, one of the terms between ``|`` in the name, the package."""
    rows = entities
    if annotations:
        wanted = [a.strip() for a in annotations.split(",")]
        rows = rows.filter(F.coalesce(F.arrays_overlap("annotations", F.array(*map(F.lit, wanted))), F.lit(False)))
    if name:
        terms = [x.strip() for x in name.split("|")] if "|" in name else [name]
        rows = rows.filter(_any_of([F.contains("name", F.lit(x)) for x in terms]))
    if package:
        rows = rows.filter(F.col("package_name") == package)
    return _first(rows.select("id"), limit)


def file_pattern(entities: DataFrame, pattern: str, limit: int | None = 20) -> DataFrame:
    """id and path of what has a path in which the regular expression is found."""
    return _first(entities.select("id", "path").filter(F.col("path").rlike(pattern)), limit)


def full_text_search(entities: DataFrame, text: str, limit: int | None = 20) -> DataFrame:
    """Ids whose source, summary or javadoc contains the text, in the same case."""
    return _first(entities.filter(_any_of([F.contains(c, F.lit(text)) for c in ("source_code", "summary", "javadoc")])).select("id"), limit)


def structural_terms(query: str) -> list[str]:
    terms = [w for w in query.split() if len(w) > 2 and w[0].isupper()]
    return terms or [query]


def structural_search(entities: DataFrame, query: str, repos: list[str] | None = None, limit: int | None = 50) -> DataFrame:
    """id and score 1 of what has a capitalised word of the query in its name (the whole query if there is none), in these repositories."""
    hits = in_repositories(entities, repos).filter(_any_of([F.contains("name", F.lit(x)) for x in structural_terms(query)]))
    return _first(hits.select("id", F.lit(1.0).alias("score")), limit)


def query_words(query: str) -> list[str]:
    """The words of a query as ``functions.text.tokenize_query`` finds them, each once: they are literals of the plan."""
    words = ("".join(c for c in w if c.isascii() and c.isalnum()) for w in query.strip().lower().split())
    return list(dict.fromkeys(w for w in words if len(w) > 2 and w not in t.STOP_WORDS))


def keyword_search(entities: DataFrame, query: str, repos: list[str] | None = None, k: int = 20) -> DataFrame:
    """id and score of the best ``k`` of those with a word of the query in name, full name or source: ranked before they are cut off."""
    words = query_words(query)
    score = F.round(t.keyword_score(words, F.col("name"), F.col("fully_qualified_name"), F.col("source_code")), 6)
    scored = in_repositories(entities, repos).select("id", score.alias("score"))
    return (scored.filter("score > 0") if words else scored).distinct().orderBy(F.desc("score"), "id").limit(k)


def hybrid_search(structural: DataFrame, semantic: DataFrame) -> DataFrame:
    """id, score and origin: all structural hits, and the semantic ones with other ids."""
    rest = semantic.join(structural.select("id"), "id", "left_anti")
    return structural.select("id", "score", F.lit("structural").alias("origin")).unionByName(rest.select("id", "score", F.lit("semantic").alias("origin")))


def search_mode(query: str) -> str:
    """The mode of a query, see ``functions.text.search_mode``."""
    low = query.lower()
    if any(w in low for w in ("call", "depend", "extend", "implement", "relationship")):
        return "STRUCTURAL"
    return "TEMPORAL" if any(w in low for w in ("change", "history", "recent", "modified", "commit")) else "SEMANTIC"


def search(entities: DataFrame, query: str, mode: str | None = None, repos: list[str] | None = None, k: int = 20) -> DataFrame:
    """id and score by the mode given or that of the query's words: STRUCTURAL, SEMANTIC, HYBRID (semantic top 10) or TEMPORAL (the last changed with a word of the query)."""
    mode = mode or search_mode(query)
    if mode == "STRUCTURAL":
        return structural_search(entities, query, repos)
    if mode == "HYBRID":
        return hybrid_search(structural_search(entities, query, repos), keyword_search(entities, query, repos, 10)).select("id", "score")
    return keyword_search(entities, query, repos, k)


def broad_overview(documents: DataFrame) -> DataFrame:
    """id and part of what describes a whole repository: at most one readme, two main classes and one build file (gradle only where there is no pom).

    ``documents``: id, path, text. Within a part the smallest ids.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    part = (
        F.when(name.startswith("readme") | F.lower("path").startswith("readme/"), "readme")
        .when(F.contains("text", F.lit("@SpringBootApplication")), "main")
        .when(name == "pom.xml", "pom")
        .when(name.startswith("build.gradle"), "gradle")
    )
    parts = documents.select("id", part.alias("part")).filter("part is not null").distinct()
    firsts = top_per_group(parts, ["part"], [F.col("id")], 2).filter("rank = 1 or part = 'main'")
    no_gradle = parts.filter("part = 'pom'").select(F.lit("gradle").alias("part")).limit(1)
    return firsts.join(no_gradle, "part", "left_anti").select("id", "part")


def execute_plan(entities: DataFrame, plan: list[tuple[str, dict]], k: int = 50) -> DataFrame:
    """id, score and strategy of the best ``k`` of a retrieval plan: a list of (strategy, arguments) whose results are united in their order, the first of an id counts.

    Strategies: metadata_filter, file_pattern, semantic_search (full text), keyword_search, structural_search; unknown ones give nothing.
    """
    known = {"metadata_filter": metadata_filter, "file_pattern": file_pattern, "semantic_search": full_text_search, "keyword_search": keyword_search, "structural_search": structural_search}
    none = entities.select("id", F.lit(1.0).alias("score")).limit(0)
    results = [known[name](entities, **arguments) if name in known else none for name, arguments in plan]
    return first_then_rank([r.select("id", (F.col("score") if "score" in r.columns else F.lit(1.0)).alias("score")) for r in results] or [none], k)


#: Queries and rows are compared in blocks of so many.
QUERY_BLOCK, ROW_BLOCK = 512, 8192


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, digits: int = 5) -> DataFrame:
    """query_id, vec_id, score, place: the ``k`` vectors with the largest cosine to each query, exactly; ties go by vec_id.

    ``vectors`` and ``queries``: vec_id, embedding (array<float>). Every block of queries meets every block of rows in a task of
    its own as one product of matrices, and sends ``k`` rows of each query on; nothing is collected. Null vectors and those
    of another length than their block's first are left out, a zero vector has cosine 0.
    """

    def blocks(df: DataFrame, size: int, prefix: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // size))  # a count of ids: no vector is read for it
        return df.select(F.col("vec_id").alias(f"{prefix}id"), F.col("embedding").cast("array<float>").alias(f"{prefix}v"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(f"{prefix}block")).filter(f"{prefix}v is not null"), n

    q, n_q = blocks(queries, QUERY_BLOCK, "q")
    r, n_r = blocks(vectors, ROW_BLOCK, "r")
    left = q.withColumn("rblock", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    right = r.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def matrix(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = t[name].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        fit = sizes == sizes[0]
        m = lists.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(1, sizes[0]))
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        return m / np.where(norm == 0, 1, norm), fit

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (x, fit_x), (y, fit_y) = matrix(a, "qv"), matrix(b, "rv")
        ids, of = np.array(b["rid"].to_pylist())[fit_y], np.array(a["qid"].to_pylist())[fit_x]
        if x.shape[1] != y.shape[1]:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        score = np.round(x @ y.T, digits)
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
        return pa.table({"query_id": pa.array(np.repeat(of, order.shape[1]), pa.int64()), "vec_id": pa.array(ids[order].ravel(), pa.int64()), "score": pa.array(np.take_along_axis(score, order, 1).ravel(), pa.float64())})

    best = left.groupBy("qblock", "rblock").cogroup(right.groupBy("qblock", "rblock")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    return top_per_group(best, ["query_id"], [F.desc("score"), F.col("vec_id")], k).withColumnRenamed("rank", "place")
