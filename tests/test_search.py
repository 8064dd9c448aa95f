import random

import numpy as np
import pytest
from loomgraph.functions import text as t
from loomgraph.operators import finders as f
from loomgraph.operators import retrieval as r
from loomgraph.operators import search as s
from loomgraph.operators import sinks
from pyspark.sql import functions as F

ENT = "id string, repo string, name string, fully_qualified_name string, package_name string, path string, annotations array<string>, source_code string, summary string, javadoc string, label string"


@pytest.fixture(scope="module")
def entities(spark):
    row = lambda i, repo, name, ann, src, doc=None: (i, repo, name, f"p.{name}", "p", f"src/{name}.java", ann, src, None, doc, "CLASS")
    rows = [row("1", "a", "LedgerStore", ["Service"], "refund"), row("2", "b", "RefundPolicy", ["Entity"], "x", "about the ledger"), row("3", "a", "Other", None, None), row("1", "a", "LedgerStore", ["Service"], "refund")]
    return spark.createDataFrame(rows, ENT)


def ids(df):
    return [x.id for x in df.collect()]


def test_searches(entities):
    assert ids(s.metadata_filter(entities, annotations="Service, Entity", name="Store|Policy")) == ["1", "2"]
    assert ids(s.metadata_filter(entities, annotations="Service", name="Policy")) == [] and ids(s.metadata_filter(entities, package="p", limit=2)) == ["1", "2"]
    assert ids(s.full_text_search(entities, "ledger")) == ["2"] and ids(s.file_pattern(entities, "Refund.*java$")) == ["2"]
    assert ids(s.structural_search(entities, "who calls Ledger")) == ["1"] and ids(s.structural_search(entities, "Ledger", ["b"])) == []
    best = s.keyword_search(entities, "the refund ledger").collect()
    assert [(x.id, x.score) for x in best] == [("1", pytest.approx(4 / 6)), ("2", 0.5)]
    assert [x.id for x in s.keyword_search(entities, "of the", k=9).collect()] == ["1", "2", "3"]  # no words: all, with the same score
    hybrid = s.hybrid_search(s.structural_search(entities, "Ledger"), s.keyword_search(entities, "refund")).collect()
    assert {(x.id, x.origin) for x in hybrid} == {("1", "structural"), ("2", "semantic")}
    assert ids(s.search(entities, "what extends Refund")) == ["2"] and ids(s.search(entities, "refund", mode="HYBRID", repos=["b"])) == ["2"]
    plan = [("full moon", {}), ("semantic_search", {"text": "ledger"}), ("keyword_search", {"query": "refund"})]
    assert [(x.id, x.strategy) for x in s.execute_plan(entities, plan).orderBy("id").collect()] == [("1", 2), ("2", 1)]
    assert s.execute_plan(entities, []).count() == 0 and s.keyword_search(entities.limit(0), "refund").count() == 0


def test_query_words_agree_with_the_column_function(spark):
    for q in ("How does the PaymentService retry?", "a an of", "", "naïve ledger-store  X1y2"):
        assert s.query_words(q) == list(dict.fromkeys(spark.range(1).select(t.tokenize_query(F.lit(q)).alias("x")).first().x))
        assert s.search_mode(q) == spark.range(1).select(t.search_mode(F.lit(q)).alias("x")).first().x


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "QUERY_BLOCK", 7)
    monkeypatch.setattr(s, "ROW_BLOCK", 50)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 8)).astype(np.float32)
    v[7], v[9] = v[3], 0
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(500, None)], "vec_id bigint, embedding array<float>")
    got = {}
    for x in s.nearest(df, df.filter("vec_id % 20 = 0"), 5).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    want = {q: sorted(range(200), key=lambda i: (-round(float(n[q].astype(float) @ n[i].astype(float)), 5), i))[:5] for q in range(0, 200, 20)}
    assert got == want
    assert s.nearest(df.limit(0), df).count() == 0


def test_overview(spark):
    docs = spark.createDataFrame([(3, "readme/a.md", ""), (2, "x/README.md", ""), (4, "b.java", "@SpringBootApplication"), (5, "c.java", "@SpringBootApplication"), (6, "d.java", "@SpringBootApplication"), (7, "build.gradle", ""), (8, "p/pom.xml", None), (9, None, None)], "id int, path string, text string")
    assert {(x.id, x.part) for x in s.broad_overview(docs).collect()} == {(2, "readme"), (4, "main"), (5, "main"), (8, "pom")}
    assert {(x.id, x.part) for x in s.broad_overview(docs.filter("id < 8")).collect()} >= {(7, "gradle")}


LOG = """[INFO] Running a.FirstTest
Tests run: 4, Failures: 1, Errors: 0, Skipped: 1, Time elapsed: 0.1 s <<< FAILURE! - in a.FirstTest
a.FirstTest.adds  Time elapsed: 0 s  <<< FAILURE!
a.SecondTest.reads  Time elapsed: 0 s  <<< ERROR!
Tests run: 9, Failures: 1, Errors: 1, Skipped: 2"""


def test_logs_and_quality(spark):
    logs = spark.createDataFrame([(1, LOG), (2, "nothing"), (3, None), (4, "Tests run: 2, Failures: 0, Errors: 0, Skipped: 0")], "doc_id int, text string")
    got = {x.doc_id: (x.run, x.failed, x.skipped, x.passed, x.failed_tests) for x in r.test_summary(logs, "doc_id").collect()}
    assert got[4] == (2, 0, 0, 2, []) and got[1][:4] == (9, 3, 2, 6) and set(got[1][4]) >= {"a.FirstTest.adds", "a.SecondTest.reads"} and set(got) == {1, 4}
    code = 'int f() {\n  if (a) { return null; }\n  else if (b) { }\n  String s = "return null; } {";\n' + "  x();\n" * 18 + "}"
    rows = spark.createDataFrame([("1", code), ("1", code), ("2", "int g() { return 1; } // return null;"), ("3", None)], "id string, source_code string")
    assert [(x.id, x.lines, x.null_returns, x.else_ifs) for x in r.code_quality(rows, 20).collect()] == [("1", 23, 1, 1)]


def test_finders(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    df = spark.createDataFrame([(1, "a", "x,y"), (2, "b", None), (3, None, "xy")], "n int, k string, l string")
    at = lambda d: {x.n for x in d.collect()}
    assert at(f.where_all(df, n=(1, 2), k=["a", "c"])) == {1} and at(f.where_all(df, k=None)) == {1, 2, 3} and at(f.listed(df, "l", "x")) == {1} and at(f.name_contains(df, "k", "B")) == {2}
    assert [one(f.valid_git_url(F.lit(u))) for u in ("https://h.x/t/r.git", "git@h.x:t/r", "h.x/t", "https://h.x/../r", "https://h.x/a;b", None)] == [True, True, False, False, False, False]
    assert [one(f.valid_branch(F.lit(b))) for b in ("feature/a-1", "a..b", "/a", "-a", "a b", "", None)] == [True] + [False] * 6
    u = one(f.parse_git_url(F.lit("https://h.x/t/r.git/tree/dev/one?q=1")))
    assert (u.clone_url, u.branch, u.repo_name) == ("https://h.x/t/r", "dev/one", "r") and one(f.parse_git_url(F.lit("nothing"))) is None
    assert [one(f.contains_all(F.array(F.lit("a"), F.lit("b")), x)) for x in (["a"], ["a", "c"], [])] == [True, False, True]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, repo string")
    for _ in range(2):
        sinks.replace_partitions(rows, path)
        sinks.replace_partitions(rows.filter("repo = 'a'").withColumn("id", F.col("id") + 100), path)
    assert sorted(x.id for x in spark.read.parquet(path).collect()) == [1, 3, 5, 7, 9, 100, 102, 104, 106, 108]
    sinks.retain(str(tmp_path / "u"), rows, F.col("id") > 7)
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2
    nodes = spark.createDataFrame([("a", "r"), ("b", "s"), ("c", "s")], "node_id string, repo string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "s"), ("c", "a", "s"), ("b", "z", "s")], "source_id string, target_id string, repo string")
    left = sinks.delete_repository(nodes, edges, "r")
    assert {x.node_id for x in left[0].collect()} == {"b", "c"} and {(x.source_id, x.target_id) for x in left[1].collect()} == {("b", "c"), ("b", "z")}
    assert {(x.source_id, x.target_id) for x in sinks.with_endpoints(edges, nodes).collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    edge = "source_id string, target_id string, kind string, properties map<string,string>"
    old, new = spark.createDataFrame([("a", "b", "k", {"x": "1", "y": "1"}), ("b", "c", "k", None)], edge), spark.createDataFrame([("a", "b", "k", {"x": "2"}), ("a", "z", "k", {}), ("c", "a", "k", {"n": "1"})], edge)
    merged = {(x.source_id, x.target_id): x.properties for x in sinks.merge_relationships(old, new, nodes).collect()}
    assert merged == {("a", "b"): {"x": "2", "y": "1"}, ("b", "c"): {}, ("c", "a"): {"n": "1"}}
    ents = sinks.merge_entities(spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string"), spark.createDataFrame([(2, "new"), (3, "new"), (2, "newer")], "id int, v string"))
    assert {(x.id, x.v) for x in ents.collect()} == {(1, "old"), (2, "newer"), (3, "new")}


def test_sessions_against_brute_force(spark):
    import datetime as dt

    from loomgraph.operators.metrics import sessions

    rnd, start = random.Random(2), dt.datetime(2025, 1, 1)
    rows = [(i, rnd.choice("abc"), start + dt.timedelta(minutes=rnd.randint(0, 6000))) for i in range(500)] + [(1000, None, start), (1001, "d", None), (1002, "d", start)]
    got = {(x.conversation_id, x.session): (x.started, x.ended, x.calls) for x in sessions(spark.createDataFrame(rows, "id int, conversation_id string, call_ts timestamp_ntz"), 30).filter("conversation_id <> 'd'").collect()}
    want = {}
    for c in "abc":
        n, last = 0, None
        for at in sorted(x[2] for x in rows if x[1] == c):
            if last is None or at > last + dt.timedelta(minutes=30):
                n += 1
            b = want.setdefault((c, n), [at, at, 0])
            b[1], b[2], last = at, b[2] + 1, at
    assert got == {k: tuple(v) for k, v in want.items()}
