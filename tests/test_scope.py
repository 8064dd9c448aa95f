from loomgraph.operators import graph as g
from loomgraph.operators import scope as s
from loomgraph.sources import files
from pyspark.sql import functions as F

NODES = "node_id string, simple_name string, domain string, file_path string, repo string"


def graph(spark):
    nodes = spark.createDataFrame([("1", "A", "Pay", "src/A.java", "r"), ("2", "B", "pay", "src/B.java", "r"), ("3", "C", "log", "src/C.java", "q"), ("4", "A", None, "x/A.java", "q")], NODES)
    return nodes, spark.createDataFrame([("1", "2"), ("1", "3"), ("3", "4")], "source_id string, target_id string")


def test_scope(spark):
    nodes, edges = graph(spark)
    hits = spark.createDataFrame([("q", "p.C", 0.9), ("q", "p.B", 0.2), ("q", "C", 0.1), ("q", "Z", 0.8)], "asked string, name string, score double")
    assert {(r.place, r.node_id) for r in s.match_to_nodes(hits, nodes).collect()} == {(1, "3"), (3, "2")}
    assert {(r.domain, r.node_id) for r in s.expand_same_domain(nodes.filter("node_id = '1'").select(F.lower("domain").alias("domain"), "node_id"), edges, nodes).collect()} == {("pay", "1"), ("pay", "2")}
    paths = spark.createDataFrame([("src/A.java",), ("B",), ("none.txt",), (None,)], "path string")
    assert {(r.path, r.node_id) for r in s.node_by_path(paths, nodes).collect()} == {("src/A.java", "1"), ("B", "2"), ("none.txt", None), (None, None)}
    assert {(r.source_id, r.from_repo, r.to_repo) for r in s.callers_cross_repo(edges, nodes).collect()} == {("1", "r", "q")}
    asked = spark.createDataFrame([("q", "PAY")], "asked string, domain string")
    found = s.scope_candidates(asked, hits, nodes, edges, 0.85).collect()
    assert {r.node_id for r in found} == {"1", "2", "3"} and all(r.accepted for r in found)
    assert not any(r.accepted for r in s.scope_candidates(asked, hits, nodes, edges, 0.85, most_files=2).collect())
    kept = s.first_of_each(nodes, {"r": 1, "q": 5}, "repo", [F.col("node_id")])
    assert {r.node_id for r in kept.collect()} == {"1", "3", "4"}


def test_context_and_relationships(spark):
    edges = spark.createDataFrame([(a, b, "USES", "r") for a, b in (("A", "B"), ("C", "B"), ("C", "D"), ("X", "Y"))], "source_id string, target_id string, kind string, repo string")
    start = spark.createDataFrame([("B",)], "start string")
    assert {r.node for r in g.full_context(edges, start, 2, 1).collect()} == {"B", "A", "C"}
    asked = spark.createDataFrame([("A", "D"), ("A", "X"), ("A", "A"), ("A", "Q")], "start string, end string")
    got = {(r.start, r.end): (r.hops, r.explanation) for r in g.relationships(edges, asked).collect()}
    assert got[("A", "D")] == (3, "Connected via 1 path(s)") and got[("A", "A")][0] == 0 and got[("A", "X")][0] is None and got[("A", "Q")][1].startswith("No direct")
    paths = {(r.start, r.path, r.hops) for r in g.shortest_paths(edges, spark.createDataFrame([("A",), ("B",)], "start string"), "B", 3).collect()}
    assert paths == {("A", "A->B", 1), ("B", "B", 0)}


def test_hot_nodes_without_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(f"o{i}", "hub", "USES", "r") for i in range(200)] + [("hub", "end", "USES", "r")], "source_id string, target_id string, kind string, repo string")
    starts = edges.select(F.col("source_id").alias("start"))
    want = g.closure(edges, starts, 3).count()
    monkeypatch.setattr(g, "BROADCAST_BYTES", 0)
    assert g.closure(edges, starts, 3).count() == want == 401


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "A.java").write_text("class A {}\n")
    (tmp_path / "src" / "b.txt").write_text("no")
    found = files.source_files(spark, str(tmp_path / "src")).collect()
    assert [(r.path.rpartition("/")[2], r.size, r.text) for r in found] == [("A.java", 11, "class A {}\n")]
    assert files.source_files(spark, str(tmp_path / "nowhere")).count() == 0
    logs = spark.createDataFrame([("a.log", "x"), (None, "y"), ("b", "")], "n string, t string").select(files.with_header(F.col("n"), F.col("t")).alias("x"))
    assert [r.x for r in logs.collect()] == ["=== a.log ===\nx", "=== unknown ===\ny", None]


def scope_cases(spark):
    """Many nodes of a name, a node of several names and rows, one that is found by name and domain, questions with two domains, none, and not asked."""
    rows = [(f"h{i}", "Hot", None, f"f{i % 3}") for i in range(40)] + [("m", "A", None, "x"), ("m", "B", "Pay", "x"), ("m", "B", "pay", None), ("p", "A", "pay", "y"), ("d", "D", "LOG", None), (None, "A", "pay", "z"), ("n", None, "pay", "w")]
    nodes = spark.createDataFrame(rows, "node_id string, simple_name string, domain string, file_path string")
    edges = spark.createDataFrame([("m", "p"), ("h1", "d"), ("h1", "p"), ("h1", "p"), (None, "p"), ("d", None)], "source_id string, target_id string")
    asked = spark.createDataFrame([("q", "PAY"), ("q", "log"), ("q", "log"), ("r", None), (None, "pay"), ("s", "none")], "asked string, domain string")
    hits = spark.createDataFrame([("q", "x.A", 0.9), ("q", "B", 1.0), ("r", "Hot", 0.95), ("r", "A", 0.95), ("r", "B", 0.95), ("t", "D", 0.9), ("t", "Hot", 0.8), (None, "A", 1.0), ("s", "A", None)], "asked string, name string, score double")
    return asked, hits, nodes, edges


def test_scope_candidates_are_those_of_its_sql(spark):
    import duckdb
    import oracle
    from loomgraph.plans import scope as plans

    asked, hits, nodes, edges = scope_cases(spark)
    con = duckdb.connect()
    for name, df in (("hits_", hits), ("nodes_", nodes), ("edges_", edges), ("asked_", asked)):
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {"DOUBLE" if t == "double" else "VARCHAR"}' for c, t in df.dtypes)})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", [tuple(r) for r in df.collect()])
    sql = plans.SQL["scope_candidates"]
    found = sql[sql.index(" found AS") :]
    matched = plans._MATCHED.format("WHERE score >= 0.9")
    sql = f"WITH nodes AS (SELECT * FROM nodes_), edges AS (SELECT * FROM edges_), hits AS (SELECT * FROM hits_), asked AS (SELECT * FROM asked_), {matched}, {found}"
    sql = f"SELECT asked, node_id, file, accepted FROM ({sql})"
    assert oracle.compare(s.scope_candidates(asked.distinct(), hits, nodes, edges, 0.9), sql, con) is None


def test_scope_candidates_of_a_hot_name_are_not_shuffled(spark):
    """The nodes of a name, for all questions that hit it, were made unique and joined by shuffles of 160,000 rows."""
    nodes = spark.range(400).selectExpr("concat('n', id) node_id", "'Hot' simple_name", "cast(null as string) domain", "concat('f', id) file_path")
    hits = spark.range(400).selectExpr("concat('q', id) asked", "'Hot' name", "1.0D score")
    edges = spark.createDataFrame([("n1", "n2")], "source_id string, target_id string")
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        all_ = context.statusStore().executorList(True)
        return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        rows = s.scope_candidates(hits.select("asked", F.lit("geo").alias("domain")), hits, nodes, edges, 0.9).collect()
        assert len(rows) == 160_000 and not any(r.accepted for r in rows) and 0 < shuffled() - before < 500_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
