import pytest
from loomgraph.operators import graph as g

EDGES = "source_id string, target_id string, kind string, repo string"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "USES", "r") for a, b in pairs], EDGES)


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start string")


def reached(df):
    return {(r.start, r.node, r.depth) for r in df.collect()}


def test_closure(spark):
    cycle = edges(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("A", "B"), (None, "A"), ("A", None))
    assert reached(g.closure(cycle, start(spark, "A"), 3)) == {("A", "B", 1), ("A", "C", 2), ("A", "A", 3)}
    assert reached(g.closure(cycle, start(spark, "A"), 3, keep_start=False)) == {("A", "B", 1), ("A", "C", 2)}
    line = edges(spark, ("A", "B"), ("B", "C"), ("C", "D"))
    assert reached(g.closure(line, start(spark, "A"), 2)) == {("A", "B", 1), ("A", "C", 2)}
    assert reached(g.closure(g.reverse(line), start(spark, "D", "C"), 5)) == {("D", "C", 1), ("D", "B", 2), ("D", "A", 3), ("C", "B", 1), ("C", "A", 2)}
    assert reached(g.closure(line, start(spark, "Z"), 2)) == set()
    assert reached(g.closure(line.limit(0), start(spark, "A"), 2)) == set()


def test_paths(spark):
    paths = lambda e, most=5: [(r.path, r.hops) for r in g.shortest_paths(e, start(spark, "A"), "D", most).collect()]
    assert paths(edges(spark, ("A", "AB"), ("AB", "B"), ("B", "D"))) == [("A->AB->B->D", 3)]
    assert paths(edges(spark, ("A", "C"), ("C", "D"), ("A", "B"), ("B", "D"))) == [("A->B->D", 2)]
    assert paths(edges(spark, ("A", "B"), ("B", "C"), ("C", "D")), 2) == []


def test_impact(spark):
    many = edges(spark, *[(f"d{i}", "X") for i in range(3)], *[(f"t{i}", "d0") for i in range(5)])
    row = g.impact(many, start(spark, "X", "Y")).filter("start = 'X'").first()
    assert (row.direct, row.transitive, row.critical, row.score, row.risk) == (3, 8, 1, 10.0, "MEDIUM")


@pytest.mark.parametrize("n,risk", [(5, "LOW"), (6, "MEDIUM"), (10, "MEDIUM"), (11, "HIGH"), (20, "HIGH"), (21, "CRITICAL")])
def test_risk(spark, n, risk):
    from pyspark.sql import functions as F

    assert spark.range(1).select(g.risk(F.lit(n)).alias("r")).first().r == risk
