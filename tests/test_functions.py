import pytest
from loomgraph.functions import text as t
from loomgraph.operators import retrieval as r
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("scores,want", [([0.9, 0.9, 0.88, 0.6, 0.5], 0.8), ([0.6, 0.5], 0.5), ([], 0.5), ([0.9, 0.8], 0.63), ([0.7, 0.7, 0.65, 0.4], 0.65), ([0.9, 0.89, 0.88, 0.87], 0.63)])
def test_threshold(spark, scores, want):
    assert one(spark, r.adaptive_threshold(F.lit(scores) if scores else F.array().cast("array<double>"))) == pytest.approx(want)


def test_text_functions(spark):
    assert one(spark, t.tokenize_query(F.lit("How does the PaymentService retry?"))) == ["paymentservice", "retry"]
    assert one(spark, t.keyword_score(["pay", "retry"], F.lit("payService"), F.lit("a.payService"), F.lit("retry()"))) == pytest.approx(4 / 6)
    assert [one(spark, t.search_mode(F.lit(q))) for q in ("recent calls", "recent edits", "login flow")] == ["STRUCTURAL", "TEMPORAL", "SEMANTIC"]
    for url in ("https://Git.invalid/team/Repo.git", "git@git.invalid:team/repo.git", "ssh://git@git.invalid:22/team/repo/", " https://git.invalid/team/repo?x=1"):
        assert one(spark, t.repository(F.lit(url))) == "git.invalid/team/repo", url
    assert one(spark, t.strip_code_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert [one(spark, t.package_of(F.lit(n))) for n in ("a.b.C", "C", None)] == ["a.b", "", ""]
    kinds = {n: tuple(one(spark, t.simple_type(F.lit(n)))) for n in ("List<Node>", "Optional<Node>", "Map<String, Long>", "byte[]", "a.B")}
    assert kinds == {"List<Node>": ("Node", True), "Optional<Node>": ("Node", False), "Map<String, Long>": ("Map", False), "byte[]": ("byte", True), "a.B": ("a.B", False)}


def test_rank_and_upsert(spark):
    a, b = spark.createDataFrame([("x", 0.2), ("y", 0.9)], "id string, score double"), spark.createDataFrame([("x", 0.99), ("z", 0.9)], "id string, score double")
    assert [(v.id, v.score, v.strategy) for v in r.first_then_rank([a, b], 2).collect()] == [("y", 0.9, 0), ("z", 0.9, 1)]
    old, new = spark.createDataFrame([("k", 1, "old"), ("m", 5, "old")], "key string, at int, v string"), spark.createDataFrame([("k", 1, "new"), ("m", 4, "new"), ("n", None, "new")], "key string, at int, v string")
    assert {(v.key, v.v) for v in r.upsert(old, new, ["key"], "at").collect()} >= {("k", "new"), ("m", "old")}


def test_prefix_join(spark):
    names = spark.createDataFrame([("a.b.C",), ("a.bc.D",), ("z.Q",), ("a.b.c.E",), (None,)], "name string")
    prefixes = spark.createDataFrame([("a.b",), ("a",), ("a.b.c",), ("a",), (None,)], "prefix string")
    assert {(v.name, v.prefix) for v in r.prefix_join(names, "name", prefixes, "prefix").collect()} == {("a.b.C", "a.b"), ("a.bc.D", "a"), ("z.Q", None), ("a.b.c.E", "a.b.c"), (None, None)}
