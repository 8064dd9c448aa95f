import datetime as dt

from loomgraph.operators.references import match_runs, key_runs, orphan_references, orphans_by_month

T = dt.datetime(2025, 3, 1)
LATER = dt.datetime(2025, 4, 1)
REFS = "table_name string, row_key string, ref_table string, ref_key string, ref_time timestamp_ntz, kind int, key string"
PARENTS = "ref_table string, parent_key string, parent_time timestamp_ntz, found int"
DELETED = "ref_table string, deleted_key string"


def run(spark, refs, parents, deleted=()):
    out = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), spark.createDataFrame(list(deleted), DELETED))
    return {(r.table_name, r.row_key): r.kind for r in out.collect()}, out


def test_kinds(spark):
    ref = lambda k, key, t=T: ("w", k, "c", key, t, 1, "x")
    parents = [("c", "conv-00ff", LATER, 0), ("c", " CONV-00FF\t", T, 0), ("c", "conv-0100", LATER, 0), ("c", "plain", None, 0), ("c", None, T, 0), ("c", " ", T, 0), ("d", "conv-0101", T, 0)]
    refs = [ref("1", "Conv-00ff "), ref("2", "conv-0100"), ref("3", "conv-0101"), ref("4", "conv-00fe"), ref("5", None), ref("6", " \t"), ref("7", "plain"), ref("8", "plain2"), ref("9", "conv-0100", LATER),
            ref("3", "conv-0101"), ref("10", "conv-0100", None), ref("11", "conv-ff"), ref("12", "conv-000ff"), ref(None, "gone")]
    got, out = run(spark, refs, parents, [("c", " conv-00FE"), ("d", "conv-0101")])
    assert got == {("w", "2"): "late", ("w", "3"): "missing", ("w", "4"): "deleted", ("w", "8"): "missing", ("w", "11"): "missing", ("w", "12"): "missing", ("w", None): "missing"}
    months = {r.month: (r.orphans, r.late) for r in orphans_by_month(out).collect()}
    assert months == {"2025-03": (7, 1)}


def test_empty_tables(spark):
    assert run(spark, [], [])[0] == {}
    assert run(spark, [("w", "1", "c", "a", T, 1, "x")], [])[0] == {("w", "1"): "missing"}
    assert run(spark, [], [("c", "a", T, 0)])[0] == {}


def test_runs_against_brute_force(spark):
    import random

    r = random.Random(2)
    keys = {f"k-{n:06x}" for n in r.sample(range(5000), 3000)} | {f"k-{n:012x}" for n in (r.getrandbits(48) for _ in range(500))} | {"a", "zz9", "k-", "ffffffffffffffffffff", "k-\n1"}
    asked = sorted({f"k-{n:06x}" for n in range(0, 5200, 3)} | {k for k in keys if r.random() < 0.5} | {"b", "k", "k-0"})
    parents = spark.createDataFrame([("c", k, i) for i, k in enumerate(sorted(keys))], "ref_table string, key string, first_time bigint")
    runs = key_runs(parents)
    assert runs.count() < len(keys)
    got = {x.key: (x.found, x.parent_time) for x in match_runs(spark.createDataFrame([("c", k) for k in asked], "ref_table string, key string"), runs).collect()}
    at = {k: i for i, k in enumerate(sorted(keys))}
    assert got == {k: (k in keys, at.get(k)) for k in asked}


def test_one_hot_key(spark):
    refs = spark.range(20000).selectExpr("'w' table_name", "cast(id as string) row_key", "'c' ref_table", "if(id % 3 = 0, 'hot', concat('k', id % 50)) ref_key", "timestamp_ntz '2025-01-01' ref_time")
    parents = spark.createDataFrame([("c", f"k{i}", T, 0) for i in range(49)], PARENTS).drop("parent_time").selectExpr("*", "timestamp_ntz '2024-01-01' parent_time")
    out = orphan_references(refs, parents, spark.createDataFrame([], DELETED))
    assert out.count() == 6667 + refs.filter("ref_key = 'k49'").count()
