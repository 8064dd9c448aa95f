import pytest
from loomgraph.functions import java as j
from loomgraph.operators import java as o
from pyspark.sql import functions as F

SOURCE = '''package a.b;
import java.util.List;
import static c.d.Tool.run;
/** class Fake { void no() {} } */
@Entity(name = "x{")
public abstract class Store<T extends Item> extends Base<T> implements Reader, c.d.Writer<T> {
    private final List<Item> items = new ArrayList<>();
    static int[] sizes = {1, 2}, more;
    String text = "} void hidden() {";
    static { init(); }
    public Store(final Clock clock, @Nullable Map<String, List<Long>> m) throws IOException { this.clock = clock; }
    @Override
    public <K extends Comparable<K>> Optional<Item> find(K key, int... at) { if (x) { items.get(0); } return Cache.of(key); }
    protected abstract void load(Item[] all) throws a.b.Lost, Broken;
    class Inner { int deep() { return 1; } }
    Runnable task = () -> { helper.go(); };
    void cut() { new Widget(
'''
SCHEMA = "id string, name string, fully_qualified_name string, package_name string, class_type string, source_code string, source_file_path string"


@pytest.fixture(scope="module")
def classes(spark):
    rows = [("1", "Store", "a.b.Store", "a.b", "CLASS", SOURCE, "f")] * 2 + [("2", "Empty", "a.Empty", "a", "CLASS", "", "f"), ("3", "N", "a.N", "a", None, None, "f"), ("4", "Kind", "a.Kind", "a", "ENUM", "enum Kind { A, B(1) { int f() { return 1; } }; Kind(int n) {} int g() { return 2; } }", "g")]
    return spark.createDataFrame(rows, SCHEMA)


def test_entities(classes):
    found = sorted((r.class_id, r.place, r.kind, r.name, r.type, r.has_body) for r in o.entities(classes).collect())
    assert [x[2:] for x in found if x[0] == "1"] == [
        ("FIELD", "items", "List<Item>", False), ("FIELD", "sizes", "int[]", False), ("FIELD", "text", "String", False), ("CONSTRUCTOR", "Store", "", True),
        ("METHOD", "find", "Optional<Item>", True), ("METHOD", "load", "void", False), ("TYPE", "Inner", "", True), ("FIELD", "task", "Runnable", False), ("METHOD", "cut", "void", True),
    ]
    assert [x[2:4] for x in found if x[0] == "4"][0][0] == "CONSTANTS" and {x[3] for x in found if x[0] == "4"} >= {"Kind", "g"}
    assert {x[0] for x in found} == {"1", "4"}


def test_relationships(classes):
    found = {(r.kind, r.target) for r in o.relationships(classes).filter("source_id = '1'").collect()}
    assert found >= {("EXTENDS", "Base"), ("IMPLEMENTS", "Reader"), ("IMPLEMENTS", "c.d.Writer"), ("HAS_CONSTRUCTOR", "Store"), ("HAS_METHOD", "find"), ("HAS_FIELD", "items"), ("TYPE_DEPENDENCY", "Item"),
                     ("CALLS", "METHOD:get"), ("CALLS", "METHOD:of"), ("CALLS", "METHOD:go"), ("INSTANTIATES", "ArrayList"), ("INSTANTIATES", "Widget")}
    assert not {("HAS_METHOD", "hidden"), ("HAS_METHOD", "no"), ("HAS_METHOD", "deep")} & found
    rich = {(r.kind, r.target, r.cardinality) for r in o.rich_dependencies(classes).filter("source_id = '1'").collect()}
    assert rich >= {("INJECTS", "a.b.Item", "MANY"), ("INJECTS", "a.b.Clock", "ONE"), ("RETURNS", "a.b.Item", "ONE"), ("THROWS", "a.b.Lost", "ONE"), ("THROWS", "a.b.Broken", "ONE"), ("ACCEPTS", "a.b.Item", "MANY"), ("EXTENDS", "a.b.Base", "ONE")}
    assert not any(t in ("int", "void") for _, t, _ in rich)
    assert o.entities(classes.limit(0)).count() == 0


def test_joins(spark):
    rel = spark.createDataFrame([("1", "EXTENDS", "B"), ("2", "EXTENDS", "C"), ("2", "CALLS", "METHOD:f"), ("1", "HAS_METHOD", "f"), ("3", "IMPLEMENTS", "B")], "source_id string, kind string, target string")
    nodes = spark.createDataFrame([("1", "A", "x"), ("2", "B", "x"), ("3", "D", "y")], "id string, name string, file string")
    assert {(r.source_id, r.target) for r in o.two_hops(rel, nodes, ("EXTENDS", "IMPLEMENTS")).collect()} == {("1", "B"), ("2", "C"), ("3", "B"), ("1", "C"), ("3", "C")}
    assert {(r.callee, r.caller_id) for r in o.callers(rel.filter("kind = 'CALLS'"), o.members_of(rel, nodes, "HAS_METHOD")).collect()} == {("A.f", "2")}
    files = {r.file: (r.types, r.dependencies, r.subclasses, r.confidence) for r in o.context_files(nodes, rel).collect()}
    assert files == {"x": (2, 2, 1, 1.0), "y": (1, 1, 0, 1.0)}


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(j.resolve_type(F.lit(t), F.lit("a.b"))) for t in ("x.Y", "int", "Item")] == ["x.Y", "java.lang.int", "a.b.Item"]
    imported = F.array(F.lit("c.d.Item"), F.lit("e.Items"))
    assert [one(j.resolve_fqn(F.lit(t), imported, F.lit("a"))) for t in ("Item", "Other", "String", "z.Q")] == ["c.d.Item", "a.Other", "String", "z.Q"]
    assert [one(j.class_from_chunk_id(F.lit(t))) for t in ("r:a.b.C.m", "r:a.b.C.F_field", "a.b.C", "C", None)] == ["a.b.C", "a.b.C", "a.b.C", None, None]
    assert one(j.class_name_from_code(F.lit(SOURCE))) == "a.b.Store" and one(j.class_name_from_code(F.lit("class A {}"))) == ""
    assert one(o.has_library(F.array(F.lit("c.d.E")), "c.d")) and not one(o.has_library(F.array(F.lit("c.de.E")), "c.d"))
