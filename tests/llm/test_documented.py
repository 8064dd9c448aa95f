from loomgraph.llm.documented import description, documented_functions, trivial
from loomgraph.llm.java_members import members

SOURCE = '''/* licence */
package a.b;

/** About the class. */
@Marker(value = "({", names = {"a", "b"})
public class Outer<T extends Comparable<T>> extends Base implements Face {
    private final Map<String, List<int[]>> x = new HashMap<>() {{ put("}", null); }};
    static { int y = '}'; }
    /** Makes one out of nothing. */
    public Outer(final Map<String, Long> first, int... rest) { this.x = "{"; }

    /** Old words. */
    /** Walks } the { tree. */
    // a line comment {
    @Override @Query("select '(x'")

    public <A> A walk(A tree) throws IOException {
        String t = """
            /** No code. */ void hidden() { }
            """;
        /** inside */
        Runnable r = () -> { };
        return new Face() { public void run() { } };
    }

    /** Cut off by the block comment. */
    /* why */
    void plain() { }

    /** Has no body. */
    abstract int none();

    /** A field. */
    int[] field = { 1, 2 };
    int after() { return 0; }

    enum Kind {
        /** First constant. */
        ONE(1) { /** Runs one. */ void go() { } },
        TWO(2);
        /** Builds a kind of its number. */
        Kind(int n) { }
    }
    interface Inner { /** Default words. */ default void d() { } }
    record Pair(int a, String b) { /** Checks both sides. */ Pair { } }
}
'''


def test_members_of_a_file():
    found, any_doc = members(SOURCE)
    assert any_doc and all(m.closed for m in found)
    docs = {m.name: m.doc for m in found}
    assert [m.name for m in found] == ["Outer", "walk", "plain", "after", "go", "Kind", "d", "Pair"]
    assert docs["walk"] == "/** Walks } the { tree. */" and docs["plain"] is None and docs["after"] is None
    assert docs["d"] == "/** Default words. */" and docs["Pair"] == "/** Checks both sides. */" and docs["Kind"].startswith("/** Builds")
    lines = SOURCE.split("\n")
    assert all(m.name in lines[m.line - 1] for m in found)
    walk = found[1]
    assert walk.params == ("tree",) and walk.owner == "Outer" and SOURCE[walk.start : walk.end].startswith("@Override") and SOURCE[walk.start : walk.end].endswith("};\n    }")
    assert found[0].params == ("first", "rest")


def test_sources_that_end_early():
    for end in range(0, len(SOURCE), 7):
        members(SOURCE[:end])
    found, _ = members("/** Does a thing. */ void cut() { if (x) {", True)
    assert [(m.name, m.closed) for m in found] == [("cut", False)]


def test_trivial():
    say = lambda text, name="loadBatch", params=("maxRows1",), owner="BatchStore": trivial(description(text), name, params, owner)
    for text in ("", "/** */", "/**\n * <p></p>\n */", "/** TODO: write what it does with rows */", "/** {@inheritDoc} */", "/** See {@link Other#load}. */", "Loads the batch.", "Method loadBatch",
                 "loadBatch with the parameters maxRows1", "@return rows", "/** @param x the thing */", "Batch loading", "(non-Javadoc)", "...", "Add comment here", "n/a"):
        assert say(text), text
    for text in ("Idempotent.", "Only for tests.", "Loads the batch twice.", "{@inheritDoc} Also flushes.", "See {@link Other} before changing the order of calls.", "Пишет журнал.", "返回缓存。"):
        assert not say(text), text


def test_rows(spark):
    schema = "table_name string, id string, source_code string, javadoc string, owner string, single boolean, code int"
    rows = [
        ("methods", "a", "void f() { }", "Never blocks.", "x.Y", True, 1),
        ("methods", "a", "void f() { }", "Never blocks.", "x.Y", True, 2),
        ("methods", "b", "/** Runs\r\n * late. */\r\nvoid g() {\r\n}", "other", "x.Y", True, 1),
        ("methods", "c", None, "Never blocks.", None, True, 1),
        ("methods", "d", "", None, None, None, None),
        ("classes", "e", "class K { void m() { } }", None, None, False, 1),
        ("methods", "f", "abstract void h();", "Never blocks.", "x.Y", True, 1),
        ("methods", "g", "/** */ void h() { }", "Never blocks.", "x.Y", True, 1),
        ("methods", None, "void h() { " + "x = '}'; " * 20000 + "}", "Never blocks.", "x.Y", True, 1),
    ]
    got = sorted((r.table_name, r.id or "", r.method_name, r.start_line, r.description) for r in documented_functions(spark.createDataFrame(rows, schema)).collect())
    assert got == [("methods", "", "h", 1, "Never blocks."), ("methods", "a", "f", 1, "Never blocks."), ("methods", "b", "g", 3, "Runs\nlate.")]
    assert documented_functions(spark.createDataFrame([], schema)).count() == 0


def test_more_that_says_nothing():
    for text in ("See the documentation in {@link PaymentStore#load} for all details.", "Please see the documentation of the interface for a description of this method.",
                 "This is a template comment, replace this text with a description\nof what the code does and of its parameters.", "This method is used to build the ticket parcel, that is, it builds the ticket parcel."):
        assert trivial(text, "buildTicketParcel", (), "Store"), text
    for text in ("Uses the audit trail as described in QM-1.", "This method is used to build the ticket parcel without a lock on the store."):
        assert not trivial(text, "buildTicketParcel", (), "Carrier"), text


def test_time_is_linear():
    import time

    def took(n):
        source = "class A {\n" + "/** Says something new. */ /* x */ @Deprecated\n /** Blocks the caller. */ int f(@Nullable /* y */ String a) { return 1; }\n" * n + "@A /* c */ " * n + "void g() {} }"
        began = time.process_time()
        found, _ = members(source)
        assert len(found) == n + 1 and found[n - 1].line == 2 * n + 1
        return time.process_time() - began

    took(100)
    assert took(8000) < 8 * took(2000) + 0.2
