import random

from loomgraph.llm.truncation import truncated_values, truncation_rates

SCHEMA = "table_name string, id bigint, field_name string, agent_name string, text string, kind int"
TAILS = ["with a delay of {} seconds between the steps.", "and stays private until the next run.", "because {} callers wait for the table.", "before the nightly job removes the batch."]
HEADS = ["The scheduler reads the table", "Every call locks the row", "Our metrics show {} entries", "The planner treats the batch as final"]


def corpus(n):
    r = random.Random(4)
    say = lambda: " ".join(f"{r.choice(HEADS)} {r.choice(TAILS)}".format(r.randint(2, 99), r.randint(2, 99)) for _ in range(r.randint(2, 5)))
    return [("llm_call_metrics", i, "response", f"agent{i % 2}", say(), 0) for i in range(n)]


def found(spark, rows):
    return {r.id for r in truncated_values(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_lost_ends(spark):
    rows = corpus(600)
    row = lambda i, text: ("llm_call_metrics", i, "response", "agent0", text, 0)
    whole = {1001: "The planner treats the batch as final because 12 callers wait for the table.", 1002: None, 1003: "", 1004: " \n ", 1005: "Yes", 1006: "```java\nvoid f() { char c = '{'; } // {\n```",
             1007: '{"a": ["b"], "c": "{"}', 1008: "| a | b |\n|---|---|\n| c | d |", 1009: "Every call locks the row and stays private until the next run. " * 2000}
    cut = {2001: "Every call locks the row with a delay of 7 seconds betw", 2002: "Every call locks the row. The planner treats the", 2003: '{"a": ["b", "c', 2004: "```java\nvoid f() {", 2005: "| a | b |\n| c | d",
           2006: "Every call locks... [+23 chars]", 2007: "Every call locks the row and\n... [TRUNCATED - 5 more chars]", 2008: "Every call…", 2009: "Every call locks the row with a delay of 7"}
    rows += [row(i, t) for i, t in (whole | cut).items()] + [row(2001, cut[2001])]
    got = found(spark, rows)
    assert got >= set(cut) and not got & set(whole)
    assert len(got - set(cut)) == 0


def test_rates_and_empty_tables(spark):
    rows = spark.createDataFrame(corpus(60) + [("llm_call_metrics", 61, "response", None, "cut off {", 0)] * 2 + [("llm_call_metrics", 62, "response", None, None, 0)], SCHEMA)
    rates = {r.agent_name: (r.n_values, r.n_truncated) for r in truncation_rates(rows, truncated_values(rows)).collect()}
    assert rates == {"agent0": (30, 0), "agent1": (30, 0), None: (1, 1)}
    assert truncated_values(spark.createDataFrame([], SCHEMA)).count() == 0


def test_abstraction(spark):
    from loomgraph.llm import truncation as t
    from pyspark.sql import functions as F

    text = "In SessionLeaseExecutor the loadBatch2 call, aafd6a39 of 12345 naïve 日本 (QuotaStore.java:5)"
    row = spark.createDataFrame([(text,)], "text string").select(t._tokens(t._abstract(F.col("text"))).alias("t")).first()
    assert row.t == ["^", "^", "In", "XxExecutor", "the", "xXBatch", "call", ",", "0", "of", "0", "naïve", "日", "本", "(", "XxStore", ".", "java", ":", "0", ")"]


def test_repeated_rows_and_long_copies_are_no_evidence_for_their_own_ends(spark):
    row = lambda i, text: ("llm_call_metrics", i, "response", "agent0", text, 0)
    rows, once, part = corpus(600), "Every call locks the row. The planner treats the", "Every call locks the row with a delay of 7 seconds betw"
    assert found(spark, rows + [row(3001, once), row(3002, part)]) == {3001, 3002}
    assert found(spark, rows + [row(3001, once), row(3002, part)] * 300) == {3001, 3002}
    # one long text, cut, in a third of all rows with ids of their own
    long_ = "Every call locks the row and stays private until the next run. " * 4 + "The planner treats the"
    assert found(spark, rows + [row(i, long_) for i in range(4000, 4300)]) == set(range(4000, 4300))
    # a short message that many rows share is whole
    assert not found(spark, rows + [row(i, "The planner treats the batch as final") for i in range(5000, 5300)])


def test_single_words_and_marks_of_any_length(spark):
    row = lambda i, text: ("llm_call_metrics", i, "response", "agent0", text, 0)
    whole = {6001: "null", 6002: "None", 6003: "-", 6004: "Every"}
    cut = {7001: "Every call locks the row " + "x" * 300 + " [" + "y" * 200 + " 12 more lines " + "z" * 200 + "]", 7002: "Every call locks the row (truncated)"}
    got = found(spark, corpus(600) + [row(i, t) for i, t in (whole | cut).items()])
    assert got >= set(cut) and not got & set(whole)
