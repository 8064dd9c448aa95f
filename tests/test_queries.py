import oracle
import pytest
from loomgraph.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data("sf0.001"))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, data, con, name):
    assert oracle.compare(registry.QUERIES[name](spark, data("sf0.001")), registry.SQL[name], con) is None


def test_every_query_is_named_once():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_core_does_not_need_the_llm_package():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "loomgraph.llm" not in f.read_text(), f


def test_entry_needs_no_session():
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(registry.__file__).parents[2]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-800:]
