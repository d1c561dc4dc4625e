import pytest
from compare import check

from quern.plans import general, index_queries

QUERIES = {**general.QUERIES, **index_queries.QUERIES}
SQL = {**general.ORACLE, **index_queries.ORACLE}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    check(spark, data, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p4_found", "p5_found", "p6_found"} <= set(e.queries())


def test_rest_stands_without_llm():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quern"
    for file in root.rglob("*.py"):
        if "llm" in file.parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quern.llm") for n in names), file
