"""Every registered core query with SQL, beside that SQL, on the smallest tables; the rest must run."""

import pytest
from compare import differences, views
from siteloom.plans import registry

SLOW = {"shop_issues_by_rule", "shop_summary"}


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(registry.QUERIES[name](spark, sf), con, registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - SLOW))
def test_query_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns
    df.count()


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    root = Path(registry.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "siteloom.llm" not in p.read_text(), p
