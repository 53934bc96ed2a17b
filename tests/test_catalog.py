import pytest

from tests.helpers import assert_same
from tracelake import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, tiny, name):
    assert_same(catalog.QUERIES[name](spark, tiny), catalog.ORACLE[name], tiny)


def test_every_query_has_sql():
    assert sorted(catalog.QUERIES) == sorted(catalog.ORACLE)


def test_entry_runs_without_the_other_subpackage(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__

    assert sorted(__spark_entry__.queries()) == sorted(catalog.QUERIES)
    assert sorted(__spark_entry__.oracle_sql()) == sorted(catalog.ORACLE)
    sys.modules.pop("__spark_entry__", None)


def test_flagship(spark, tiny):
    assert catalog.flagship(spark, tiny).count() > 0
