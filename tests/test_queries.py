import pytest

from quarrykit.plans import queries as core
from tests.helpers import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, name):
    same_rows(spark, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_other_queries_have_a_row_per_document(spark, name):
    assert core.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_entry_point_imports_and_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
