import pytest
from compare import assert_same

from strandlake.plans import output_queries, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir)
    if name in queries.SQL:
        assert_same(frame, duck, queries.SQL[name])
    else:
        assert frame.count() > 0


def test_entry_has_all_queries(spark):
    assert output_queries.lines_wig is queries.QUERIES["lines_wig"]
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
