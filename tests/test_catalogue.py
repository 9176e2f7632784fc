import pytest

from compare import same
from tidemark.plans import archives, catalogue, evidence, studies  # noqa: F401  (the others add their queries to the catalogue)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_its_sql(spark, name):
    frame = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.SQL:
        same(frame, catalogue.SQL[name], SF)
    else:
        assert frame.columns and frame.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
