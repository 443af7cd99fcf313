import pytest
from oracle import assert_same

from alphaloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, small, name):
    assert_same(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_without_sql_gives_whole_images(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert len(got)
    assert not got.isna().any().any()
    if "y" in got.columns:
        assert (got.groupby("image_id").size() == queries.H * queries.W).all()
    for c in [c for c in got.columns if c == "alpha" or c[:2] in ("f_", "b_")]:
        assert got[c].between(0, 1).all()


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.columns == ["image_id", "y", "x", "r", "g", "b", "a"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
