import pytest

from nearfield.plans import registry
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(registry.queries()[name](spark, SF).toPandas(), registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "table"), [("stream_answered", "embeddings"), ("stream_filtered", "events")])
def test_streams_of_tables_in_parts(spark, tmp_path, name, table):
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    whole.limit(1).write.parquet(str(tmp_path / f"{table}.parquets"))  # another table
    same(registry.queries()[name](spark, str(tmp_path)).toPandas(), registry.oracle_sql()[name], str(tmp_path))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
