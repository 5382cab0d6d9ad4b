import duckdb
import pytest

import __spark_entry__ as entry
from kinlink import registry

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).columns[:2] == ["s1_entity_id", "entity_id"]


def _value(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(tuple(map(_value, (r[columns.index(c)] for c in sorted(columns)))) for r in result.fetchall())
    rows = registry.queries()[name](spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(tuple(map(_value, (r[c] for c in sorted(columns)))) for r in rows.collect()) == want
