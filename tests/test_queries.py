"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    show = lambda v: "~" if v is None else "%.7g" % (float(v) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return sorted("|".join(map(show, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.plans.QUERIES)))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert plain(df.select(*columns).collect()) == plain(want.project(",".join(f'"{c}"' for c in columns)).fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 36


def test_world_to_cell_with_many_lines(spark, tmp_path):
    spark.range(240_000).withColumnRenamed("id", "l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    points = "values (0, 30), (1, 30), (1200, 30), (1299, 30), (1300, 30), (600, 29), (601, 800), (602, 1529), (603, 1530), (604, 3199), (null, 60), (605, null)"
    spark.sql(f"select cast(col1 as bigint) o_orderkey, cast(col2 as bigint) o_custkey from ({points})").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.sql(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = c.sql(entry.oracle_sql()["world_to_cell"]).project("o_orderkey, cell_id").fetchall()
    got = entry.queries()["world_to_cell"](spark, str(tmp_path)).select("o_orderkey", "cell_id").collect()
    assert plain(got) == plain(want)
    assert sum(x[1] is None for x in want) == 8
