"""The registered corpus queries against their SQL, and the shape of those without."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries as llm

SF = "/root/testdata/sf0.001"


def comparable(rows, columns):
    order = sorted(columns)
    return sorted((tuple("" if r[c] is None else f"{r[c]:.9g}" if isinstance(r[c], float) else str(r[c]) for c in order) for r in rows))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = llm.queries()[name](spark, SF)
    want = db.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert comparable([r.asDict() for r in found.collect()], columns) == comparable([dict(zip(columns, r)) for r in want.fetchall()], columns)


def test_packing_query_has_a_slot_for_every_document(spark):
    rows = llm.op10_packing(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count() == rows.select("batch", "slot").distinct().count()
    assert rows.where("padding < 0 or padding <> bucket - n_tokens").count() == 0
    full = rows.groupBy("batch").agg(F.max("bucket").alias("top"), F.count("*").alias("n"))
    assert full.where("n * top > 32768 and n > 1").count() == 0
