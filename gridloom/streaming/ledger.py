"""Resumable yearly processing: a ledger of finished years, and the same contract over a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.tables import exists, write_layer

LEDGER = "year int, n_rows bigint"


def finished(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(ledger) if exists(spark, ledger) else spark.createDataFrame([], LEDGER)


def missing_years(spark: SparkSession, years: list[int], ledger: str) -> list[int]:
    want = spark.createDataFrame([(y,) for y in years], "year int")
    return [r["year"] for r in want.join(finished(spark, ledger), "year", "left_anti").orderBy("year").collect()]


def process_years(spark: SparkSession, years: list[int], step: Callable[[int], DataFrame], out: str, ledger: str) -> list[int]:
    """Writes step(year) as partition `year` of out for each unfinished year, then notes it. Returns the years it did.

    A year that stopped between both writes is done again: the partition overwrite makes that harmless.
    """
    done = missing_years(spark, years, ledger)
    for year in done:
        write_layer(step(year).withColumn("year", F.lit(year)), out)
        n = spark.read.parquet(out).where(F.col("year") == year).count()
        spark.createDataFrame([(year, n)], LEDGER).coalesce(1).write.mode("append").json(ledger)
    return done


def follow(spark: SparkSession, drops: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Takes in whatever files arrived in `drops` since the last call, and stops. step gets each batch of raw yearly rows."""

    def batch(df: DataFrame, _: int) -> None:
        write_layer(step(df), out)

    query = spark.readStream.schema(schema).parquet(drops).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
