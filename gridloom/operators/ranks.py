"""Row numbers within large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.sources.tables import cut


def grouped_rank(rows: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their number from 1 within `group` by `order`, however large a group is.

    Rows are dealt out by ranges of (group, order) and kept in the checkpoint folder; a row's number is its number in its range plus
    the rows of its group in earlier ranges, a table of about as many rows as there are ranges.
    """
    parts = cut(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("_group", "_at", before.alias("_before")))
    inside = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    out = parts.withColumn(name, inside).join(sizes, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_at")))
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_group", "_at", "_before")
