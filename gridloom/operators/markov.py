"""Markov demand: transition matrices, quotas, demand scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def markov_matrix(counts: DataFrame, absorbing: tuple[int, ...] = (5, 6)) -> DataFrame:
    """(c0, c1, p): counts pooled over periods, normalized by row (an empty row stays 0); absorbing rows are identity."""
    pooled = counts.groupBy("c0", "c1").agg(F.sum("n").alias("n"))
    total = F.greatest(F.sum("n").over(Window.partitionBy("c0")), F.lit(1))
    stay = (F.col("c0") == F.col("c1")).cast("double")
    return pooled.select("c0", "c1", F.when(F.col("c0").isin(*absorbing), stay).otherwise(F.col("n") / total).alias("p"))


def quotas(classes: DataFrame, matrix: DataFrame) -> DataFrame:
    """(c0, c1, q): cells of class c0 (column cat) that should move, rounded half to even; the diagonal is 0."""
    n = classes.groupBy(F.col("cat").alias("c0")).agg(F.count("*").alias("n"))
    q = F.when(F.col("c0") == F.col("c1"), 0).otherwise(F.rint(F.coalesce("n", F.lit(0)) * F.col("p")))
    return matrix.join(F.broadcast(n), "c0", "left").select("c0", "c1", q.cast("long").alias("q"))


def decades(periods: list[str]) -> list[tuple[str, str]]:
    """Consecutive pairs of 5-year periods."""
    return list(zip(periods, periods[1:]))


def decade_argmax(counts: DataFrame, gain: tuple[int, ...] = (4, 5), loss: int = 1) -> DataFrame:
    """The decade (pair of consecutive periods) of the largest net gain of classes `gain` and of the largest net loss of class `loss`.

    A class has at a decade's start the row total of its first period, at its end the column total of its second.
    counts: (period, c0, c1, n). One row: gain_period, gain, loss_period, loss - each decade named by its first period; ties go to the first.
    """
    held = lambda c, of: F.sum(F.when(F.col(c).isin(*of), F.col("n")).otherwise(0))
    per = counts.groupBy("period").agg(held("c0", gain).alias("g0"), held("c1", gain).alias("g1"), held("c0", (loss,)).alias("l0"), held("c1", (loss,)).alias("l1"))
    later = lambda c: F.lead(c).over(Window.orderBy("period"))  # noqa: E731  a row per five years
    pair = per.select("period", (later("g1") - F.col("g0")).alias("g"), (F.col("l0") - later("l1")).alias("l")).where("g is not null")
    first = lambda m: F.max_by("period", F.struct(F.col(m), -F.unix_date(F.make_date(F.col("period"), F.lit(1), F.lit(1)))))
    return pair.agg(first("g").alias("gain_period"), F.max("g").alias("gain"), first("l").alias("loss_period"), F.max("l").alias("loss"))


def area_by_class(maps: DataFrame, cell_ha: float, classes: int = 6) -> DataFrame:
    """(scenario, year, class_1 ..): hectares of each class."""
    named = maps.where("cat > 0").withColumn("_c", F.concat(F.lit("class_"), F.col("cat").cast("string")))
    out = named.groupBy("scenario", "year").pivot("_c", [f"class_{k}" for k in range(1, classes + 1)]).agg(F.count(F.lit(1)) * F.lit(cell_ha))
    return out.na.fill(0.0)
