"""Map accuracy: confusion, kappa, disagreement, figure of merit, classifier reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, ref: str, sim: str, classes: int = 6) -> DataFrame:
    """(ref, sim, n) of all class pairs, those that do not occur with 0. Rows with a class outside 1..classes do not count."""
    spark = pairs.sparkSession
    dense = spark.range(classes * classes).select((F.floor(F.col("id") / classes) + 1).cast("int").alias("ref"), (F.col("id") % classes + 1).cast("int").alias("sim"))
    n = pairs.groupBy(F.col(ref).cast("int").alias("ref"), F.col(sim).cast("int").alias("sim")).agg(F.count("*").alias("n"))
    return dense.join(F.broadcast(n.where(F.col("ref").between(1, classes) & F.col("sim").between(1, classes))), ["ref", "sim"], "left").select("ref", "sim", F.coalesce("n", F.lit(0)).alias("n"))


def margins(cm: DataFrame) -> DataFrame:
    """(k, hit, row, col, total) of each class of a confusion (ref, sim, n); a confusion is classes squared rows."""
    ends = F.explode(F.array(F.struct(F.col("ref").alias("k"), F.col("n").alias("row"), F.lit(0).cast("long").alias("col")), F.struct(F.col("sim").alias("k"), F.lit(0).cast("long").alias("row"), F.col("n").alias("col"))))
    hit = F.when(F.col("ref") == F.col("sim"), F.col("n")).otherwise(0)
    out = cm.select(ends.alias("e"), hit.alias("hit")).groupBy("e.k").agg((F.sum("hit") / 2).cast("long").alias("hit"), F.sum("e.row").alias("row"), F.sum("e.col").alias("col"))
    total = cm.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total))  # one row


def overall(cm: DataFrame) -> DataFrame:
    """(total, accuracy, kappa, quantity, allocation) of a confusion. kappa is null where chance agreement is 1."""
    m = margins(cm)
    p = lambda c: F.col(c) / F.col("total")
    sums = m.agg(
        F.max("total").alias("total"),
        (F.sum("hit") / F.max("total")).alias("accuracy"),
        F.sum(p("row") * p("col")).alias("chance"),
        (F.sum(F.abs(p("row") - p("col"))) / 2).alias("quantity"),
        F.sum(F.least(p("row") - p("hit"), p("col") - p("hit"))).alias("allocation"),
    )
    kappa = F.try_divide(F.col("accuracy") - F.col("chance"), F.when(F.col("chance") < 1, 1 - F.col("chance")))
    return sums.select("total", "accuracy", kappa.alias("kappa"), "quantity", "allocation")


def kappa_by_class(cm: DataFrame) -> DataFrame:
    """(k, kappa) conditional on the reference class; null where the class or its complement is empty."""
    p = lambda c: F.col(c) / F.col("total")
    return margins(cm).select("k", F.try_divide(F.try_divide(p("hit"), p("row")) - p("col"), 1 - p("col")).alias("kappa"))


def merit(cells: DataFrame, before: str, ref: str, sim: str) -> DataFrame:
    """One row: omission, hit, wrong_class, false_alarm, merit, producer, user - of changes since `before`."""
    moved, said = F.col(ref) != F.col(before), F.col(sim) != F.col(before)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n = cells.agg(
        count(moved & ~said).alias("omission"),
        count(moved & (F.col(sim) == F.col(ref))).alias("hit"),
        count(moved & said & (F.col(sim) != F.col(ref))).alias("wrong_class"),
        count(~moved & said).alias("false_alarm"),
    )
    a, b, c, d = (F.col(k) for k in n.columns)
    return n.withColumns({"merit": F.try_divide(b, a + b + c + d), "producer": F.try_divide(b, a + b + c), "user": F.try_divide(b, b + c + d)})


def report(cm: DataFrame) -> DataFrame:
    """(k, precision, recall, f1, support) of each class."""
    m = margins(cm)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = m.select("k", zero(F.try_divide(F.col("hit"), F.col("col"))).alias("precision"), zero(F.try_divide(F.col("hit"), F.col("row"))).alias("recall"), F.col("row").alias("support"))
    return out.select("k", "precision", "recall", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).alias("f1"), "support")


def report_summary(cm: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support): accuracy (in all three columns), the macro mean, and the mean weighted by support."""
    per, total = report(cm), F.sum("support")
    names = ("precision", "recall", "f1")
    hit = cm.agg(F.try_divide(F.sum(F.when(F.col("ref") == F.col("sim"), F.col("n"))), F.sum("n")).alias("a"), F.sum("n").alias("support"))
    whole = hit.select(F.lit("accuracy").alias("label"), *[F.col("a").alias(c) for c in names], "support")
    macro = per.agg(*[F.avg(c).alias(c) for c in names], total.alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = per.agg(*[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in names], total.alias("support"))
    return whole.union(macro).union(weighted.select(F.lit("weighted avg").alias("label"), *names, "support"))


def log_loss(true_share: Column, floor: float = 1e-15) -> Column:
    """Mean of -ln of the probability given to the true class."""
    return F.avg(-F.log(F.greatest(true_share, F.lit(floor))))


def changed_share(cells: DataFrame, before: str, *others: str) -> DataFrame:
    """Percentage of cells that each column changes."""
    return cells.agg(*[(F.avg((F.col(o) != F.col(before)).cast("double")) * 100).alias(f"changed_{o}") for o in others])


def best_by(table: DataFrame, key: str, measure: str) -> DataFrame:
    """The key of the greatest measure; ties go to the smallest key."""
    return table.orderBy(F.desc(measure), key).limit(1).select(key, measure)


def evaluate(cells: DataFrame, before: str, ref: str, sim: str, classes: int = 6) -> DataFrame:
    """overall() and merit() of one simulated map beside each other, with the shares of changed cells."""
    one = overall(confusion(cells, ref, sim, classes)).crossJoin(merit(cells, before, ref, sim))
    return one.crossJoin(changed_share(cells, before, sim, ref))  # one row each
