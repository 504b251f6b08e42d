"""Transitions, strata, spatial blocks, scalers and prior weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A multiplicative order in plain arithmetic, which any SQL engine repeats.
MULTIPLIER, INCREMENT, PRIME = 1_103_515_245, 12_345, 2_147_483_647
#: Parts of the order that are numbered apart.
SHARDS = 1024


def turn(key: Column, seed: int = 42) -> Column:
    """Pseudo-random order of integer keys below 2^31; repeatable anywhere."""
    return (key.cast("long") % PRIME * MULTIPLIER + INCREMENT + seed * 7919) % PRIME


def transition_counts(pairs: DataFrame, c0: str = "c0", c1: str = "c1", classes: int = 6) -> DataFrame:
    """(c0, c1, n) of all class pairs."""
    from gridloom.operators.metrics import confusion

    return confusion(pairs, c0, c1, classes).toDF("c0", "c1", "n")


def stratified_sample(pairs: DataFrame, n_each: int, seed: int = 42) -> DataFrame:
    """Up to n_each rows of each (c0, c1), without replacement, in the order of turn(cell_id).

    Spark keeps n_each rows of a stratum per task before it shuffles (window group limit), so a large stratum is no hot task.
    """
    w = Window.partitionBy("c0", "c1").orderBy(turn(F.col("cell_id"), seed), "cell_id")
    return pairs.where("c0 > 0 and c1 > 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n_each).drop("_n")


def split_blocks(blocks: DataFrame, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(block, split): distinct blocks in the order of turn(), cut at the half-even rounded shares."""
    one = blocks.select("block").distinct().withColumn("_t", turn(F.col("block"), seed)).withColumn("_shard", F.floor(F.col("_t") / (PRIME // SHARDS + 1)))
    sizes = one.groupBy("_shard").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_shard")  # SHARDS rows at most
    sizes = sizes.select("_shard", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_shard").orderBy("_t", "block")) + F.col("_before")
    nt, nv = (F.rint(F.col("_all") * s) for s in (train, val))
    split = F.when(F.col("_rank") <= nt, "train").when(F.col("_rank") <= nt + nv, "val").otherwise("test")
    return one.join(F.broadcast(sizes), "_shard").withColumn("_rank", rank).select("block", split.alias("split"))


def with_split(samples: DataFrame, split: DataFrame) -> DataFrame:
    return samples.join(split, "block")


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): blocks or samples by their label."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def null_shares(samples: DataFrame, names: list[str]) -> DataFrame:
    """(name, null_pct) of each predictor, in one pass."""
    shares = samples.agg(*[(F.avg((F.col(n).isNull() | F.isnan(F.col(n).cast("double"))).cast("double")) * 100).alias(n) for n in names])
    return shares.unpivot([], names, "name", "null_pct")


def scaler(samples: DataFrame, names: list[str], split: str | None = "train", floor: float = 1e-6) -> DataFrame:
    """(name, mean, std, median) over the train rows; population std, nulls skipped."""
    rows = samples.where(F.col("split") == split) if split else samples
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")).select("x.*")
    return long.groupBy("name").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(floor)).alias("std"), F.median("v").alias("median"))


def standardize(samples: DataFrame, scales: DataFrame, names: list[str]) -> DataFrame:
    """names imputed by the median and standardized. The scaler's one row per name becomes one row of literals."""
    of = {r["name"]: r for r in scales.collect()}  # as many rows as there are predictors
    return samples.withColumns({n: (F.coalesce(F.col(n).cast("double"), F.lit(of[n]["median"])) - of[n]["mean"]) / of[n]["std"] for n in names})


def prior_weights(population: DataFrame, sample: DataFrame) -> DataFrame:
    """(c0, c1, w): population by sample count, 0 without samples."""
    s = sample.withColumnRenamed("n", "_s")
    w = F.coalesce(F.try_divide(F.col("n"), F.col("_s")), F.lit(0.0))
    return population.join(s, ["c0", "c1"], "left").select("c0", "c1", w.alias("w"))


def weight_rows(weights: DataFrame, classes: int = 6) -> DataFrame:
    """(c0, w array by c1): one row per origin class."""
    by = F.sort_array(F.collect_list(F.struct("c1", "w")))
    return weights.where(F.col("c1").between(1, classes)).groupBy("c0").agg(F.transform(by, lambda x: x["w"]).alias("w"))


def correct_priors(scored: DataFrame, weights: DataFrame, prob: str = "prob", origin: str = "c0") -> DataFrame:
    """prob reweighted by its origin's weights and normalized; an all-zero row stays zero."""
    rows = weight_rows(weights).withColumnRenamed("c0", "_c0")
    joined = scored.join(F.broadcast(rows), F.col(origin) == F.col("_c0"), "left").drop("_c0")
    q = F.zip_with(prob, "w", lambda p, w: p * w)
    joined = joined.withColumn("_q", F.coalesce(q, F.col(prob)))
    total = F.aggregate("_q", F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn(prob, F.transform("_q", lambda x: x / F.when(total > 0, total).otherwise(1.0))).drop("_q", "w")


def every_nth(cells: DataFrame, n: int, order: str = "cell_id") -> DataFrame:
    """Every n-th row by order, from the first; dense ranges of cells are numbered in their own tasks."""
    shard = F.floor(F.col(order) / 65_536)
    sizes = cells.groupBy(shard.alias("_shard")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_shard", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_shard").orderBy(order)) - 1
    rows = cells.withColumn("_shard", shard).withColumn("_rank", rank).join(sizes, "_shard")
    return rows.where((F.col("_rank") + F.col("_before")) % n == 0).drop("_shard", "_rank", "_before")
