"""The cellular automaton: one 5-year step, projections over scenarios, evaluation."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import one_hot
from gridloom.grid import Grid
from gridloom.operators import allocate, focal, markov, metrics, mlp, sampling
from gridloom.sources.tables import append_replace, cut

Model = Callable[[DataFrame], DataFrame]

LOG = logging.getLogger("gridloom").info

CLASSES = (1, 2, 3, 4, 5, 6)


def land_use_features(cells: DataFrame, grid: Grid, names: list[str], cat: str = "cat") -> DataFrame:
    """cell_id and those of names that follow from the class map: nbr_k, oh_k, dist_urban, dist_forest_edge."""
    out = cells.select("cell_id", *[c for c in one_hot(F.col(cat), CLASSES)])
    if any(n.startswith("nbr_") for n in names):
        out = out.join(focal.focal_share(cells, grid, value=cat), "cell_id")
    far = lambda d: focal.or_diagonal(F.col(d), grid)
    if "dist_urban" in names:
        out = out.join(focal.distance_to(cells, grid, F.col(cat) == 5).withColumnRenamed("distance", "_d"), "cell_id").withColumn("dist_urban", far("_d")).drop("_d")
    if "dist_forest_edge" in names:
        out = out.join(focal.signed_distance_to(cells, grid, F.col(cat) == 1).withColumnRenamed("distance", "_d"), "cell_id").withColumn("dist_forest_edge", far("_d")).drop("_d")
    return out.select("cell_id", *[n for n in names if n in out.columns])


def simulate_step(
    cells: DataFrame,
    grid: Grid,
    model: Model,
    weights: DataFrame,
    matrix: DataFrame,
    *,
    names: list[str],
    frozen: DataFrame | None = None,
    stored: DataFrame | None = None,
    recompute: bool = False,
    absorbing: tuple[int, ...] = (5, 6),
    iterations: int = 3,
    area: Column | None = None,
) -> DataFrame:
    """(cell_id, cat) after one step. cells: (cell_id, cat), 0 where there is no class; area: which cells may move (all by default).

    Quotas come from the classes at the start. Each iteration scores the movable cells - the land-use features follow the current map
    from the second on - corrects priors by the class of origin and allocates a third, a half, then all of what is left.
    stored: (cell_id, predictors) at the start; frozen goes before it; recompute takes the distances from the current map at once.
    model adds prob to rows with the columns names. Each iteration's state is checkpointed, so plans do not grow.
    """
    cells, weights = cut(cells.select("cell_id", "cat")), cut(weights)
    frozen, stored = (None if x is None else cut(x.select("cell_id", *[n for n in names if n in x.columns])) for x in (frozen, stored))
    inside = (area if area is not None else F.lit(True)) & (F.col("cat") > 0)
    valid = cells.where(inside)
    quotas = cut(markov.quotas(valid, matrix))
    state = valid.where(~F.col("cat").isin(*absorbing)).select("cell_id", F.col("cat").alias("c0"), F.col("cat").alias("cur"), F.lit(False).alias("moved"))
    for i in range(iterations):
        now = cells.join(state.select("cell_id", "cur"), "cell_id", "left").select("cell_id", F.coalesce("cur", "cat").alias("cat"))
        mine = [n for n in names if n.startswith(("nbr_", "oh_")) or (n in ("dist_urban", "dist_forest_edge") and (i or recompute))]
        rows = state.join(land_use_features(now, grid, mine), "cell_id")
        for extra in (frozen, stored):
            if extra is not None:
                have = [n for n in names if n in extra.columns and n not in rows.columns]
                rows = rows.join(extra.select("cell_id", *have), "cell_id", "left") if have else rows
        scored = sampling.correct_priors(model(rows), weights).select("cell_id", "c0", "cur", "moved", "prob")
        after = cut(allocate.allocate(scored, quotas, 1 / (iterations - i)).drop("prob"))
        quotas = cut(allocate.left_over(state, after, quotas))
        state = after
    return cells.join(state.select("cell_id", "cur"), "cell_id", "left").select("cell_id", F.coalesce("cur", "cat").alias("cat"))


def demand(counts: DataFrame, scenario: str, absorbing: tuple[int, ...] = (5, 6)) -> DataFrame:
    """Markov matrix of a demand scenario. trend: all periods; expansion: the decade of the largest agriculture and urban gain; pressure: that of the largest forest loss."""
    if scenario != "trend":
        row = markov.decade_argmax(counts).first()
        start = row["gain_period" if scenario == "expansion" else "loss_period"]
        later = [r["period"] for r in counts.select("period").distinct().orderBy("period").collect()]  # a period per 5 years
        counts = counts.where(F.col("period").isin(start, later[later.index(start) + 1]))
    return markov.markov_matrix(counts, absorbing)


def demand_matrices(counts: DataFrame, scenarios: list[str] | None = None, absorbing: tuple[int, ...] = (5, 6)) -> dict[str, DataFrame]:
    """The matrices of the wanted demand scenarios, or of all."""
    return {s: demand(counts, s, absorbing) for s in ("trend", "expansion", "pressure") if not scenarios or s in scenarios}


def project(
    cells: DataFrame, grid: Grid, model: Model, weights: DataFrame, matrices: dict[str, DataFrame], start_year: int, years: list[int], old: DataFrame | None = None,
    sink: Callable[[str, int, DataFrame], None] | None = None, log: Callable[[str], None] = LOG, **how,
) -> tuple[DataFrame, dict]:
    """(areas, maps): areas (scenario, year, class_k) of the start year and every later one, and the maps by (scenario, year).

    Each step starts from the last one's map; rows of the scenarios run here replace those in old. sink gets each map as it is made.
    """
    maps = {}
    for scenario, matrix in matrices.items():
        now = maps[scenario, start_year] = cut(cells.select("cell_id", "cat"))
        for year in years:
            log(f"{scenario}: to {year}")
            now = maps[scenario, year] = cut(simulate_step(now, grid, model, weights, matrix, recompute=True, **how))
            if sink:
                sink(scenario, year, now)
    all_maps = None
    for (scenario, year), m in maps.items():
        one = m.select(F.lit(scenario).alias("scenario"), F.lit(year).alias("year"), "cell_id", "cat")
        all_maps = one if all_maps is None else all_maps.union(one)
    areas = markov.area_by_class(all_maps, grid.cell_ha)
    return (areas if old is None else append_replace(old, areas)), maps


def retrain(samples: DataFrame, counts: DataFrame, pair: DataFrame, features: DataFrame, blocks: DataFrame, scales: DataFrame, names: list[str], grid: Grid, *, block: int, n_each: int, seed: int = 42, **how) -> tuple[mlp.Network, DataFrame, DataFrame]:
    """(network, weights, all samples): the final network from all pairs.

    The latest pair (cell_id, c0, c1) is sampled with seed + 1, gets its blocks' splits, and joins the earlier samples (c0, c1, split, cell_id, names); weights pool
    both pairs' populations and samples. features: (cell_id, names) of the latest pair; counts: (c0, c1, n, taken) of the earlier pairs.
    """
    valid = pair.where("c0 > 0 and c1 > 0")
    new = sampling.stratified_sample(valid, n_each, seed + 1)
    both = counts.select("c0", "c1", "n", "taken").union(sampling.transition_counts(valid).join(sampling.transition_counts(new).withColumnRenamed("n", "taken"), ["c0", "c1"]).select("c0", "c1", "n", "taken"))
    both = both.groupBy("c0", "c1").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"))
    weights = sampling.prior_weights(both.select("c0", "c1", "n"), both.select("c0", "c1", F.col("taken").alias("n")))
    new = sampling.with_split(new.join(features.select("cell_id", *names), "cell_id").withColumn("block", grid.block("cell_id", block)), blocks)
    columns = ["cell_id", "c0", "c1", "split", *names]
    every = cut(samples.select(*columns).union(new.select(*columns)))
    return mlp.train(sampling.standardize(every, scales, names), names, **how), weights, every


def validate(before: DataFrame, reference: DataFrame, simulated: dict[str, DataFrame]) -> DataFrame:
    """evaluate() of each simulated map and of persistence, named by column label; cells without a class in any of the three maps do not count."""
    base = before.select("cell_id", F.col("cat").alias("t0")).join(reference.select("cell_id", F.col("cat").alias("ref")), "cell_id").where("t0 > 0 and ref > 0")
    out = None
    for label, sim in {"persistence": before, **simulated}.items():
        rows = base.join(sim.select("cell_id", F.col("cat").alias("sim")), "cell_id").where("sim > 0")
        one = metrics.evaluate(rows, "t0", "ref", "sim").withColumn("label", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out
