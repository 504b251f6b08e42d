"""Quota-driven allocation of cells to target classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import class_map
from gridloom.operators.ranks import grouped_rank
from gridloom.sources.tables import cut

#: Length of the arrays of probabilities.
CLASSES = 6


def target_order(quotas: DataFrame) -> DataFrame:
    """(c0, c1, q, k): an origin's targets by ascending quota, ties by class; the diagonal has none."""
    w = Window.partitionBy("c0").orderBy("q", "c1")
    return quotas.where("c0 <> c1").withColumn("k", F.row_number().over(w))


def cutoffs(rows: DataFrame, take: dict[int, int], bins: int = 4096, few: int = 20_000) -> dict[int, tuple[float, int] | None]:
    """For each c0 of take the (p, cell_id) of the last of its `take` rows by descending p, then cell_id; None where all rows fit.

    rows: (c0, p, cell_id), p in 0..1. Histograms narrow the place down until at most `few` rows of a class are left, which come to the driver; where
    more agree in p, ranges number them.
    """
    found, open_ = {}, {k: (0.0, 1.0 + 1e-9, 0) for k, n in take.items() if n}
    while open_:
        low, wide = (class_map(F.col("c0"), {k: f(v) for k, v in open_.items()}, None) for f in (lambda v: v[0], lambda v: (v[1] - v[0]) / bins))
        at = F.when(F.col("c0").isin(*open_), F.floor((F.col("p") - low) / wide))
        counts: dict[int, dict[int, int]] = {k: {} for k in open_}
        for r in rows.select("c0", at.alias("at")).where(F.col("at").between(0, bins - 1)).groupBy("c0", "at").count().collect():  # bins by class at most
            counts[r["c0"]][r["at"]] = r["count"]
        border = {}
        for k, (start, end, above) in open_.items():
            for b in sorted(counts[k], reverse=True):
                if above + counts[k][b] >= take[k]:
                    border[k] = (b, start + b * (end - start) / bins, start + (b + 1) * (end - start) / bins, above, counts[k][b])
                    break
                above += counts[k][b]
            else:
                found[k] = None
        small = {k: v for k, v in border.items() if v[4] <= few}
        if small:
            mine = class_map(F.col("c0"), {k: float(v[0]) for k, v in small.items()}, None)
            got: dict[int, list] = {k: [] for k in small}
            for r in rows.select("c0", "p", "cell_id", at.cast("double").alias("at")).where(F.col("at") == mine).collect():
                got[r["c0"]].append((-r["p"], r["cell_id"]))
            for k, v in small.items():
                p, cell = sorted(got[k])[take[k] - v[3] - 1]
                found[k] = (-p, cell)
        large = {k: v for k, v in border.items() if k not in small}
        flat = {k: v for k, v in large.items() if v[2] - v[1] < 1e-12}
        for k, v in flat.items():
            mine = rows.where((F.col("c0") == k) & (F.floor((F.col("p") - open_[k][0]) / ((open_[k][1] - open_[k][0]) / bins)) == v[0]))
            r = grouped_rank(mine, "c0", [F.desc("p"), F.col("cell_id")], "_rank").where(F.col("_rank") == take[k] - v[3]).first()
            found[k] = (r["p"], r["cell_id"])
        open_ = {k: v[1:4] for k, v in large.items() if k not in flat}
    return found


def local_cutoffs(cell: np.ndarray, prob: np.ndarray, order: list[tuple[int, int]]) -> list[tuple[int, tuple[float, int] | None]]:
    """(c1, cutoff) of an origin's targets (c1, take) in turn, over all its cells."""
    out, free = [], np.ones(len(cell), bool)
    for c1, take in order:
        p = prob[:, c1 - 1]
        best = np.lexsort((cell, -p))
        best = best[free[best]][:take]
        out.append((c1, (float(p[best[-1]]), int(cell[best[-1]])) if len(best) == take else None))
        free[best] = False
    return out


def allocate(cells: DataFrame, quotas: DataFrame, share: float, few: int = 20_000) -> DataFrame:
    """cells after one iteration. cells: (cell_id, c0, cur, moved, prob); quotas: (c0, c1, q).

    Each target takes the unmoved cells of its origin with the highest probability, ties by cell_id: ceil(share * q) of them, at most q,
    or all that are left. A cell has one origin, so origins do not meet: round k serves the k-th target of all origins at once. A round finds
    the place where each target's taking ends; which cells are taken is then a condition on the cell alone, without a join. Origins of at most
    `few` cells have their places found on the driver, all rounds at once, the others by cutoffs().
    """
    order = target_order(quotas).withColumn("take", F.least(F.ceil(F.col("q") * share), F.col("q"))).where("take > 0").orderBy("c0", "k").collect()  # classes squared rows
    cells, target = cut(cells), F.lit(None).cast("int")  # all rounds read it
    value = lambda c1: F.coalesce(F.get("prob", F.lit(c1 - 1)), F.lit(0.0))

    def taken(c0: int, c1: int, end: tuple[float, int] | None) -> Column:
        within = F.lit(True) if end is None else (value(c1) > end[0]) | ((value(c1) == end[0]) & (F.col("cell_id") <= end[1]))
        return F.when((F.col("c0") == c0) & within, c1)

    sizes = {r["c0"]: r["count"] for r in cells.where(~F.col("moved")).groupBy("c0").count().collect()}
    turns: dict[int, list[tuple[int, int]]] = {}
    for r in order:
        if r["c0"] in sizes:
            turns.setdefault(r["c0"], []).append((r["c1"], r["take"]))
    small = [c0 for c0 in turns if sizes[c0] <= few]
    if small:
        probs = F.array(*[value(k) for k in range(1, CLASSES + 1)]).alias("prob")
        near = cells.where(~F.col("moved") & F.col("c0").isin(*small)).select("c0", "cell_id", probs).toPandas()
        for c0, mine in near.groupby("c0"):
            for c1, end in local_cutoffs(mine["cell_id"].to_numpy(), np.stack(mine["prob"].to_numpy()), turns[c0]):
                target = F.coalesce(target, taken(c0, c1, end))
    for k in range(max((len(t) for c0, t in turns.items() if c0 not in small), default=0)):
        mine = {c0: t[k] for c0, t in turns.items() if c0 not in small and len(t) > k}
        p = F.get("prob", class_map(F.col("c0"), {c0: c1 - 1 for c0, (c1, _) in mine.items()}, None).cast("int"))
        left = cells.where(~F.col("moved") & target.isNull() & F.col("c0").isin(*mine))
        ends = cutoffs(left.select("c0", F.coalesce(p, F.lit(0.0)).alias("p"), "cell_id"), {c0: take for c0, (_, take) in mine.items()}, few=few)
        for c0, (c1, _) in mine.items():
            target = F.coalesce(target, taken(c0, c1, ends.get(c0)))
    rest = [c for c in cells.columns if c not in ("cur", "moved")]
    new = cells.withColumn("_t", F.when(~F.col("moved"), target))
    return new.select(*rest, F.coalesce("_t", "cur").alias("cur"), (F.col("moved") | F.col("_t").isNotNull()).alias("moved")).select(*cells.columns)


def left_over(before: DataFrame, after: DataFrame, quotas: DataFrame) -> DataFrame:
    """Quotas less the cells that moved between two states of an iteration."""
    was = before.select("cell_id", F.col("moved").alias("_was"))
    new = after.join(was, "cell_id").where("moved and not _was").groupBy("c0", F.col("cur").alias("c1")).agg(F.count("*").alias("_n"))
    return quotas.join(F.broadcast(new), ["c0", "c1"], "left").select("c0", "c1", (F.col("q") - F.coalesce("_n", F.lit(0))).alias("q"))
