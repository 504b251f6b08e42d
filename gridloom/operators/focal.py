"""Focal operators: neighbourhood shares, slope, distances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.grid import Grid


def padded(cells: DataFrame, grid: Grid, margin: int, axis: str) -> DataFrame:
    """Adds copies of the edge cells along one axis, so that windows see the edge replicated. Only edge cells are copied."""
    last = (grid.width if axis == "_c" else grid.height) - 1
    copies = F.when(F.col(axis) == 0, F.sequence(F.lit(-margin), F.lit(0))).when(F.col(axis) == last, F.sequence(F.lit(last), F.lit(last + margin)))
    if last == 0:
        copies = F.sequence(F.lit(-margin), F.lit(margin))
    return cells.withColumn(axis, F.explode(F.coalesce(copies, F.array(axis))))


def focal_share(cells: DataFrame, grid: Grid, classes: tuple[int, ...] = (1, 2, 3, 4, 5, 6), size: int = 5, value: str = "cat") -> DataFrame:
    """cell_id and nbr_k for each class: its share in the size x size window, edges replicated, over size squared cells always.

    Two one-dimensional passes; all classes share both shuffles. A cell that is missing counts as no class.
    """
    half = size // 2
    rows = grid.cells(cells.sparkSession).join(cells.select("cell_id", value), "cell_id", "left")
    rows = rows.select("cell_id", grid.row().alias("_r"), grid.column().alias("_c"), *[F.coalesce((F.col(value) == k).cast("int"), F.lit(0)).alias(f"nbr_{k}") for k in classes])
    for axis, by in (("_c", "_r"), ("_r", "_c")):
        w = Window.partitionBy(by).orderBy(axis).rangeBetween(-half, half)
        inner = F.col(axis).between(0, (grid.width if axis == "_c" else grid.height) - 1)
        rows = padded(rows, grid, half, axis)
        rows = rows.withColumns({f"nbr_{k}": F.sum(f"nbr_{k}").over(w) for k in classes}).where(inner)
    return rows.select(grid.cell(F.col("_r"), F.col("_c")).alias("cell_id"), *[(F.col(f"nbr_{k}") / (size * size)).alias(f"nbr_{k}") for k in classes])


def slope_horn(cells: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    """(cell_id, slope) in degrees by Horn's 3 x 3 weights, edges replicated; null where the window holds a null or missing cell."""
    rows = grid.cells(cells.sparkSession).join(cells.select("cell_id", F.col(value).cast("double").alias("v")), "cell_id", "left")
    rows = padded(rows.select(grid.row().alias("_r"), grid.column().alias("_c"), "v"), grid, 1, "_c")
    w = Window.partitionBy("_r").orderBy("_c")
    west, east = F.lag("v").over(w), F.lead("v").over(w)
    ok = west.isNotNull() & east.isNotNull() & F.col("v").isNotNull()
    rows = rows.select("_r", "_c", F.when(ok, east - west).alias("dx"), F.when(ok, west + 2 * F.col("v") + east).alias("sm"))
    rows = padded(rows.where(F.col("_c").between(0, grid.width - 1)), grid, 1, "_r")
    w = Window.partitionBy("_c").orderBy("_r")
    north, south = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    dx = (north("dx") + 2 * F.col("dx") + south("dx")) / (8 * grid.res)
    dy = F.when(F.col("sm").isNotNull(), (south("sm") - north("sm")) / (8 * grid.res))
    rows = rows.withColumn("slope", F.degrees(F.atan(F.hypot(dx, dy)))).where(F.col("_r").between(0, grid.height - 1))
    return rows.select(grid.cell(F.col("_r"), F.col("_c")).alias("cell_id"), "slope")


def slope_agreement(a: Column, b_percent: Column) -> list[Column]:
    """Aggregates that compare a slope in degrees with one in percent: n, r, bias, rmse and both medians."""
    b = F.degrees(F.atan(b_percent / 100))
    both = a.isNotNull() & b.isNotNull()
    d = F.when(both, a - b)
    return [F.count(d).alias("n"), F.corr(F.when(both, a), F.when(both, b)).alias("r"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.median(F.when(both, a)).alias("median_a"), F.median(F.when(both, b)).alias("median_b")]


def envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (p - q)^2 + f[q] for each p, by the lower envelope of the parabolas, in linear time."""
    n, at = len(f), np.flatnonzero(np.isfinite(f))
    if not len(at):
        return np.full(n, np.inf)
    v, z = [int(at[0])], [-math.inf]
    for q in map(int, at[1:]):
        while True:
            s = ((f[q] + q * q) - (f[v[-1]] + v[-1] ** 2)) / (2 * (q - v[-1]))
            if s > z[-1]:
                break
            v.pop()
            z.pop()
        v.append(q)
        z.append(s)
    k = np.searchsorted(np.array(z), np.arange(n), "left") - 1
    best = np.array(v)[np.maximum(k, 0)]
    return (np.arange(n) - best) ** 2 + f[best]


def distance_to(cells: DataFrame, grid: Grid, mask: Column) -> DataFrame:
    """(cell_id, distance) to the nearest cell where mask holds, exact; null everywhere if there is none.

    Pass 1 runs down the columns (windows); pass 2 takes each row's lower envelope, so a task holds rows of one grid width.
    """
    rows = grid.cells(cells.sparkSession).join(cells.select("cell_id", mask.alias("_m")), "cell_id", "left")
    rows = rows.select(grid.row().alias("r"), grid.column().alias("c"), F.when(F.col("_m"), grid.row()).alias("hit"))
    up, down = Window.partitionBy("c").orderBy("r"), Window.partitionBy("c").orderBy("r").rowsBetween(0, Window.unboundedFollowing)
    a = F.col("r") - F.last("hit", ignorenulls=True).over(up)
    b = F.first("hit", ignorenulls=True).over(down) - F.col("r")
    rows = rows.select("r", "c", F.least(a, b).cast("double").alias("g"))
    width, res = grid.width, grid.res

    def across(x: pd.DataFrame) -> pd.DataFrame:
        g = np.full(width, np.inf)
        g[x["c"]] = x["g"].fillna(np.inf) ** 2
        d = np.sqrt(envelope(g)) * res
        cell = int(x["r"].iloc[0]) * width + np.arange(width, dtype="int64")
        return pd.DataFrame({"cell_id": cell, "distance": pd.Series(np.where(np.isfinite(d), d, np.nan)).astype(object).where(np.isfinite(d), None)})

    return rows.groupBy("r").applyInPandas(across, "cell_id long, distance double")


def signed_distance_to(cells: DataFrame, grid: Grid, mask: Column) -> DataFrame:
    """(cell_id, distance): positive outside of the mask, negative inside; null everywhere if the mask is empty or full."""
    full = grid.cells(cells.sparkSession).join(cells.select("cell_id", mask.alias("_m")), "cell_id", "left").select("cell_id", F.coalesce("_m", F.lit(False)).alias("_m"))
    out = distance_to(full, grid, F.col("_m")).withColumnRenamed("distance", "_out")
    inn = distance_to(full, grid, ~F.col("_m")).withColumnRenamed("distance", "_in")
    both = full.join(out, "cell_id").join(inn, "cell_id")
    known = F.col("_out").isNotNull() & F.col("_in").isNotNull()
    return both.select("cell_id", F.when(known, F.when(F.col("_m"), -F.col("_in")).otherwise(F.col("_out"))).alias("distance"))


def or_diagonal(distance: Column, grid: Grid) -> Column:
    """The grid's diagonal where a mask was empty."""
    return F.coalesce(distance, F.lit(grid.diagonal))


def union_mask(*masks: DataFrame) -> DataFrame:
    """Cells of any mask."""
    out = masks[0].select("cell_id")
    for m in masks[1:]:
        out = out.union(m.select("cell_id"))
    return out.distinct()


def resample_bilinear(source: DataFrame, source_grid: Grid, grid: Grid, value: str = "v") -> DataFrame:
    """(cell_id, v) of grid from a layer on another grid of the same reference system: four nearest centres, weights renormalized over those known."""
    at = grid.cells(source.sparkSession).select("cell_id", ((grid.x(grid.column()) - source_grid.xmin) / source_grid.res - 0.5).alias("fx"), ((F.lit(source_grid.ymax) - grid.y(grid.row())) / source_grid.res - 0.5).alias("fy"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = at.select("*", corner.alias("k"))
    c, r = F.floor("fx") + F.col("k.i"), F.floor("fy") + F.col("k.j")
    w = (1 - F.abs(F.col("fx") - c)) * (1 - F.abs(F.col("fy") - r))
    inside = (c >= 0) & (c < source_grid.width) & (r >= 0) & (r < source_grid.height)
    at = at.select("cell_id", F.when(inside, source_grid.cell(r, c)).alias("_from"), w.alias("_w")).where("_w > 0")
    joined = at.join(source.select(F.col("cell_id").alias("_from"), F.col(value).alias("_v")), "_from", "left")
    known = F.when(F.col("_v").isNotNull(), F.col("_w"))
    return joined.groupBy("cell_id").agg(F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum(known)).alias("v"))
