"""Overlay of links and corridors with a priority layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import binned


def _pct(c: Column) -> Column:
    return 100 * F.avg(c.cast("double"))


def link_overlay(paths: DataFrame, corridor: DataFrame, priority: DataFrame, groups: dict[str, DataFrame] | None = None, links: DataFrame | None = None) -> DataFrame:
    """Per link: mean priority and percentages along the path and the corridor, bins 0, 1, 2, 3+, groups, and uncovered (half of the path or more at 1 or less).

    paths, corridor: (uc_a, uc_b, cell_id); priority: (cell_id, v), absent cells count 0; groups: name -> cells; links: their names, length and cost, carried.
    """
    v = F.coalesce(F.col("v"), F.lit(0))
    p = paths.join(priority.select("cell_id", "v"), "cell_id", "left")
    for name, cells in (groups or {}).items():
        p = p.join(cells.select("cell_id", F.lit(1).alias(f"_{name}")).distinct(), "cell_id", "left")
    bins = [_pct(binned(v, 3) == k).alias(f"path_pct_{k}") for k in range(4)]
    of = [_pct(F.col(f"_{name}").isNotNull()).alias(f"path_pct_{name}") for name in groups or {}]
    a = p.groupBy("uc_a", "uc_b").agg(F.avg(v).alias("path_mean"), _pct(v >= 1).alias("path_pct_ge1"), _pct(v <= 1).alias("path_pct_le1"), _pct(v >= 3).alias("path_pct_ge3"), *bins, *of)
    c = corridor.join(priority.select("cell_id", "v"), "cell_id", "left")
    b = c.groupBy("uc_a", "uc_b").agg(F.avg(v).alias("corridor_mean"), _pct(v >= 3).alias("corridor_pct_ge3"))
    out = a.join(b, ["uc_a", "uc_b"], "left").withColumn("uncovered", F.col("path_pct_le1") >= 50)
    carried = [c for c in ("name_a", "name_b", "length_km", "cost") if links is not None and c in links.columns]
    return out if links is None else links.select("uc_a", "uc_b", *carried).join(out, ["uc_a", "uc_b"])


def enrichment_by_zone(corridor: DataFrame, area: DataFrame, priority: DataFrame, cell_ha: float) -> DataFrame:
    """(zone, area_ha, mean_v, pct_ge1, pct_ge3) of the cells in all corridors, in the rest of the area, and in the area."""
    mark = corridor.select("cell_id", F.lit(True).alias("_in")).distinct()
    rows = area.select("cell_id").join(mark, "cell_id", "left").join(priority.select("cell_id", "v"), "cell_id", "left")
    zone = F.explode(F.array(F.when(F.col("_in").isNotNull(), "corridors").otherwise("rest"), F.lit("area"))).alias("zone")
    v = F.coalesce("v", F.lit(0))
    out = rows.select(zone, v.alias("v")).groupBy("zone")
    return out.agg((F.count("*") * F.lit(cell_ha)).alias("area_ha"), F.avg("v").alias("mean_v"), _pct(F.col("v") >= 1).alias("pct_ge1"), _pct(F.col("v") >= 3).alias("pct_ge3"))


def enrichment(corridor: DataFrame, area: DataFrame, priority: DataFrame, least: int = 3) -> DataFrame:
    """One row: share of cells with priority of `least` or more in all corridors, in the rest of the area, in the area; ratio of the first two."""
    mark = corridor.select("cell_id", F.lit(True).alias("_in")).distinct()
    rows = area.select("cell_id").join(mark, "cell_id", "left").join(priority.select("cell_id", "v"), "cell_id", "left")
    high, inside = F.coalesce(F.col("v") >= least, F.lit(False)), F.col("_in").isNotNull()
    out = rows.agg(F.sum(inside.cast("long")).alias("corridor_cells"), _pct(F.when(inside, high)).alias("corridor_pct"), _pct(F.when(~inside, high)).alias("rest_pct"), _pct(high).alias("area_pct"))
    return out.withColumn("ratio", F.try_divide("corridor_pct", "rest_pct"))


def loss_gain(area: DataFrame, priority: DataFrame, before: DataFrame, after: DataFrame, cell_ha: float, natural: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Per priority bin 0 to 3: its area, natural area before and after, lost, gained, and net change in percent of the former."""
    rows = area.select("cell_id").join(priority.select("cell_id", "v"), "cell_id", "left")
    rows = rows.join(before.select("cell_id", F.col("cat").alias("_b")), "cell_id", "left").join(after.select("cell_id", F.col("cat").alias("_a")), "cell_id", "left")
    b, a = (F.coalesce(F.col(c).isin(*natural), F.lit(False)) for c in ("_b", "_a"))
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy(binned(F.coalesce("v", F.lit(0)), 3).alias("bin")).agg(F.count("*").alias("all"), n(b).alias("b"), n(a).alias("a"), n(b & ~a).alias("lost"), n(~b & a).alias("gained"))
    net = 100 * (F.col("a") - F.col("b")) / F.greatest(F.col("b"), F.lit(1))
    return out.select("bin", *[(F.col(c) * F.lit(cell_ha)).alias(f"{name}_ha") for c, name in (("all", "area"), ("b", "before"), ("a", "after"), ("lost", "lost"), ("gained", "gained"))], net.alias("net_pct"))
