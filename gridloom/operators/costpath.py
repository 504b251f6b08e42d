"""Least-cost networks: resistance, accumulated cost, links, corridors, rupture."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import class_map, joined_numbers, percent_change
from gridloom.grid import Grid
from gridloom.sources.tables import cut

# The eight moves and their lengths in cells.
MOVES = [(-1, -1, math.sqrt(2)), (-1, 0, 1.0), (-1, 1, math.sqrt(2)), (0, -1, 1.0), (0, 1, 1.0), (1, -1, math.sqrt(2)), (1, 0, 1.0), (1, 1, math.sqrt(2))]


def resistance(cat: Column, table: Mapping[int, float], unmapped: float = 100) -> Column:
    return class_map(cat, {k: float(v) for k, v in table.items()}, float(unmapped))


def node_areas(cells: DataFrame, owners: DataFrame, cell_ha: float) -> DataFrame:
    """(uc_id, forest_ha) of every owner: its cells of class 1. cells: (cell_id, cat); owners: (cell_id, uc_id)."""
    met = owners.join(cells, "cell_id", "left")
    return met.groupBy("uc_id").agg((F.sum(F.coalesce((F.col("cat") == 1).cast("long"), F.lit(0))) * F.lit(cell_ha)).alias("forest_ha"))


def nodes(cells: DataFrame, owners: DataFrame, cell_ha: float, min_ha: float) -> DataFrame:
    """(cell_id, uc_id) of class-1 cells in areas with min_ha of them at least."""
    large = node_areas(cells, owners, cell_ha).where(F.col("forest_ha") >= min_ha).select("uc_id")
    return owners.join(cells.where("cat = 1"), "cell_id", "left_semi").join(large, "uc_id", "left_semi").select("cell_id", "uc_id")


#: Rows and columns of a tile.
TILE = 256


def spread(cost: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Least cost of each cell of a window from cells with a start value. cost: infinite where there is no cell; start: infinite where there is none.

    A move costs the mean of both cells' costs by its length.
    """
    width = cost.shape[1] + 2
    price = np.pad(cost, 1, constant_values=np.inf).ravel().tolist()
    best = np.pad(start, 1, constant_values=np.inf).ravel().tolist()
    moves = [(dr * width + dc, length / 2) for dr, dc, length in MOVES]
    queue = [(d, i) for i, d in enumerate(best) if d < math.inf]
    heapq.heapify(queue)
    while queue:
        d, i = heapq.heappop(queue)
        if d > best[i]:
            continue
        here = price[i]
        for step, half in moves:
            new = d + (here + price[i + step]) * half
            if new < best[i + step]:
                best[i + step] = new
                heapq.heappush(queue, (new, i + step))
    return np.array(best).reshape(-1, width)[1:-1, 1:-1]


def cheapest_neighbour(cost: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Number in MOVES of the neighbour that each cell's cost comes from; of equally cheap ones the first. -1 where none is nearer."""
    near, price = np.pad(total, 1, constant_values=np.inf), np.pad(cost, 1, constant_values=np.inf)
    best, out = np.full(total.shape, np.inf), np.full(total.shape, -1)
    h, w = total.shape
    for k, (dr, dc, length) in enumerate(MOVES):
        at = slice(1 + dr, 1 + dr + h), slice(1 + dc, 1 + dc + w)
        new = near[at] + (cost + price[at]) / 2 * length
        take = (new < best - 1e-9) & (near[at] < total)
        best, out = np.where(take, new, best), np.where(take, k, out)
    return out


COST = "uc_id int, cell_id long, total double, previous long"


def tile_of(r: Column, c: Column, grid: Grid, size: int) -> Column:
    return (F.floor(r / size) * -(-grid.width // size) + F.floor(c / size)).cast("long")


def _tiles(cell: str, grid: Grid, size: int) -> Column:
    """Tiles that hold the cell itself or one of its neighbours."""
    r, c = grid.row(cell), grid.column(cell)
    clip = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    return F.array_distinct(F.array(*[tile_of(clip(r + a, grid.height), clip(c + b, grid.width), grid, size) for a in (-1, 0, 1) for b in (-1, 0, 1)]))


def _spreader(grid: Grid, size: int, whole: bool):
    """Costs within a tile and one cell around it, of every node with a start there: of all its own cells, or of those at its edge."""
    across, width = -(-grid.width // size), grid.width

    def run(cells: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"uc_id": [], "cell_id": [], "total": [], "previous": []})]
        if len(cells) and len(starts):
            tile = int(cells["tile"].iloc[0])
            r0, c0 = tile // across * size - 1, tile % across * size - 1
            place = lambda x: (x.to_numpy() // width - r0, x.to_numpy() % width - c0)
            cost = np.full((size + 2, size + 2), np.inf)
            cost[place(cells["cell_id"])] = cells["cost"]
            known = np.isfinite(cost)
            own = np.zeros_like(known)
            own[1:-1, 1:-1] = True
            if not whole:
                own[2:-2, 2:-2] = False
            rows, cols = np.nonzero(own & known)
            cell = (rows + r0) * width + cols + c0
            for uc, mine in starts.groupby("uc_id"):
                start = np.full(cost.shape, np.inf)
                np.minimum.at(start, place(mine["cell_id"]), mine["total"].to_numpy(float))
                start[~known] = np.inf
                total = spread(cost, start)
                back = np.full(len(cell), -1)
                if whole:
                    move = cheapest_neighbour(cost, total)[rows, cols]
                    step = np.array([dr * width + dc for dr, dc, _ in MOVES])[move]
                    back = np.where((move >= 0) & (total[rows, cols] > 0), cell + step, -1)
                met = np.isfinite(total[rows, cols])
                out.append(pd.DataFrame({"uc_id": uc, "cell_id": cell[met], "total": total[rows, cols][met], "previous": back[met]}))
        out = pd.concat(out, ignore_index=True).astype({"uc_id": "int32", "cell_id": "int64", "previous": "Int64"})
        return out.assign(previous=out["previous"].where(out["previous"] >= 0))

    return run


def cost_from_nodes(cost: DataFrame, sources: DataFrame, grid: Grid, size: int = TILE) -> DataFrame:
    """(uc_id, cell_id, total, previous): accumulated cost from every node, and the neighbour it comes from.

    cost: (cell_id, cost); sources: (cell_id, uc_id). A task holds one tile and the cells around it. Tiles tell each other the costs of their
    edges, and a tile is done again for a node while a neighbour's edge gets cheaper; the costs of inner cells are made once, at the end.
    """
    held = cut(cost.select(F.explode(_tiles("cell_id", grid, size)).alias("tile"), "cell_id", "cost"))
    zero = sources.select(F.col("uc_id").cast("int").alias("uc_id"), "cell_id", F.lit(0.0).alias("total"))
    edges = zero
    todo = edges.select("uc_id", F.explode(_tiles("cell_id", grid, size)).alias("tile")).distinct()
    while grid.width > size or grid.height > size:
        starts = edges.select("uc_id", "cell_id", "total", F.explode(_tiles("cell_id", grid, size)).alias("tile")).join(todo, ["uc_id", "tile"], "left_semi")
        new = held.groupBy("tile").cogroup(starts.groupBy("tile")).applyInPandas(_spreader(grid, size, False), COST).drop("previous")
        both = edges.withColumn("old", F.col("total")).unionByName(new, allowMissingColumns=True)
        both = cut(both.groupBy("uc_id", "cell_id").agg(F.min("total").alias("total"), F.min("old").alias("old")))
        edges = both.drop("old")
        better = both.where("old is null or total < old - 1e-9").select("uc_id", F.explode(_tiles("cell_id", grid, size)).alias("tile"), tile_of(grid.row(), grid.column(), grid, size).alias("own"))
        todo = cut(better.where("tile <> own").select("uc_id", "tile").distinct())
        if not todo.limit(1).count():
            break
    starts = edges.select("uc_id", "cell_id", "total", F.explode(_tiles("cell_id", grid, size)).alias("tile"))
    return held.groupBy("tile").cogroup(starts.groupBy("tile")).applyInPandas(_spreader(grid, size, True), COST)


def cheapest_pairs(total: DataFrame, sources: DataFrame, digits: int = 6) -> DataFrame:
    """(uc_a, uc_b, cost, target): for a < b the cheapest cell of b from a; of equal costs (to `digits`) the first cell."""
    target = sources.select("cell_id", F.col("uc_id").alias("uc_b"))
    met = total.withColumnRenamed("uc_id", "uc_a").join(target, "cell_id").where("uc_a < uc_b and total is not null")
    best = F.min(F.struct(F.round("total", digits).alias("total"), "cell_id")).alias("best")
    return met.groupBy("uc_a", "uc_b").agg(best).select("uc_a", "uc_b", F.col("best.total").alias("cost"), F.col("best.cell_id").alias("target"))


def traced(total: DataFrame, pairs: DataFrame, grid: Grid, size: int = TILE) -> DataFrame:
    """pairs with path: the array of cells from a to the target, by predecessors. Paths are followed tile by tile, all at once."""

    def run(x: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(e):
            back = {(u, c): p for u, c, p in zip(x["uc_id"], x["cell_id"], x["previous"])}
            for a, b, at in zip(e["uc_a"], e["uc_b"], e["at"]):
                part = []
                while at is not None and not pd.isna(at) and (a, int(at)) in back:
                    part.append(int(at))
                    at = back[a, int(at)]
                out.append((a, b, part, None if at is None or pd.isna(at) else int(at)))
        return pd.DataFrame(out, columns=["uc_a", "uc_b", "part", "at"]).astype({"at": "Int64"})

    here = tile_of(grid.row(), grid.column(), grid, size).alias("tile")
    steps = total.where("total is not null").select("uc_id", "cell_id", "previous", here)
    at, done, n = pairs.select("uc_a", "uc_b", F.col("target").alias("at")), None, 0
    while True:
        now = at.select("uc_a", "uc_b", "at", tile_of(grid.row("at"), grid.column("at"), grid, size).alias("tile"))
        near = steps.join(now.select(F.col("uc_a").alias("uc_id"), "tile").distinct(), ["uc_id", "tile"], "left_semi")
        went = cut(near.groupBy("tile").cogroup(now.groupBy("tile")).applyInPandas(run, "uc_a int, uc_b int, part array<long>, at long"))
        one = went.select("uc_a", "uc_b", F.lit(n).alias("n"), "part")
        done, n = one if done is None else done.union(one), n + 1
        at = went.where("at is not null").select("uc_a", "uc_b", "at")
        if not at.limit(1).count():
            break
    path = F.reverse(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]))).alias("path")
    return pairs.select("uc_a", "uc_b", "cost").join(done.groupBy("uc_a", "uc_b").agg(path), ["uc_a", "uc_b"])


def links(paths: DataFrame, sources: DataFrame, res: float, contiguous_km: float = 0.2) -> DataFrame:
    """(uc_a, uc_b, cost, length_km, crosses, direct, contiguous, path). length counts cells, whatever their direction."""
    owner = sources.select(F.col("cell_id").alias("cell"), "uc_id")
    cells = paths.select("uc_a", "uc_b", F.explode("path").alias("cell")).join(owner, "cell")
    third = cells.where("uc_id <> uc_a and uc_id <> uc_b").groupBy("uc_a", "uc_b").agg(F.array_sort(F.collect_set("uc_id")).alias("_third"))
    out = paths.join(third, ["uc_a", "uc_b"], "left")
    third = F.coalesce("_third", F.array().cast("array<int>"))
    km = F.size("path") * F.lit(res) / 1000
    return out.select("uc_a", "uc_b", "cost", km.alias("length_km"), joined_numbers(third).alias("crosses"), (F.size(third) == 0).alias("direct"), (km <= contiguous_km).alias("contiguous"), "path")


def reference_links(found: DataFrame) -> DataFrame:
    """Direct links that are not contiguous."""
    return found.where("direct and not contiguous")


def path_windows(found: DataFrame, grid: Grid, margin: int) -> DataFrame:
    """(uc_a, uc_b, r0, r1, c0, c1): a window of margin cells around each path, clipped to the grid."""
    r, c = F.transform("path", lambda x: F.floor(x / grid.width)), F.transform("path", lambda x: x % grid.width)
    return found.select(
        "uc_a", "uc_b",
        F.greatest(F.array_min(r) - margin, F.lit(0)).alias("r0"), F.least(F.array_max(r) + margin, F.lit(grid.height - 1)).alias("r1"),
        F.greatest(F.array_min(c) - margin, F.lit(0)).alias("c0"), F.least(F.array_max(c) + margin, F.lit(grid.width - 1)).alias("c1"),
    )


def corridors(cost: DataFrame, sources: DataFrame, windows: DataFrame, grid: Grid, tolerance: float = 0.10) -> DataFrame:
    """(uc_a, uc_b, cell_id) of cells whose cost from a and from b, within the link's window, is at most (1 + tolerance) of the least.

    One task per link holds its window. A link one of whose nodes lies outside of its window has no corridor.
    """
    rows = windows.select("uc_a", "uc_b", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("r"))
    rows = cost.select("cell_id", "cost", grid.row().alias("r"), grid.column().alias("c")).join(rows, "r").where("c between c0 and c1")  # by rows of the grid
    owner = sources.select("cell_id", F.col("uc_id").alias("owner"))
    rows = rows.select("uc_a", "uc_b", "cell_id", "cost").join(owner, "cell_id", "left")
    width = grid.width

    def run(x: pd.DataFrame) -> pd.DataFrame:
        r, c = x["cell_id"].to_numpy() // width, x["cell_id"].to_numpy() % width
        r, c = r - r.min(), c - c.min()
        cost, both = np.full((r.max() + 1, c.max() + 1), np.inf), 0.0
        cost[r, c] = x["cost"]
        for k in ("uc_a", "uc_b"):
            mine = (x["owner"] == x[k]).to_numpy()
            if not mine.any():
                return x.iloc[:0][["uc_a", "uc_b", "cell_id"]]
            start = np.full(cost.shape, np.inf)
            start[r[mine], c[mine]] = 0
            both = both + spread(cost, start)[r, c]
        return x.loc[both <= both.min() * (1 + tolerance) * (1 + 1e-12), ["uc_a", "uc_b", "cell_id"]]

    return rows.groupBy("uc_a", "uc_b").applyInPandas(run, "uc_a int, uc_b int, cell_id long")


def corridor_area(corridor: DataFrame, cells: DataFrame, cell_ha: float, natural: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(uc_a, uc_b, corridor_ha, natural_ha)."""
    met = corridor.join(cells, "cell_id", "left").groupBy("uc_a", "uc_b")
    count = F.sum(F.coalesce(F.col("cat").isin(*natural).cast("long"), F.lit(0)))
    return met.agg((F.count("*") * F.lit(cell_ha)).alias("corridor_ha"), (count * F.lit(cell_ha)).alias("natural_ha"))


def rupture(corridor: DataFrame, reference: DataFrame, now: DataFrame, cell_ha: float, costs: DataFrame | None = None, natural: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Per reference link: natural_ref_ha, natural_lost_ha, rupture_pct, forest_lost_ha - and with costs (uc_a, uc_b, cost_ref, cost): cost_delta_pct."""
    met = corridor.join(reference.select("cell_id", F.col("cat").alias("_was")), "cell_id", "left").join(now.select("cell_id", F.col("cat").alias("_is")), "cell_id", "left")
    ha = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0))) * F.lit(cell_ha)
    was, is_ = F.col("_was").isin(*natural), F.coalesce(F.col("_is").isin(*natural), F.lit(False))
    gone = (F.col("_was") == 1) & (F.coalesce("_is", F.lit(0)) != 1)
    out = met.groupBy("uc_a", "uc_b").agg(ha(was).alias("natural_ref_ha"), ha(was & ~is_).alias("natural_lost_ha"), ha(gone).alias("forest_lost_ha"))
    out = out.withColumn("rupture_pct", 100 * F.try_divide("natural_lost_ha", "natural_ref_ha"))
    if costs is not None:
        out = out.join(costs, ["uc_a", "uc_b"], "left").withColumn("cost_delta_pct", percent_change(F.col("cost"), F.col("cost_ref")))
    return out


def horizon_summary(rows: DataFrame, by: tuple[str, ...] = ("scenario", "year")) -> DataFrame:
    """Per scenario and year of evaluate()'s links in reference mode: nodes, links, those that exist and that are still direct, sums and means; the cost
    change among links that exist."""
    delta = F.when(F.col("exists"), F.col("cost_delta_pct"))
    return rows.groupBy(*by).agg(
        F.max("n_nodes").alias("nodes"), F.count("*").alias("links_ref"), F.sum(F.col("exists").cast("long")).alias("links_existing"), F.sum(F.col("direct").cast("long")).alias("links_direct"),
        F.avg("rupture_pct").alias("mean_rupture_pct"), F.sum("natural_lost_ha").alias("natural_lost_ha"), F.sum("forest_lost_ha").alias("forest_lost_ha"),
        F.sum("natural_ref_ha").alias("natural_ref_ha"), F.avg(delta).alias("mean_cost_delta_pct"), F.median(delta).alias("median_cost_delta_pct"),
    )


@dataclass
class Network:
    """One map's evaluation. links: a row per link of the mode; all_links: every pair of nodes; corridors: (uc_a, uc_b, cell_id); info: one row."""

    links: DataFrame
    all_links: DataFrame
    corridors: DataFrame
    cells: DataFrame
    info: DataFrame

    def reference(self) -> Network:
        """Only direct links that are not contiguous, as later maps are held against."""
        kept = reference_links(self.links)
        return replace(self, links=kept, corridors=self.corridors.join(kept.select("uc_a", "uc_b"), ["uc_a", "uc_b"], "left_semi"))


def evaluate(
    cells: DataFrame, owners: DataFrame, grid: Grid, table: Mapping[int, float], *, names: DataFrame | None = None, ref: Network | None = None,
    min_ha: float = 10, tolerance: float = 0.10, margin: int = 100, contiguous_km: float = 0.2, unmapped: float = 100, natural: tuple[int, ...] = (1, 2), size: int = TILE,
) -> Network:
    """The least-cost network of a map (cell_id, cat). names: (uc_id, nome).

    Without ref: a row per direct link with its corridor's area and natural area. With ref: a row per link of ref, whether it exists and is direct
    on this map, its cost beside ref's, and what this map has lost of the natural cells and the forest in ref's corridor.
    """
    cells = cut(cells.select("cell_id", "cat"))
    cost = cells.select("cell_id", resistance(F.col("cat"), table, unmapped).alias("cost"))
    found = cut(nodes(cells, owners, grid.cell_ha, min_ha))
    total = cut(cost_from_nodes(cost, found, grid, size))
    linked = cut(links(traced(total, cheapest_pairs(total, found), grid, size), found, grid.res, contiguous_km))
    pair, own = ["uc_a", "uc_b"], ["cost", "length_km", "crosses", "direct", "contiguous", "path"]
    if ref is None:
        direct = linked.where("direct")
        corridor = cut(corridors(cost, found, path_windows(direct, grid, margin), grid, tolerance))
        out = direct.select(*pair, F.lit(True).alias("exists"), *own).join(corridor_area(corridor, cells, grid.cell_ha, natural), pair, "left")
    else:
        corridor = ref.corridors
        out = corridor.select(*pair).distinct().join(linked.select(*pair, F.lit(True).alias("exists"), *own), pair, "left")
        costs = ref.all_links.select(*pair, F.col("cost").alias("cost_ref")).join(linked.select(*pair, "cost"), pair, "left")
        out = out.join(rupture(corridor, ref.cells, cells, grid.cell_ha, costs, natural).drop("cost"), pair, "left").na.fill(False, ["exists", "direct", "contiguous"]).na.fill("", ["crosses"])
    if names is not None:
        for k in "ab":
            out = out.join(names.select(F.col("uc_id").alias(f"uc_{k}"), F.col("nome").alias(f"name_{k}")), f"uc_{k}", "left")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    info = found.agg(F.countDistinct("uc_id").alias("n_nodes")).crossJoin(count(linked, "n_pairs")).crossJoin(count(linked.where("direct"), "n_direct"))  # one row each
    return Network(out.crossJoin(info.select("n_nodes")), linked, corridor, cells, info)
