"""Polygons as rings of points: area, bounds, point in polygon, rasterizing with priorities, dissolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.grid import Grid
from gridloom.operators.focal import distance_to, union_mask

RING = "array<struct<x:double,y:double>>"


def usable(shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """Shapes whose ring has three points or more."""
    return shapes.where(F.coalesce(F.size(ring) >= 3, F.lit(False)))


def bounds(shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """One row: xmin, ymin, xmax, ymax of all rings."""
    pick = lambda k, f: f(F.transform(ring, lambda p: p[k]))
    return shapes.agg(F.min(pick("x", F.array_min)).alias("xmin"), F.min(pick("y", F.array_min)).alias("ymin"), F.max(pick("x", F.array_max)).alias("xmax"), F.max(pick("y", F.array_max)).alias("ymax"))


def area(ring: Column) -> Column:
    """Shoelace area of a ring that need not be closed."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether the ring holds the point, by the parity of crossings of a ray to the east."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    spans = lambda p, q: (p["y"] > y) != (q["y"] > y)
    at = lambda p, q: p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
    hit = F.zip_with(ring, turned, lambda p, q: F.when(spans(p, q) & (x < at(p, q)), 1).otherwise(0))
    return F.aggregate(hit, F.lit(0), lambda s, v: s + v) % 2 == 1


def crossing(shapes: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, ring: str = "ring") -> DataFrame:
    """Usable shapes whose bounds meet the box: the filter of a scan by extent."""
    low = lambda k: F.array_min(F.transform(ring, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(ring, lambda p: p[k]))
    return usable(shapes, ring).where((low("x") <= xmax) & (high("x") >= xmin) & (low("y") <= ymax) & (high("y") >= ymin))


def rasterize(shapes: DataFrame, grid: Grid, ring: str = "ring", touched: bool = False) -> DataFrame:
    """shapes' other columns and cell_id for each cell a shape covers.

    touched=False: the cell's centre lies inside. True: any part of the cell's square meets the ring's sides or inside.
    Each shape makes only the candidate cells of its own bounds, so no pair of all cells and all shapes arises.
    """
    low = lambda k: F.array_min(F.transform(ring, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(ring, lambda p: p[k]))
    clip = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    box = crossing(shapes, *grid.bounds, ring=ring)
    first = (lambda v: F.ceil(v) - 1) if touched else F.floor  # a cell that only meets the shape's edge counts as touched
    c0, r0 = clip(first((low("x") - grid.xmin) / grid.res), grid.width), clip(first((grid.ymax - high("y")) / grid.res), grid.height)
    c1, r1 = clip(F.floor((high("x") - grid.xmin) / grid.res), grid.width), clip(F.floor((grid.ymax - low("y")) / grid.res), grid.height)
    rows = box.withColumn("_r", F.explode(F.sequence(r0, r1))).withColumn("_c", F.explode(F.sequence(c0, c1)))
    x, y = grid.x(F.col("_c")), grid.y(F.col("_r"))
    met = holds(F.col(ring), x, y)
    if touched:
        met = met | F.exists(_sides(F.col(ring)), lambda s: _meets(s, x, y, grid.res / 2))
    return rows.where(met).select(*[c for c in shapes.columns if c != ring], grid.cell(F.col("_r"), F.col("_c")).alias("cell_id"))


def _sides(ring: Column) -> Column:
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def _meets(s: Column, x: Column, y: Column, half: float) -> Column:
    """Whether a side meets the square around (x, y): its part inside of both slabs is not empty."""
    ends = []
    for a, b, m in (("ax", "bx", x), ("ay", "by", y)):
        d = s[b] - s[a]
        t0, t1 = F.try_divide(m - half - s[a], d), F.try_divide(m + half - s[a], d)
        flat = (s[a] >= m - half) & (s[a] <= m + half)
        ends.append((F.coalesce(F.least(t0, t1), F.when(flat, 0.0).otherwise(2.0)), F.coalesce(F.greatest(t0, t1), F.when(flat, 1.0).otherwise(-1.0))))
    return F.greatest(ends[0][0], ends[1][0], F.lit(0.0)) <= F.least(ends[0][1], ends[1][1], F.lit(1.0))


def by_burn_order(cells: DataFrame, value: str, order: str) -> DataFrame:
    """(cell_id, value): of shapes over one cell the last burnt stays."""
    return cells.groupBy("cell_id").agg(F.max_by(value, order).alias(value))


def burn_positive(shapes: DataFrame, grid: Grid, value: str, order: str, ring: str = "ring") -> DataFrame:
    """(cell_id, value) of shapes whose value is above 0 (a null counts as 0); of shapes over one cell the last by order stays."""
    return by_burn_order(rasterize(shapes.where(F.coalesce(F.col(value), F.lit(0)) > 0).select(value, order, ring), grid, ring), value, order)


def by_priority(cells: DataFrame, value: str = "uc_id") -> DataFrame:
    """(cell_id, value): strictly protected areas before others, then smaller before larger, then the greater id."""
    best = F.max_by(value, F.struct(F.col("protecao_integral"), -F.col("area_ha"), F.col(value)))
    return cells.groupBy("cell_id").agg(best.alias(value))


def first_of_each_shape(shapes: DataFrame, order: str, ring: str = "ring") -> DataFrame:
    """Of equal rings the first by order."""
    w = Window.partitionBy(F.sha2(F.to_json(ring), 256)).orderBy(order)
    return shapes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dissolve(shapes: DataFrame, name: str = "nome", order: str = "id", ring: str = "ring") -> DataFrame:
    """(name, categoria, rings, uc_id): one multipart row per name with its first category; uc_id numbers the names from 1."""
    one = shapes.groupBy(name).agg(F.min_by("categoria", order).alias("categoria"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ring).alias("ring")))).alias("_r"))
    one = one.select(name, "categoria", F.transform("_r", lambda x: x["ring"]).alias("rings"))
    return one.withColumn("uc_id", F.row_number().over(Window.orderBy(name)))


def path_points(path: Column, grid: Grid) -> Column:
    """Cell centres of an array of cells; null for fewer than two."""
    return F.when(F.size(path) > 1, F.transform(path, lambda c: F.struct(grid.x(grid.column(c)).alias("x"), grid.y(grid.row(c)).alias("y"))))


def merged_cells(shapes: DataFrame, grid: Grid, name: str = "nome", ring: str = "ring") -> DataFrame:
    """(name, cell_id): the union of each name's shapes as cells; overlaps count once."""
    return rasterize(shapes.select(name, ring), grid, ring).distinct()


def buffered(zone: DataFrame, grid: Grid, distance: float) -> DataFrame:
    """Cells whose centre is within `distance` of a zone cell's centre. zone: (cell_id)."""
    far = distance_to(zone.select("cell_id").distinct().withColumn("_z", F.lit(True)), grid, F.col("_z"))
    return far.where(F.col("distance") <= distance).select("cell_id")


def tiles_meeting(zone: DataFrame, grid: Grid, size: int) -> DataFrame:
    """Tiles of the grid that hold a cell of the zone."""
    at = F.struct((F.floor(grid.row() / size) * size).cast("int").alias("row0"), (F.floor(grid.column() / size) * size).cast("int").alias("col0"))
    return grid.tiles(zone.sparkSession, size).join(zone.select(at.alias("t")).select("t.*").distinct(), ["row0", "col0"], "left_semi")


def distance_layers(inputs: dict[str, list[DataFrame]], wanted: list[str], grid: Grid, touched: tuple[str, ...] = ("dist_hidrografia",)) -> DataFrame:
    """cell_id and a column for each wanted layer that has inputs: the distance to the union of its shapes. Layers in `touched` mark every cell met."""
    out = grid.cells(next(iter(inputs.values()))[0].sparkSession)
    for name in wanted:
        if name in inputs:
            mask = union_mask(*[rasterize(s.select("ring"), grid, touched=name in touched) for s in inputs[name]]).withColumn("_z", F.lit(True))
            out = out.join(distance_to(mask, grid, F.col("_z")).withColumnRenamed("distance", name), "cell_id")
    return out
