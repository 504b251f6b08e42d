"""The canonical grid: cell addresses, bounds, alignment, tiles and blocks."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """North-up grid. cell_id = row * width + column."""

    crs: str
    res: float
    xmin: float
    ymax: float
    width: int
    height: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.xmin, self.ymax - self.height * self.res, self.xmin + self.width * self.res, self.ymax

    @property
    def diagonal(self) -> float:
        return math.hypot(self.width, self.height) * self.res

    @property
    def cell_ha(self) -> float:
        return self.res**2 / 10_000

    def to_dict(self) -> dict:
        return asdict(self)

    def row(self, cell: Column | str = "cell_id") -> Column:
        return F.floor(_col(cell) / self.width).cast("int")

    def column(self, cell: Column | str = "cell_id") -> Column:
        return (_col(cell) % self.width).cast("int")

    def cell(self, row: Column, column: Column) -> Column:
        return row.cast("long") * self.width + column

    def x(self, column: Column) -> Column:
        return F.lit(self.xmin) + (column + 0.5) * self.res

    def y(self, row: Column) -> Column:
        return F.lit(self.ymax) - (row + 0.5) * self.res

    def cell_at(self, x: Column, y: Column) -> Column:
        """Cell of a world point; null outside of the grid."""
        c, r = F.floor((x - self.xmin) / self.res), F.floor((self.ymax - y) / self.res)
        inside = (c >= 0) & (c < self.width) & (r >= 0) & (r < self.height)
        return F.when(inside, self.cell(r, c))

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell_id."""
        return spark.range(self.width * self.height).withColumnRenamed("id", "cell_id")

    def block(self, cell: Column | str, size: int) -> Column:
        """Block of size x size cells; a row of blocks has ceil(width / size)."""
        across = -(-self.width // size)
        return (F.floor(self.row(cell) / size) * across + F.floor(self.column(cell) / size)).cast("long")

    def tiles(self, spark: SparkSession, size: int) -> DataFrame:
        """(row0, col0, height, width) of tiles; those at the far edges are ragged. Filter them for a subset."""
        down, across = -(-self.height // size), -(-self.width // size)
        at = spark.range(down * across)
        r0, c0 = (F.floor(F.col("id") / across) * size).cast("int"), (F.col("id") % across * size).cast("int")
        return at.select(r0.alias("row0"), c0.alias("col0"), F.least(F.lit(size), self.height - r0).alias("height"), F.least(F.lit(size), self.width - c0).alias("width"))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def grid_from_bounds(bounds: tuple[float, float, float, float], crs: str, res: float, margin: float = 0.0) -> Grid:
    """Smallest grid on multiples of res that covers bounds and margin."""
    west, south = (math.floor((v - margin) / res) for v in bounds[:2])
    east, north = (math.ceil((v + margin) / res) for v in bounds[2:])
    return Grid(crs, res, west * res, north * res, east - west, north - south)


def divergences(layer: Grid, grid: Grid) -> list[str]:
    """How a layer's grid differs from the canonical one; empty if it is aligned."""
    out = [f"{k}: {getattr(layer, k)}, not {getattr(grid, k)}" for k in ("crs", "width", "height") if getattr(layer, k) != getattr(grid, k)]
    return out + [f"{k}: {getattr(layer, k)}, not {getattr(grid, k)}" for k in ("res", "xmin", "ymax") if abs(getattr(layer, k) - getattr(grid, k)) > 1e-6]


def layer_faults(cells: DataFrame, grid: Grid, value: str = "v", sentinel: float | None = None) -> DataFrame:
    """One row (n_rows, n_outside, n_repeated, n_sentinel) about a layer that should hold each cell once and no raw sentinel."""
    cell = F.col("cell_id")
    outside = (cell < 0) | (cell >= grid.width * grid.height) | cell.isNull()
    raw = F.coalesce(F.col(value) == sentinel, F.lit(False)) if sentinel is not None else F.lit(False)
    per = cells.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum(raw.cast("long")).alias("raw"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("n_outside"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("n_sentinel"),
    )
