"""Quality gates: each returns the faults it found, and require() stops on any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid, divergences, layer_faults


class QualityError(Exception):
    pass


def require(faults: list[str]) -> None:
    if faults:
        raise QualityError("; ".join(faults))


def alignment(layers: dict[str, tuple[Grid, DataFrame]], grid: Grid, sentinel: float | None = -9999, value: str = "v") -> list[str]:
    out = []
    for name, (own, cells) in layers.items():
        out += [f"{name}: {x}" for x in divergences(own, grid)]
        row = layer_faults(cells, grid, value, sentinel).first().asDict()
        out += [f"{name}: {n} {k}" for k, n in row.items() if k != "n_rows" and n]
        if row["n_rows"] != grid.width * grid.height:
            out.append(f"{name}: {row['n_rows']} rows, not {grid.width * grid.height}")
    return out


def band_count(stack: DataFrame, years: int, name: str = "stack") -> list[str]:
    n = stack.agg(F.countDistinct("year").alias("n")).first()["n"]
    return [] if n == years else [f"{name}: {n} years, not {years}"]


def missing_years(stack: DataFrame, years: list[int], name: str = "stack") -> list[str]:
    want = stack.sparkSession.createDataFrame([(y,) for y in years], "year int")
    return [f"{name}: no year {r['year']}" for r in want.join(stack.select("year"), "year", "left_anti").orderBy("year").collect()]


def unmapped_codes(codes: DataFrame, table: dict[int, int]) -> DataFrame:
    """(code, n, mapped) by code: how often each raw code occurs, and whether the reclassification knows it."""
    known = codes.sparkSession.createDataFrame([(k,) for k in table], "code int").withColumn("mapped", F.lit(True))
    n = codes.groupBy("code").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(known), "code", "left").select("code", "n", F.coalesce("mapped", F.lit(False)).alias("mapped")).orderBy("code")


def forest_two_ways(cells: DataFrame, by: str, category: int = 1, code: int = 3) -> DataFrame:
    """(by, by_category, by_code, share): cells of the category, of its main raw code, and the category's share. cells: (cat, code, by)."""
    one = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    cat = F.col("cat") == category
    return cells.groupBy(by).agg(one(cat).alias("by_category"), one(F.col("code") == code).alias("by_code"), F.avg(cat.cast("double")).alias("share"))


def probe(layers: DataFrame, grid: Grid, row0: int, col0: int, height: int, width: int, by: str = "year", value: str = "v") -> DataFrame:
    """Per band: percentage of valid cells, min, mean and max in one tile."""
    tile = grid.row().between(row0, row0 + height - 1) & grid.column().between(col0, col0 + width - 1)
    valid = F.avg(F.col(value).isNotNull().cast("double")) * 100
    return layers.where(tile).groupBy(by).agg(valid.alias("valid_pct"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
