"""Layers through time: windows of years, gap filling, frozen means, substitution, audits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import scalar
from gridloom.grid import Grid
from gridloom.operators.focal import resample_bilinear


def trailing_any(burned: DataFrame, years: int = 5, first_year: int = 1985, value: str = "burned") -> DataFrame:
    """(cell_id, year, any): 1 if value > 0 in the year or one of the years - 1 before; null counts as 0."""
    w = Window.partitionBy("cell_id").orderBy("year").rangeBetween(1 - years, 0)
    rows = burned.where(F.col("year") >= first_year)
    return rows.select("cell_id", "year", F.max(F.coalesce((F.col(value) > 0).cast("int"), F.lit(0))).over(w).alias("any"))


def frozen_mean(layers: DataFrame, first: int, last: int, value: str = "v") -> DataFrame:
    """(cell_id, v): mean over the years that are known; null if none is."""
    return layers.where(F.col("year").between(first, last)).groupBy("cell_id").agg(F.avg(value).alias("v"))


def frozen_year(layers: DataFrame, year: int) -> DataFrame:
    return layers.where(F.col("year") == year).drop("year")


def substitute_year(layers: DataFrame, wanted: list[int], instead: Mapping[int, int]) -> DataFrame:
    """Layers of the wanted years, taken from another year where `instead` says so."""
    spark = layers.sparkSession
    pairs = spark.createDataFrame([(y, instead.get(y, y)) for y in wanted], "year int, _from int")
    return pairs.join(layers.withColumnRenamed("year", "_from"), "_from").drop("_from")


def observations(sensors: list[DataFrame], first: int, last: int, months: tuple[int, int], columns: list[str], ts: str = "ts") -> DataFrame:
    """Union of sensors, cut to years and calendar months; each filter reaches every sensor's scan."""
    span = (F.col(ts) >= F.lit(f"{first}-01-01").cast("timestamp")) & (F.col(ts) < F.lit(f"{last + 1}-01-01").cast("timestamp"))
    cut = [s.where(span & F.month(ts).between(*months)).select("cell_id", ts, *columns) for s in sensors]
    out = cut[0]
    for s in cut[1:]:
        out = out.unionByName(s)
    return out


def gap_filled(obs: DataFrame, years: list[int], windows: list[tuple[int, int]], last_year: int, values: list[str], level_by: str, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, year, values, level) of every cell and year: per value the mean over the first window around the year that has one.

    obs: (cell_id, year, values). Window (before, after) of year t covers [t + before, min(t + after, last_year)]. level is the first
    window with level_by, else 255, as for cells without any observation. cells: those wanted, by default all of obs. The windows are a few literal rows, so the range join is a broadcast over pre-averaged
    yearly sums.
    """
    spark = obs.sparkSession
    sums = obs.groupBy("cell_id", F.col("year").alias("_y")).agg(*[F.sum(v).alias(f"_s_{v}") for v in values], *[F.count(v).alias(f"_n_{v}") for v in values])
    spans = spark.createDataFrame([(y, k, y + a, min(y + b, last_year)) for y in years for k, (a, b) in enumerate(windows)], "year int, _k int, _lo int, _hi int")
    met = sums.join(F.broadcast(spans), F.col("_y").between(F.col("_lo"), F.col("_hi")))
    blank = (obs if cells is None else cells).select("cell_id").distinct().select("cell_id", F.explode(F.array(*map(F.lit, years))).alias("year"))
    met = met.drop("_y", "_lo", "_hi").unionByName(blank, allowMissingColumns=True)
    pick = lambda v, k, c: F.sum(F.when(F.col("_k") == k, F.col(f"_{c}_{v}")))
    mean = lambda v, k: F.try_divide(pick(v, k, "s"), pick(v, k, "n"))
    n = len(windows)
    level = F.coalesce(*[F.when(pick(level_by, k, "n") > 0, k) for k in range(n)], F.lit(255))
    return met.groupBy("cell_id", "year").agg(*[F.coalesce(*[mean(v, k) for k in range(n)]).alias(v) for v in values], level.cast("int").alias("level"))


def range_audit(layers: DataFrame, low: float, high: float, invalid: list[int] = (), value: str = "v") -> DataFrame:
    """(year, valid_before, masked, valid_after): shares of cells before and after the closed range and the invalid years are masked."""
    v = F.col(value)
    after = F.when(~F.col("year").isin(*invalid), F.when(v.between(low, high), v)) if invalid else F.when(v.between(low, high), v)
    share = lambda c: F.avg(c.cast("double"))
    return layers.groupBy("year").agg(share(v.isNotNull()).alias("valid_before"), share(v.isNotNull() & after.isNull()).alias("masked"), share(after.isNotNull()).alias("valid_after"))


def validity(layers: DataFrame, values: list[str], levels: list[str] = (), codes: tuple[int, ...] = (0, 1, 2, 255)) -> DataFrame:
    """Per year: share of cells with each value, and of each fill level."""
    shares = [F.avg(F.col(v).isNotNull().cast("double")).alias(f"valid_{v}") for v in values]
    return layers.groupBy("year").agg(*shares, *[F.avg((F.col(x) == k).cast("double")).alias(f"{x}_{k}") for x in levels for k in codes])


def below(stats: DataFrame, columns: list[str], low: float) -> DataFrame:
    """(year, name, value) of unpivoted shares below a bound."""
    return stats.unpivot("year", columns, "name", "value").where(F.col("value") < low)


def quantile_ranges(layers: DataFrame, value: str = "v", by: tuple[str, ...] = ("year",)) -> DataFrame:
    """n, valid share, 0.1 / 50 / 99.9 percentiles, min and max."""
    q = F.percentile(value, F.array(F.lit(0.001), F.lit(0.5), F.lit(0.999)))
    out = layers.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(value).isNotNull().cast("double")).alias("valid"), q.alias("_q"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(*by, "n", "valid", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p001", "p50", "p999"))], "min", "max")


def extreme(ranges: DataFrame, low: float, high: float) -> DataFrame:
    return ranges.where((F.col("min") < low) | (F.col("max") > high))


def worst(stats: DataFrame, column: str, k: int = 5, key: str = "year") -> DataFrame:
    return stats.orderBy(column, key).limit(k)


def co_register(base: DataFrame, layers: dict[str, DataFrame], names: list[str], override: DataFrame | None = None) -> DataFrame:
    """base with a column per name, joined on cell_id; columns of override go before stored ones where they are known."""
    out = base
    for name in names:
        if name in layers:
            out = out.join(layers[name].select("cell_id", F.col("v").alias(name)), "cell_id", "left")
    if override is not None:
        mine = [n for n in names if n in override.columns]
        out = out.join(override.select("cell_id", *[F.col(n).alias(f"_over_{n}") for n in mine]), "cell_id", "left")
        for n in mine:
            out = out.withColumn(n, F.coalesce(f"_over_{n}", n) if n in layers else F.col(f"_over_{n}")).drop(f"_over_{n}")
    return out.select(*base.columns, *names)


def precipitation(layers: DataFrame, wanted: list[int], instead: Mapping[int, int], source: Grid, grid: Grid) -> DataFrame:
    """(year, cell_id, v) on grid: each wanted year's layer or its substitute's, resampled bilinearly."""
    own = substitute_year(layers, wanted, instead)
    out = None
    for year in wanted:
        one = resample_bilinear(own.where(F.col("year") == year), source, grid).select(F.lit(year).alias("year"), "cell_id", "v")
        out = one if out is None else out.unionByName(one)
    return out


def prepared(image: DataFrame, *, qa: str, bits: tuple[int, ...], red: str, nir: str, swir: str, thermal: str, scale: float, offset: float, t_scale: float, t_offset: float) -> DataFrame:
    """image's other columns with ndvi, ndwi and lst (Celsius): scale and offset first, then indices where all three reflectances lie in 0..1,
    the temperature where the raw value is positive; all null where a quality bit is set. Use it by transform()."""
    clear = scalar.clear_of(F.col(qa), bits)
    r, n, s = (scalar.scaled(F.col(c), scale, offset) for c in (red, nir, swir))
    ok = clear & scalar.all_within([r, n, s], 0, 1)
    warm = scalar.above(F.col(thermal), 0)
    rest = [c for c in image.columns if c not in (qa, red, nir, swir, thermal)]
    return image.select(
        *rest,
        scalar.inside(scalar.normalized_difference(n, r), ok).alias("ndvi"),
        scalar.inside(scalar.normalized_difference(n, s), ok).alias("ndwi"),
        scalar.inside(scalar.celsius(scalar.scaled(warm, t_scale, t_offset)), clear).alias("lst"),
    )


def raw_cover(codes: DataFrame, year: int, cells: DataFrame) -> DataFrame:
    """(cell_id, code) of a year; cells without a code have 0."""
    own = frozen_year(codes, year).select("cell_id", "code")
    return cells.select("cell_id").join(own, "cell_id", "left").select("cell_id", F.coalesce("code", F.lit(0)).alias("code"))


def names_for(groups: Mapping[str, list[str]], wanted: list[str]) -> list[str]:
    """Predictor columns of a scenario: those of its groups, in order, each once."""
    return list(dict.fromkeys(n for g in wanted for n in groups[g]))
