"""Scans and sinks: layers by year, versions, CSV and JSON with schemas, partition overwrite, append with replace."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators.vector import crossing

#: Schemas of exchanged tables; nothing is inferred.
SCHEMAS = {
    "class_map": "year int, cell_id bigint, cat int",
    "band": "var string, year int, cell_id bigint, v float",
    "scaler": "name string, mean double, std double, median double",
    "transition": "pair string, c0 int, c1 int, n bigint",
    "links": "uc_a int, uc_b int, cost double, length_km double, crosses string, direct boolean, contiguous boolean, corridor_ha double, natural_ha double",
    "areas": "scenario string, year int, class_1 double, class_2 double, class_3 double, class_4 double, class_5 double, class_6 double",
    "shapes": "uc_id int, nome string, categoria string, area_ha double, protecao_integral boolean, ring array<struct<x:double,y:double>>",
    "corridors": "uc_a int, uc_b int, cell_id bigint",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a local master without one gets a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, it is computed once, and its size is known to joins."""
    path = f"{shared_dir(df.sparkSession)}/gridloom/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_layer(spark: SparkSession, path: str, year: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet layer: the year prunes partitions, the columns prune the scan."""
    df = spark.read.parquet(path)
    df = df if year is None else df.where(F.col("year") == year).drop("year")
    return df.select("cell_id", *columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, folder: str, name: str, versions: tuple[str, ...] = ("v2", "v1")) -> str:
    """The path of the first version that exists; the last one otherwise."""
    paths = [f"{folder}/{name}_{v}" for v in versions]
    return next((p for p in paths if exists(spark, p)), paths[-1])


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(SCHEMAS.get(schema, schema)).csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: str, many_lines: bool = True) -> DataFrame:
    return spark.read.schema(SCHEMAS.get(schema, schema)).json(path, multiLine=many_lines)


def write_layer(df: DataFrame, path: str, by: str | tuple[str, ...] = "year") -> None:
    """Overwrites the partitions that df has and leaves the others; the committer makes each write whole or void."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*([by] if isinstance(by, str) else by)).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file, for small reports."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_replace(old: DataFrame, new: DataFrame, key: str = "scenario") -> DataFrame:
    """old without the keys that new brings, and new."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def drop_path(spark: SparkSession, path: str, keep: bool = False) -> None:
    """Removes staged raw data once its result is committed."""
    if not keep:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_shapes(df: DataFrame, path: str, ring: str = "ring") -> None:
    """Shapes beside their bounds, which a later scan can filter by."""
    low = lambda k: F.array_min(F.transform(ring, lambda q: q[k]))
    high = lambda k: F.array_max(F.transform(ring, lambda q: q[k]))
    box = {"xmin": low("x"), "ymin": low("y"), "xmax": high("x"), "ymax": high("y")}
    write_table(df.withColumns(box).sort("xmin", "ymin"), path)


def read_for_grid(spark: SparkSession, path: str, grid: Grid, margin: float = 0.0) -> DataFrame:
    """Usable shapes of write_shapes() whose bounds meet the grid's and a margin; the filter on bounds reaches the Parquet scan."""
    x0, y0, x1, y1 = (v + d * margin for v, d in zip(grid.bounds, (-1, -1, 1, 1)))
    near = spark.read.parquet(path).where(f"xmin <= {x1} and xmax >= {x0} and ymin <= {y1} and ymax >= {y0}")
    return crossing(near.drop("xmin", "ymin", "xmax", "ymax"), x0, y0, x1, y1)


def write_raster(df: DataFrame, path: str, grid: Grid, bands: dict[str, str], nodata: float | None = None) -> None:
    """Bands (name -> Spark type) by cell_id, with the grid, the sentinel and the band's number as column metadata; nulls stay nulls."""
    about = {"grid": json.dumps(grid.to_dict()), "nodata": "" if nodata is None else str(nodata)}
    value = lambda name: F.nullif(F.col(name).cast("double"), F.lit(float(nodata))) if nodata is not None else F.col(name)
    columns = [value(n).cast(t).alias(n, metadata={**about, "band": i}) for i, (n, t) in enumerate(bands.items(), 1)]
    write_table(df.select("cell_id", *columns), path)


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Grid, dict[str, dict]]:
    """The cells, their grid, and each band's metadata."""
    df = spark.read.parquet(path)
    about = {f.name: dict(f.metadata) for f in df.schema if "grid" in f.metadata}
    return df, Grid(**json.loads(next(iter(about.values()))["grid"])), about


def describe(spark: SparkSession, path: str) -> DataFrame:
    """(column, type, partition) of a table at a path; no rows where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "column string, type string, partition boolean")
    df = spark.read.parquet(path)
    parts = {n for n in df.columns if any(f"/{n}=" in f for f in df.inputFiles()[:1])}
    return spark.createDataFrame([(n, t, n in parts) for n, t in df.dtypes], "column string, type string, partition boolean")
