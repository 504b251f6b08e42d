"""Configuration, grid and reclassification files."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid

#: Names another configuration file than the default one.
VARIABLE = "GRIDLOOM_CONFIG"


def load_config(path: str | None = None, default: str = "config.yaml") -> dict:
    """A YAML (where that library is installed) or JSON configuration with its folder under "root". The argument goes before the environment."""
    found = Path(path or os.environ.get(VARIABLE) or default)
    text = found.read_text()
    if found.suffix == ".json":
        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text)
    return {**config, "root": str(found.resolve().parent)}


def resolve(config: dict, relative: str) -> str:
    return str(Path(config["root"]) / relative)


def load_grid(spark: SparkSession, path: str) -> Grid:
    row = spark.read.json(path, multiLine=True).select("crs", "res", "xmin", "ymax", "width", "height").first()
    return Grid(row["crs"], float(row["res"]), float(row["xmin"]), float(row["ymax"]), int(row["width"]), int(row["height"]))


def read_reclass(spark: SparkSession, path: str) -> DataFrame:
    """(category, name, codes) of a text with a header and lines "number name-code, code": the last hyphen divides."""
    return parse_reclass(spark.read.text(path))


def parse_reclass(lines: DataFrame) -> DataFrame:
    v = F.trim("value")
    form = r"^([0-9]+)\s*(.*)-([0-9,\s]+)$"
    rows = lines.where(v.rlike(form))
    part = lambda k: F.regexp_extract(v, form, k)
    codes = F.transform(F.split(part(3), ","), lambda c: F.trim(c).try_cast("int"))
    return rows.select(part(1).cast("int").alias("category"), F.trim(part(2)).alias("name"), codes.alias("codes"))


def same_reclass(a: DataFrame, b: DataFrame) -> bool:
    """Whether two reclassifications give each code the same category."""
    flat = lambda d: d.select("category", F.explode("codes").alias("code"))
    return not flat(a).exceptAll(flat(b)).limit(1).count() and not flat(b).exceptAll(flat(a)).limit(1).count()
