"""Command line: python -m gridloom.cli project|fill|probe ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import mlp
from gridloom.plans import quality, simulate
from gridloom.sources import config, fetch, tables
from gridloom.streaming import ledger


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    out.add_argument("--config", help="a configuration file; else the environment's, else the default one")
    sub = out.add_subparsers(dest="command", required=True)
    step = sub.add_parser("project", help="projects land use over demand scenarios")
    step.add_argument("scenarios", nargs="*", choices=["trend", "expansion", "pressure", []], help="all without any")
    step.add_argument("--reuse-model", action="store_true", help="takes the saved network instead of training one")
    step.add_argument("--years", type=int, nargs="+")
    fill = sub.add_parser("fill", help="copies the years of a raw layer that are missing")
    fill.add_argument("--years", type=int, nargs="+", required=True)
    look = sub.add_parser("probe", help="statistics of the central tile of a layer")
    look.add_argument("--size", type=int, default=512)
    return out


def central(grid, size: int) -> tuple[int, int, int, int]:
    h, w = min(size, grid.height), min(size, grid.width)
    return (grid.height - h) // 2, (grid.width - w) // 2, h, w


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame | list[int]:
    cfg = config.load_config(args.config)
    at = lambda name: config.resolve(cfg, cfg["paths"][name])
    grid = config.load_grid(spark, at("grid"))
    if args.command == "probe":
        return quality.probe(tables.read_layer(spark, at("raw")), grid, *central(grid, args.size))
    if args.command == "fill":
        return ledger.process_years(spark, args.years, lambda y: tables.read_layer(spark, at("raw"), y), at("layers"), at("ledger"))
    samples, names = spark.read.parquet(at("samples")), cfg["predictors"]
    scales = tables.read_csv(spark, at("scaler"), "scaler")
    net = mlp.Network.load(spark, at("model")) if args.reuse_model else mlp.train(sampling_rows(samples, scales, names), names, **cfg.get("training", {}))
    if not args.reuse_model:
        net.save(spark, at("model"))
    counts = tables.read_csv(spark, at("transitions"), "transition").withColumn("period", F.split("pair", "_")[0].cast("int"))
    cells = tables.read_layer(spark, at("classes"), cfg["start_year"], ["cat"])
    stored = spark.read.parquet(at("predictors"))
    weights = spark.read.parquet(at("weights"))
    model = lambda rows: mlp.score(sampling_rows(rows, scales, names), names, net)
    areas, _ = simulate.project(
        cells, grid, model, weights, simulate.demand_matrices(counts, args.scenarios or None), cfg["start_year"], args.years or cfg["years"],
        old=tables.read_csv(spark, at("areas"), "areas") if tables.exists(spark, at("areas")) else None, names=names, stored=stored,
        sink=lambda s, y, m: tables.write_layer(m.withColumn("scenario", F.lit(s)).withColumn("year", F.lit(y)), at("projections"), ("scenario", "year")),
    )
    done = tables.cut(areas)  # the old file is read before it is replaced
    tables.write_csv(done, at("areas"))
    return done


def sampling_rows(rows: DataFrame, scales: DataFrame, names: list[str]) -> DataFrame:
    from gridloom.operators.sampling import standardize

    return standardize(rows, scales, names)


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    out = run(parser().parse_args(argv), fetch.session())
    print(out if isinstance(out, list) else out.toPandas().to_string(index=False))


if __name__ == "__main__":
    main()
