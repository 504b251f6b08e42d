"""Configuration, tables, the ledger and the file stream."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.grid import Grid
from gridloom.sources import config, fetch, tables
from gridloom.streaming import ledger


def test_reclass_text_equals_its_table(spark, tmp_path):
    f = tmp_path / "classes.txt"
    f.write_text("Category-Codes\n1 Forest-3, 4\n2 Non-forest-10, 11 \n")
    got = config.read_reclass(spark, str(f))
    assert {(r["category"], r["name"], tuple(r["codes"])) for r in got.collect()} == {(1, "Forest", (3, 4)), (2, "Non-forest", (10, 11))}
    same = spark.createDataFrame([(2, "x", [11, 10]), (1, "y", [3, 4])], got.schema)
    assert config.same_reclass(got, same) and not config.same_reclass(got, same.where("category = 1"))


def test_config_and_grid(spark, tmp_path, monkeypatch):
    (tmp_path / "c.json").write_text(json.dumps({"a": 1}))
    monkeypatch.setenv(config.VARIABLE, str(tmp_path / "c.json"))
    c = config.load_config()
    assert c["a"] == 1 and config.resolve(c, "x/y") == str(tmp_path / "x/y")
    (tmp_path / "g.json").write_text(json.dumps({"crs": "EPSG:1", "res": 30, "xmin": 0, "ymax": 60, "width": 2, "height": 2}, indent=1))
    assert config.load_grid(spark, str(tmp_path / "g.json")).bounds == (0, 0, 60, 60)


def test_layers_overwrite_one_year(spark, tmp_path):
    path = f"{tmp_path}/stack"
    rows = lambda y, v: spark.createDataFrame([(1, v, y)], "cell_id long, v double, year int")
    for y, v in ((2000, 1.0), (2001, 2.0), (2000, 3.0)):
        tables.write_layer(rows(y, v), path)
    assert tables.read_layer(spark, path, 2000, ["v"]).collect() == [(1, 3.0)]
    assert tables.read_layer(spark, path).count() == 2
    assert tables.latest(spark, str(tmp_path), "none").endswith("none_v1")


def test_csv_json_and_replacement(spark, tmp_path):
    areas = spark.createDataFrame([("a", 2030, *[float(k) for k in range(6)])], tables.SCHEMAS["areas"])
    tables.write_csv(areas, f"{tmp_path}/csv")
    tables.write_json(areas, f"{tmp_path}/json")
    assert tables.read_csv(spark, f"{tmp_path}/csv", "areas").collect() == areas.collect()
    assert tables.read_json(spark, f"{tmp_path}/json", "areas", many_lines=False).collect() == areas.collect()
    new = areas.withColumn("class_1", F.lit(9.0)).union(areas.withColumn("scenario", F.lit("b")))
    got = tables.append_replace(areas, new).collect()
    assert sorted((r["scenario"], r["class_1"]) for r in got) == [("a", 9.0), ("b", 0.0)]


def test_years_are_done_once(spark, tmp_path):
    done = []

    def step(year):
        done.append(year)
        return spark.createDataFrame([(1, float(year))], "cell_id long, v double")

    args = spark, [2000, 2001], step, f"{tmp_path}/out", f"{tmp_path}/ledger"
    assert ledger.process_years(*args) == [2000, 2001] and ledger.process_years(*args) == []
    assert done == [2000, 2001] and spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_stream_takes_new_files_once(spark, tmp_path):
    schema = "cell_id long, v double, year int"
    drop = lambda y: spark.createDataFrame([(1, 1.0, y)], schema).write.mode("append").parquet(f"{tmp_path}/drops")
    go = lambda: ledger.follow(spark, f"{tmp_path}/drops", schema, lambda d: d.withColumn("v", F.col("v") * 2), f"{tmp_path}/out", f"{tmp_path}/state")
    drop(2000)
    go()
    drop(2001)
    go()
    assert {(r["year"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(2000, 2.0), (2001, 2.0)}


def test_retries_wait_and_give_up():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 4:
            raise fetch.TooManyRequests if len(tries) < 3 else ValueError("late")
        return "done"

    assert fetch.with_retries(call, 5, 2.0, 50.0, waits.append) == "done" and waits == [30.0, 50.0, 8.0]
    with pytest.raises(ValueError, match="never"):
        fetch.with_retries(lambda: (_ for _ in ()).throw(ValueError("never")), 2, 1.0, 9.0, waits.append)
    assert waits[3:] == [1.0]


def test_bounds_reach_the_scan(spark, tmp_path):
    ring = lambda x: [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0)]
    shapes = spark.createDataFrame([(1, ring(0.0)), (2, ring(500.0)), (3, None)], "uc_id int, ring array<struct<x:double,y:double>>")
    tables.write_shapes(shapes, f"{tmp_path}/shapes")
    near = tables.read_for_grid(spark, f"{tmp_path}/shapes", Grid("local", 10.0, 20.0, 20.0, 5, 5), margin=15)
    assert [r["uc_id"] for r in near.collect()] == [1] and near.columns == ["uc_id", "ring"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = near.where("uc_id > 0")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(xmin" in plan and "GreaterThanOrEqual(xmax" in plan


def test_a_table_that_is_not_there_has_no_columns(spark, tmp_path):
    assert tables.describe(spark, f"{tmp_path}/none").count() == 0
    tables.write_layer(spark.range(3).withColumn("year", F.lit(2000)), f"{tmp_path}/by_year")
    assert {(r["column"], r["partition"]) for r in tables.describe(spark, f"{tmp_path}/by_year").collect()} == {("id", False), ("year", True)}


def test_command_line_probes_and_fills(spark, tmp_path):
    grid = Grid("local", 30.0, 0.0, 120.0, 4, 4)
    (tmp_path / "grid.json").write_text(json.dumps(grid.to_dict()))
    (tmp_path / "c.json").write_text(json.dumps({"paths": {n: n if n != "grid" else "grid.json" for n in ("grid", "raw", "layers", "ledger")}}))
    raw = spark.range(16).select(F.col("id").alias("cell_id"), F.when(F.col("id") != 5, F.col("id").cast("double")).alias("v"), F.explode(F.array(F.lit(2000), F.lit(2001))).alias("year"))
    tables.write_layer(raw, f"{tmp_path}/raw")
    args = lambda *a: cli.parser().parse_args(["--config", f"{tmp_path}/c.json", *a])
    got = {r["year"]: (r["valid_pct"], r["min"], r["max"]) for r in cli.run(args("probe", "--size", "2"), spark).collect()}
    assert got == {2000: (75.0, 6.0, 10.0), 2001: (75.0, 6.0, 10.0)}
    assert cli.run(args("fill", "--years", "2000", "2001"), spark) == [2000, 2001] and cli.run(args("fill", "--years", "2000"), spark) == []
    assert spark.read.parquet(f"{tmp_path}/layers").count() == 32
