"""Further registered queries: sources and sinks, guards, image preparation, reports, zones, projections."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.grid import Grid, grid_from_bounds
from gridloom.operators import costpath, metrics, mlp, overlay, sampling, temporal, vector
from gridloom.plans import derived, quality, simulate
from gridloom.plans.derived import RECLASS, grid, table
from gridloom.plans.queries import _H, _O, _W1, _W2, BLOCKS, CM, EVENTS, LINKS, MERIT, PRIORS, PROBS, SAMPLES, SIM, _events, _paths, _samples, _scored, _weights, _wide, query, rounded
from gridloom.sources import config, fetch, tables
from gridloom.streaming import ledger


def work(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{tables.shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


# Sources and sinks


@query("select cell_id, v from prices where year = 1998")
def layer_scan(spark, sf):
    path = work(spark, "layer")
    tables.write_layer(derived.prices(spark, sf), path)
    return tables.read_layer(spark, path, 1998, ["v"])


@query("select cell_id, year::int as year, case when year = 1998 then v + 1 else v end v from prices")
def band_update(spark, sf):
    path, prices = work(spark, "stack"), derived.prices(spark, sf)
    tables.write_layer(prices, path)
    tables.write_layer(prices.where("year = 1998").withColumn("v", F.col("v") + 1), path)
    return spark.read.parquet(path).select("cell_id", "year", "v")


@query("select cell_id, c1 as cat from maps")
def latest_version(spark, sf):
    folder, m = work(spark, "versions"), derived.maps(spark, sf)
    for t in (0, 1):
        tables.write_table(m.select("cell_id", F.col(f"c{t}").alias("cat")), f"{folder}/map_v{t + 1}")
    return spark.read.parquet(tables.latest(spark, folder, "map"))


@query("select cell_id, nullif(c0, 0)::smallint c0, nullif(c1, 0)::smallint c1, 'local' crs, 50 width, 2 bands, 0.0::double nodata from maps")
def raster_round_trip(spark, sf):
    path = work(spark, "raster")
    tables.write_raster(derived.maps(spark, sf), path, grid(spark, sf), {"c0": "smallint", "c1": "smallint"}, nodata=0)
    df, own, about = tables.read_raster(spark, path)
    return df.select("*", F.lit(own.crs).alias("crs"), F.lit(own.width).alias("width"), F.lit(len(about)).alias("bands"), F.lit(float(about["c0"]["nodata"])).alias("nodata"))


AREAS = "select 'a' scenario, 1 as year, " + ", ".join(f"round(sum((c0 = {k})::int) * 0.09, 6) class_{k}" for k in range(1, 7)) + " from maps"


def _areas(spark, sf):
    from gridloom.plans.queries import area_by_class

    return area_by_class(spark, sf)


@query(AREAS)
def csv_round_trip(spark, sf):
    path = work(spark, "csv")
    tables.write_csv(_areas(spark, sf), path)
    return tables.read_csv(spark, path, "areas")


@query(AREAS)
def json_round_trip(spark, sf):
    path = work(spark, "json")
    tables.write_json(_areas(spark, sf), path)
    return tables.read_json(spark, path, "areas", many_lines=False)


@query(AREAS)
def text_report(spark, sf):
    path = work(spark, "text")
    tables.write_text(_areas(spark, sf), path)
    return spark.read.text(path).select(F.from_json("value", tables.SCHEMAS["areas"]).alias("v")).select("v.*")


@query("select uc_id, nome from boxes where c0 <= 12 and c0 + 10 >= 0 and r0 <= 20")
def shapes_for_grid(spark, sf):
    """The scan's filter is on the stored bounds; the window is the upper left 20 rows and 12 columns."""
    path = work(spark, "shapes")
    tables.write_shapes(derived.boxes(spark, sf), path)
    return tables.read_for_grid(spark, path, Grid("local", 30.0, 0.0, grid(spark, sf).ymax, 12, 20)).select("uc_id", "nome")


@query(f""", h as (select cell_id, [{_H}] h from (select cell_id, r::double v, c::double u from maps)), o as (select cell_id, [{_O}] e from h)
select cell_id, {", ".join(f"round(e[{k}] / list_sum(e), 6) p{k}" for k in range(1, 7))} from o""")
def saved_network(spark, sf):
    path = work(spark, "network")
    mlp.Network([(np.array(_W1), np.array([0.1 * j for j in range(4)])), (np.array(_W2), np.zeros(6))]).save(spark, path)
    rows = derived.maps(spark, sf).select("cell_id", (F.col("r") / 50).alias("v"), (F.col("c") / 50).alias("u"))
    return _wide(mlp.score(rows, ["v", "u"], mlp.Network.load(spark, path)))


@query("select year::int as year, count(*) n_rows from prices where year between 1996 and 1999 group by 1")
def years_processed(spark, sf):
    """Two runs; the second finds the years of the first done."""
    out, book, prices = work(spark, "years"), work(spark, "ledger"), derived.prices(spark, sf)
    step = lambda y: prices.where(F.col("year") == y).drop("year")
    ledger.process_years(spark, [1996, 1997], step, out, book)
    ledger.process_years(spark, [1996, 1997, 1998, 1999], step, out, book)
    return ledger.finished(spark, book)


@query("select false kept")
def staged_cleanup(spark, sf):
    path = work(spark, "raw")
    tables.write_table(table(spark, sf, "region"), path)
    tables.drop_path(spark, path)
    return spark.createDataFrame([(tables.exists(spark, path),)], "kept boolean")


@query("select cat category, code from lut")
def reclass_file(spark, sf):
    path = work(spark, "reclass")
    lines = ["category name-codes", *(f"{k} class-{k}-{', '.join(map(str, v))}" for k, v in RECLASS.items())]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return config.read_reclass(spark, path).select("category", F.explode("codes").alias("code"))


@query("select true same, false other")
def same_reclass(spark, sf):
    rows = lambda t: spark.createDataFrame([(k, [*v]) for k, v in t.items()], "category int, codes array<int>")
    same = config.same_reclass(rows(RECLASS), rows(dict(reversed(RECLASS.items()))))
    return spark.createDataFrame([(same, config.same_reclass(rows(RECLASS), rows({**RECLASS, 6: [26]})))], "same boolean, other boolean")


@query("select 'local' crs, 30.0::double res, 50 width, 40 height, 0.09::double cell_ha, -60.0::double xmin, 1260.0::double ymax, 54 wide, 44 high")
def grid_file(spark, sf):
    """A grid read from its file, and one made from bounds with a margin."""
    path = work(spark, "grid")
    spark.createDataFrame([(json.dumps(grid(spark, sf).to_dict()),)], "value string").coalesce(1).write.text(path)
    g = config.load_grid(spark, path)
    b = grid_from_bounds((1.0, 2.0, 1499.0, 1190.0), "local", 30.0, 60.0)
    return spark.createDataFrame([(g.crs, g.res, g.width, g.height, g.cell_ha, b.xmin, b.ymax, b.width, b.height)], "crs string, res double, width int, height int, cell_ha double, xmin double, ymax double, wide int, high int")


@query('select column_name as "column" from (describe lineitem)', "")
def described_table(spark, sf):
    return tables.describe(spark, f"{sf}/lineitem.parquet").select("column")


@query("select cell_id, case when not (r < 16 and c < 16) then (r * 100 + c)::double end v from cells")
def fetched_tiles(spark, sf):
    """Each tile fails once before it comes; the first has nothing."""
    calls: dict[tuple, int] = {}

    def source(r, c, h, w):
        calls[r, c] = calls.get((r, c), 0) + 1
        if calls[r, c] == 1:
            raise fetch.TooManyRequests
        return None if r == c == 0 else (r + np.arange(h))[:, None] * 100 + c + np.arange(w)

    return fetch.fetch(grid(spark, sf).tiles(spark, 16), grid(spark, sf), source, first=0.001)


# Guards, masks, images


@query("""select e.cell_id, case when e.v - 50 >= 0 then e.v - 50 end rain, case when e.v > 0 then e.v end height, case when p.cell_id is not null then e.v end inside,
coalesce(e.v, -9999) raw from elevation e left join priority p using (cell_id)""")
def guarded_values(spark, sf):
    area = derived.priority(spark, sf).select("cell_id", F.lit(True).alias("aoi"))
    v = F.col("v")
    rows = derived.elevation(spark, sf).join(area, "cell_id", "left")
    return rows.select("cell_id", scalar.at_least(v - 50, 0).alias("rain"), scalar.above(v, 0).alias("height"), scalar.inside(v, F.col("aoi")).alias("inside"), scalar.to_sentinel(v).alias("raw"))


@query("""select l_orderkey, l_linenumber, case when ok and s between 0 and 1 and r between 0 and 1 and n between 0 and 1 and n + r <> 0 then round((n - r) / (n + r), 9) end ndvi,
case when ok and s between 0 and 1 and r between 0 and 1 and n between 0 and 1 and n + s <> 0 then round((n - s) / (n + s), 9) end ndwi, case when ok and t > 0 then round(t * 0.00341802::double + 149.0 - 273.15, 9) end lst from (
select l_orderkey, l_linenumber, l_partkey & 12 = 0 ok, l_partkey * 37 % 50000 * 2.75e-5 - 0.2 r, l_orderkey * 11 % 50000 * 2.75e-5 - 0.2 n, l_suppkey * 173 % 50000 * 2.75e-5 - 0.2 s, l_orderkey % 7 * 7000 t from lineitem)""", "")
def prepared_images(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("qa"), (F.col("l_partkey") * 37 % 50000).alias("red"), (F.col("l_orderkey") * 11 % 50000).alias("nir"), (F.col("l_suppkey") * 173 % 50000).alias("swir"), (F.col("l_orderkey") % 7 * 7000).alias("tir"))
    out = raw.transform(temporal.prepared, qa="qa", bits=(2, 3), red="red", nir="nir", swir="swir", thermal="tir", scale=2.75e-5, offset=-0.2, t_scale=0.00341802, t_offset=149.0)
    return rounded(out, "ndvi", "ndwi", "lst", digits=9)


@query("select c.cell_id, coalesce(k.code, 0) code from cells c left join codes k on k.cell_id = c.cell_id and k.t = 1")
def raw_cover(spark, sf):
    return temporal.raw_cover(derived.codes(spark, sf).withColumnRenamed("t", "year"), 1, grid(spark, sf).cells(spark))


@query(""", s as (select cell_id, r, c, (r * 2 + c)::double v from cells where r < 20 and c < 25),
t as (select i cell_id, (i // 50) / 2.0::double - 0.25 fy, (i % 50) / 2.0::double - 0.25 fx from range(2000) x(i)),
k as (select t.cell_id, s.v, (1 - abs(fx - s.c)) * (1 - abs(fy - s.r)) w from t join s on s.c between floor(fx) and floor(fx) + 1 and s.r between floor(fy) and floor(fy) + 1)
select y.year::int as year, cell_id, round(sum(v * w) / sum(w) * (y.src - 2020), 6) v from k, (values (2023, 2023), (2024, 2024), (2025, 2024)) y(year, src) where w > 0 group by y.year, y.src, cell_id""")
def precipitation_years(spark, sf):
    g = grid(spark, sf)
    coarse = Grid("local", 60.0, 0.0, g.ymax, g.width // 2, g.height // 2)
    years = coarse.cells(spark).withColumn("year", F.explode(F.array(*map(F.lit, (2023, 2024)))))
    layers = years.select("year", "cell_id", ((coarse.row() * 2 + coarse.column()) * (F.col("year") - 2020)).cast("double").alias("v"))
    return rounded(temporal.precipitation(layers, [2023, 2024, 2025], {2025: 2024}, coarse, grid(spark, sf)), "v")


@query("select cell_id, c0, c1, r from maps")
def scenario_columns(spark, sf):
    groups = {"classes": ["c0", "c1"], "place": ["r", "c0"], "rest": ["c"]}
    return derived.maps(spark, sf).select("cell_id", *temporal.names_for(groups, ["classes", "place"]))


@query("select cell_id, round(v, 4) v from prices where year = 2000")
def frozen_layer(spark, sf):
    return rounded(temporal.frozen_year(derived.prices(spark, sf), 2000), "v", digits=4)


@query("select cell_id, round_even(cell_id / 8.0::double, 2) v from cells")
def rounded_half_even(spark, sf):
    return grid(spark, sf).cells(spark).select("cell_id", scalar.half_even(F.col("cell_id") / 8, 2).alias("v"))


# Links and zones


@query(LINKS + """, l as (select uc_a::int uc_a, 5 uc_b, count(*) * 30.0 / 1000 km from paths group by 1), x as (select uc_a::int uc_a, string_agg(distinct uc_id::varchar, ',' order by uc_id::varchar) filter (where uc_id not in (uc_a, uc_b)) crosses from paths left join owners using (cell_id) group by 1)
select l.uc_a, l.uc_b, a.nome name_a, b.nome name_b, round(km, 6) length_km, coalesce(crosses, '') crosses, crosses is null direct, km <= 0.48 contiguous, crosses is null and km > 0.48 reference
from l join x using (uc_a) left join boxes a on a.uc_id = l.uc_a left join boxes b on b.uc_id = l.uc_b""")
def link_flags(spark, sf):
    path, _ = _paths(spark, sf)
    paths = path.groupBy("uc_a", "uc_b").agg(F.sort_array(F.collect_list("cell_id")).alias("path")).withColumn("cost", F.lit(0.0))
    found = costpath.links(paths, derived.owners(spark, sf), grid(spark, sf).res, 0.48)
    kept = costpath.reference_links(found).select("uc_a", "uc_b", F.lit(True).alias("reference"))
    names = derived.boxes(spark, sf)
    for k in "ab":
        found = found.join(names.select(F.col("uc_id").alias(f"uc_{k}"), F.col("nome").alias(f"name_{k}")), f"uc_{k}", "left")
    out = found.join(kept, ["uc_a", "uc_b"], "left").withColumn("reference", F.coalesce("reference", F.lit(False)))
    return rounded(out.select("uc_a", "uc_b", "name_a", "name_b", "length_km", "crosses", "direct", "contiguous", "reference"), "length_km")


@query("select cell_id, max(uc_id - 1)::int worth from inside where uc_id > 1 group by 1")
def positive_burn(spark, sf):
    worth = F.when(F.col("uc_id") < 5, F.col("uc_id") - 1).otherwise(F.col("uc_id") - 1)
    shapes = derived.boxes(spark, sf).select("ring", worth.alias("worth"), F.col("uc_id").alias("turn"))
    shapes = shapes.union(shapes.where("turn = 1").withColumns({"worth": F.lit(None).cast("int"), "turn": F.lit(9)}).select(*shapes.columns))
    return vector.burn_positive(shapes, grid(spark, sf), "worth", "turn")


@query(""", zone as (select r, c from inside where uc_id = 1), near as (select distinct m.r, m.c from cells m join zone z on pow(m.r - z.r, 2) + pow(m.c - z.c, 2) <= 16)
select row0::int row0, col0::int col0, least(8, 40 - row0)::int height, least(8, 50 - col0)::int width from (select distinct r // 8 * 8 row0, c // 8 * 8 col0 from near)""")
def zone_tiles(spark, sf):
    zone = vector.rasterize(derived.boxes(spark, sf).where("uc_id = 1").select("ring"), grid(spark, sf))
    return vector.tiles_meeting(vector.buffered(zone, grid(spark, sf), 120.0), grid(spark, sf), 8)


@query("select nome, round(count(distinct cell_id) * 0.09, 6) area_ha from (select substr(nome, 1, 1) nome, cell_id from inside) group by 1")
def merged_areas(spark, sf):
    cells = vector.merged_cells(derived.boxes(spark, sf).withColumn("nome", F.substring("nome", 1, 1)), grid(spark, sf))
    return rounded(cells.groupBy("nome").agg((F.count("*") * grid(spark, sf).cell_ha).alias("area_ha")), "area_ha")


@query(""", water as (select r, c from cells join boxes b on r between b.r0 - 1 and b.r0 + 8 and c between b.c0 - 1 and b.c0 + 10 where uc_id in (1, 2)),
road as (select r, c from inside where uc_id = 4)
select m.cell_id, (select round(30 * sqrt(min(pow(m.r - w.r, 2) + pow(m.c - w.c, 2))), 6) from water w) dist_hidrografia, (select round(30 * sqrt(min(pow(m.r - w.r, 2) + pow(m.c - w.c, 2))), 6) from road w) dist_estradas from cells m""")
def distance_layers(spark, sf):
    b = derived.boxes(spark, sf)
    inputs = {"dist_hidrografia": [b.where("uc_id = 1"), b.where("uc_id = 2")], "dist_estradas": [b.where("uc_id = 4")], "dist_ferrovias": [b.where("uc_id = 5")]}
    return rounded(vector.distance_layers(inputs, ["dist_hidrografia", "dist_estradas"], grid(spark, sf)), "dist_hidrografia", "dist_estradas")


@query(LINKS + """, x as (select coalesce(v, 0) v, cell_id in (select cell_id from wide) inn from maps left join priority using (cell_id)),
z as (select v, case when inn then 'corridors' else 'rest' end as zone from x union all select v, 'area' from x)
select zone, round(count(*) * 0.09, 6) area_ha, round(avg(v), 6) mean_v, round(100 * avg((v >= 1)::int), 6) pct_ge1, round(100 * avg((v >= 3)::int), 6) pct_ge3 from z group by 1""")
def enrichment_zones(spark, sf):
    out = overlay.enrichment_by_zone(_paths(spark, sf)[1], derived.maps(spark, sf), derived.priority(spark, sf), grid(spark, sf).cell_ha)
    return rounded(out, "area_ha", "mean_v", "pct_ge1", "pct_ge3")


@query(LINKS + """select uc_a::int uc_a, 5 uc_b, 'A' || uc_a name_a, round(count(*) * 0.03, 6) length_km, uc_a * 2.0::double as cost, round(avg(coalesce(v, 0)), 6) path_mean,
100 * avg((coalesce(v, 0) <= 1)::int) >= 50 uncovered from paths left join priority using (cell_id) group by uc_a""")
def link_overlay_named(spark, sf):
    path, wide = _paths(spark, sf)
    links = path.groupBy("uc_a", "uc_b").agg((F.count("*") * 0.03).alias("length_km")).withColumns({"name_a": F.concat(F.lit("A"), F.col("uc_a").cast("string")), "cost": F.col("uc_a") * 2.0})
    out = overlay.link_overlay(path, wide, derived.priority(spark, sf), links=links)
    return rounded(out.select("uc_a", "uc_b", "name_a", "length_km", "cost", "path_mean", "uncovered"), "length_km", "path_mean")


# Reports


@query(CM + """, rep as (select k, coalesce(hit / nullif(colsum, 0), 0) pr, coalesce(hit / nullif(rowsum, 0), 0) re, coalesce(2 * hit / nullif(rowsum + colsum, 0), 0) f, rowsum s from p)
select 'accuracy' as label, round(sum(h), 6) as precision, round(sum(h), 6) recall, round(sum(h), 6) f1, (select sum(n) from cm)::bigint support from p
union all select 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), sum(s)::bigint from rep
union all select 'weighted avg', round(sum(pr * s) / sum(s), 6), round(sum(re * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), sum(s)::bigint from rep""")
def report_summary(spark, sf):
    rows = derived.maps(spark, sf).where("c0 > 0 and c1 > 0").withColumn("sim", F.expr(SIM))
    return rounded(metrics.report_summary(metrics.confusion(rows, "c1", "sim")), "precision", "recall", "f1")


@query(PRIORS + PROBS + "select round(avg(-ln(greatest(prob[c1], 1e-15))), 6) log_loss from probs join maps using (cell_id) where c1 > 0")
def log_loss(spark, sf):
    rows = _scored(spark, sf).where("c1 > 0")
    return rounded(rows.agg(metrics.log_loss(F.get("prob", F.col("c1") - 1)).alias("log_loss")), "log_loss")


@query(BLOCKS + "select split, count(*) n from split group by 1")
def split_counts(spark, sf):
    from gridloom.plans.queries import block_split

    return sampling.counts_by(block_split(spark, sf), "split")


@query(SAMPLES + "select 'v' as name, round(100 * avg((v is null)::int), 6) null_pct from samples union all select 'w', round(100 * avg((w is null)::int), 6) from samples")
def null_shares(spark, sf):
    return rounded(sampling.null_shares(_samples(spark, sf), ["v", "w"]), "null_pct")


@query(SAMPLES + "select split, count(*) n from samples group by 1")
def sample_counts(spark, sf):
    return sampling.counts_by(_samples(spark, sf), "split")


VALID = CM + MERIT + """, e as (select 'sim' as label, round((select sum(h) from p), 6) accuracy, round(hit / (omission + hit + wrong_class + false_alarm), 6) merit, (select round(avg((sim <> c0)::int) * 100, 6) from judged) changed_sim from q
union all select 'persistence', round(avg((c0 = c1)::int), 6), 0.0, 0.0 from judged)
"""


def _validation(spark, sf):
    m = derived.maps(spark, sf)
    a, b, s = (m.select("cell_id", F.expr(c).alias("cat")) for c in ("c0", "c1", f"case when c0 > 0 and c1 > 0 then {SIM} else 0 end"))
    return rounded(simulate.validate(a, b, {"sim": s}), "accuracy", "merit", "changed_sim").select("label", "accuracy", "merit", "changed_sim")


@query(VALID + "select * from e")
def validation(spark, sf):
    return _validation(spark, sf)


@query(VALID + "select label, merit from e order by merit desc, label limit 1")
def best_scenario(spark, sf):
    return metrics.best_by(_validation(spark, sf), "label", "merit")


@query("""select 'prices: no year ' || y fault from range(1994, 2004) t(y) where y not in (select year from prices) union all
select 'prices: ' || n || ' years, not 3' from (select count(distinct year) n from prices) where n <> 3 union all select 'codes: width: 50, not 51'""")
def quality_gates(spark, sf):
    prices = derived.prices(spark, sf)
    faults = quality.missing_years(prices, list(range(1994, 2004)), "prices") + quality.band_count(prices, 3, "prices")
    layer = derived.maps(spark, sf).select("cell_id", F.col("c0").alias("v"))
    wide = Grid(grid(spark, sf).crs, grid(spark, sf).res, grid(spark, sf).xmin, grid(spark, sf).ymax, 51, grid(spark, sf).height)
    faults += [x for x in quality.alignment({"codes": (grid(spark, sf), layer)}, wide) if "rows" not in x] + quality.alignment({"codes": (grid(spark, sf), layer)}, grid(spark, sf))
    try:
        quality.require(faults)
    except quality.QualityError as e:
        faults = str(e).split("; ")
    return spark.createDataFrame([(x,) for x in faults], "fault string")


# Projection


@query("""select scenario, c0, c1, round(n / sum(n) over (partition by scenario, c0), 9) p from (
select 'trend' scenario, c0, c1, sum(n) n from counts group by all union all
select 'pressure', c0, c1, sum(n) from counts where period in ((select period from pair order by l desc, period limit 1), (select period from pair order by l desc, period limit 1) + 5) group by all)""", EVENTS)
def demand_matrices(spark, sf):
    out = None
    for name, m in simulate.demand_matrices(_events(spark, sf), ["trend", "pressure"], ()).items():
        one = m.select(F.lit(name).alias("scenario"), "c0", "c1", "p")
        out = one if out is None else out.union(one)
    return rounded(out, "p", digits=9)


@query(""", back as (select a.k c0, b.k c1, count(m.cell_id) n from classes a cross join classes b left join maps m on m.c1 = a.k and m.c0 = b.k group by 1, 2),
both_n as (select c0, c1, sum(n) n, sum(least(n, 5)) t from (select c0, c1, n from pairs union all select c0, c1, n from back) group by 1, 2)
select c0, c1, round(case when t > 0 then n / t::double else 0 end, 9) w from both_n""")
def retrained_weights(spark, sf):
    """The final network learns from the samples of both pairs; here the later pair is the map turned back."""
    m, rows = derived.maps(spark, sf), _samples(spark, sf)
    first = sampling.stratified_sample(rows.select("cell_id", "c0", "c1", "split", "v", "w"), 5)
    counts = sampling.transition_counts(m).join(sampling.transition_counts(sampling.stratified_sample(m, 5)).withColumnRenamed("n", "taken"), ["c0", "c1"])
    back = m.select("cell_id", F.col("c1").alias("c0"), F.col("c0").alias("c1"))
    blocks = sampling.split_blocks(rows)
    net, weights, every = simulate.retrain(first, counts, back, rows.select("cell_id", "v", "w"), blocks, sampling.scaler(rows, ["v", "w"]), ["v", "w"], grid(spark, sf), block=7, n_each=5, epochs=2)
    assert len(net.history) == 2 and every.count() > first.count()
    return rounded(weights, "w", digits=9)


@query()
def projection_areas(spark, sf):
    m = derived.maps(spark, sf)
    names = ["nbr_1", "v"]
    model = lambda rows: rows.withColumn("prob", mlp.linear_softmax(names, [[0.05 * k, 0.3 * (k % 3), 0.0005 * (k % 4)] for k in range(6)]))
    from gridloom.plans.queries import markov_absorbing

    areas, _ = simulate.project(m.select("cell_id", F.col("c0").alias("cat")), grid(spark, sf), model, _weights(spark, sf), {"trend": markov_absorbing(spark, sf)}, 2025, [2030, 2035], names=names, stored=derived.elevation(spark, sf).na.fill(0.0))
    return rounded(areas, *[f"class_{k}" for k in range(1, 7)])


@query()
def permutation_importance(spark, sf):
    rows = sampling.standardize(_samples(spark, sf), sampling.scaler(_samples(spark, sf), ["v", "w"]), ["v", "w"])
    net = mlp.train(rows, ["v", "w"], epochs=5)
    return mlp.importance(rows, ["v", "w"], net)
