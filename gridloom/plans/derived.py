"""Grids derived from the star schema's tables by integer arithmetic, the same in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import reclass_table, reclassify
from gridloom.grid import Grid
from gridloom.operators import vector
from gridloom.sources.tables import shared_dir

#: The grid's height and width in cells, and the lines of the table that go with it.
HEIGHT, WIDTH, LINES = 40, 50, 60_000
#: That grid, for points that don't come from the lines.
LEAST = Grid("local", 30.0, 0.0, 30.0 * HEIGHT, WIDTH, HEIGHT)
_SIZES: dict[str, int] = {}


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The grid of a set of tables: its cells grow with the lines, its sides by whole multiples of 40 x 50."""
    if sf_dir not in _SIZES:
        _SIZES[sf_dir] = table(spark, sf_dir, "lineitem").count()
    k = max(1, round(math.sqrt(_SIZES[sf_dir] / LINES)))
    return Grid("local", 30.0, 0.0, 30.0 * HEIGHT * k, WIDTH * k, HEIGHT * k)


# Land-cover codes of the six categories (forest, other natural, pasture, agriculture, urban, water).
RECLASS = {
    1: [3, 4, 5, 6, 49],
    2: [10, 11, 12, 29, 50],
    3: [15, 21],
    4: [9, 14, 18, 19, 20, 35, 36, 39, 40, 41, 46, 47, 48, 62],
    5: [22, 23, 24, 25, 30, 32, 75],
    6: [26, 31, 33],
}
# Resistance of the six categories.
RESISTANCE = {1: 1, 2: 90, 3: 95, 4: 53, 5: 100, 6: 74}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(g: Grid):
    return (F.col("l_orderkey") % g.height * g.width + F.col("l_partkey") % g.width).alias("cell_id")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, t, code): t is 0 up to 1997, then 1."""
    t = F.when(F.year("l_shipdate") <= 1997, 0).otherwise(1).alias("t")
    return table(spark, sf_dir, "lineitem").groupBy(_cell(grid(spark, sf_dir)), t).agg((F.sum("l_linenumber") % 64).cast("int").alias("code"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, r, c, c0, c1) of all cells; a cell without code is 0."""
    g = grid(spark, sf_dir)
    cat = reclassify(F.col("code"), reclass_table(RECLASS))
    per = codes(spark, sf_dir).groupBy("cell_id").agg(*[F.max(F.when(F.col("t") == t, cat)).alias(f"c{t}") for t in (0, 1)])
    out = g.cells(spark).join(per, "cell_id", "left")
    return out.select("cell_id", g.row().alias("r"), g.column().alias("c"), *[F.coalesce(f"c{t}", F.lit(0)).cast("int").alias(f"c{t}") for t in (0, 1)])


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, year, v): mean price of the cell's lines in whole cents; null for the sentinel, which stands where lines are few."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    lines = table(spark, sf_dir, "lineitem").groupBy(_cell(grid(spark, sf_dir)), F.year("l_shipdate").alias("year"))
    rows = lines.agg(cents.alias("s"), F.count("*").alias("n"))
    return rows.select("cell_id", "year", F.nullif(F.when((F.col("cell_id") + F.col("year")) % 11 == 0, -9999.0).otherwise(F.floor(F.col("s") / F.col("n")).cast("double")), F.lit(-9999.0)).alias("v"))


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, v): a smooth integer surface with holes where class 0 stood before, in the first rows."""
    m = maps(spark, sf_dir)
    v = (F.col("r") * F.col("r") % 97 + F.col("c") * 3 + F.col("c0") * 2).cast("double")
    return m.select("cell_id", F.when(~((F.col("c0") == 0) & (F.col("r") < 10)), v).alias("v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle per region, each over a corner of the next: (uc_id, nome, categoria, area_ha, protecao_integral, ring)."""
    n, top = table(spark, sf_dir, "region"), grid(spark, sf_dir).ymax
    k = F.col("r_regionkey").cast("int")
    r0, c0 = k * 5 % 32, k * 7 % 40
    x0, x1 = c0 * 30.0, (c0 + 10) * 30.0
    y1, y0 = top - r0 * 30.0, top - (r0 + 8) * 30.0
    ring = F.array(*[F.struct(F.lit(a).alias("x") if not hasattr(a, "alias") else a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    rows = n.select((k + 1).alias("uc_id"), F.col("r_name").alias("nome"), (k % 3).cast("string").alias("categoria"), (k % 2 == 0).alias("protecao_integral"), ring.alias("ring"))
    return rows.withColumn("area_ha", vector.area(F.col("ring")) / 10_000 + F.col("uc_id") * 0.01)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.by_priority(vector.rasterize(boxes(spark, sf_dir), grid(spark, sf_dir)))


def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, v) from 1 to 7; cells that would have 0 are absent."""
    return maps(spark, sf_dir).select("cell_id", ((F.col("r") * 3 + F.col("c") * 5 + F.col("c0")) % 8).alias("v")).where("v > 0")


_LUT = ", ".join(f"({code}, {cat})" for cat, values in RECLASS.items() for code in values)
_RES = ", ".join(f"({k}, {v}.0::double)" for k, v in RESISTANCE.items())
#: CTEs of the same grids, at the size that they have up to LINES lines.
SQL = f"""
with recursive lut(code, cat) as (values {_LUT}),
codes as (
  select l_orderkey % 40 * 50 + l_partkey % 50 cell_id, case when year(l_shipdate) <= 1997 then 0 else 1 end t, (sum(l_linenumber) % 64)::int code
  from lineitem group by 1, 2
), cells as (select i cell_id, (i // 50)::int r, (i % 50)::int c from range(2000) x(i)),
maps as (
  select cells.cell_id, r, c, coalesce(a.cat, 0) c0, coalesce(b.cat, 0) c1 from cells
  left join (select cell_id, cat from codes join lut using (code) where t = 0) a using (cell_id)
  left join (select cell_id, cat from codes join lut using (code) where t = 1) b using (cell_id)
), prices as (
  select l_orderkey % 40 * 50 + l_partkey % 50 cell_id, year(l_shipdate) as year,
    case when (l_orderkey % 40 * 50 + l_partkey % 50 + year(l_shipdate)) % 11 <> 0 then floor(sum(round(l_extendedprice * 100)::bigint)::double / count(*)) end v
  from lineitem group by 1, 2
), elevation as (select cell_id, r, c, case when not (c0 = 0 and r < 10) then (r * r % 97 + c * 3 + c0 * 2)::double end v from maps),
classes(k) as (values (1), (2), (3), (4), (5), (6)),
pairs as (select a.k c0, b.k c1, count(m.cell_id) n from classes a cross join classes b left join maps m on m.c0 = a.k and m.c1 = b.k group by 1, 2),
matrix as (
  select c0, c1, case when c0 in (5, 6) then (c0 = c1)::int::double else n / greatest(sum(n) over (partition by c0), 1)::double end p from pairs
), boxes as (
  select r_regionkey::int + 1 uc_id, r_name nome, r_regionkey * 5 % 32 r0, r_regionkey * 7 % 40 c0, r_regionkey % 2 = 0 strict,
    7.2::double + (r_regionkey + 1) * 0.01::double area_ha from region
), inside as (select cell_id, r, c, b.* exclude (c0), b.c0 bc0 from cells join boxes b on r >= b.r0 and r < b.r0 + 8 and c >= b.c0 and c < b.c0 + 10),
owners as (
  select cell_id, uc_id from inside qualify row_number() over (partition by cell_id order by strict desc, area_ha, uc_id desc) = 1
), priority as (select cell_id, ((r * 3 + c * 5 + c0) % 8)::int v from maps where (r * 3 + c * 5 + c0) % 8 > 0),
resist(k, cost) as (values {_RES}),
surface as (select cell_id, r, c, c1, coalesce(cost, 100.0) cost from maps left join resist on k = c1),
forest as (select o.uc_id, count(*) filter (where c1 = 1) * 0.09::double ha from owners o join maps using (cell_id) group by 1),
nodes as (select cell_id, uc_id from owners join maps using (cell_id) join forest using (uc_id) where c1 = 1 and ha >= 0.2),
moves(dr, dc, len) as (values (-1, -1, sqrt(2)), (-1, 0, 1.0), (-1, 1, sqrt(2)), (0, -1, 1.0), (0, 1, 1.0), (1, -1, sqrt(2)), (1, 0, 1.0), (1, 1, sqrt(2)))
"""
#: Further CTEs: accumulated costs of every node, and what follows from them.
COSTS = """, reach(uc_id, cell_id, d) using key (uc_id, cell_id) as (
  select uc_id, cell_id, 0.0::double from nodes
  union
  select f.uc_id, t.cell_id, min(f.d + (a.cost + t.cost) / 2 * m.len)
  from reach f join surface a on a.cell_id = f.cell_id cross join moves m join surface t on t.r = a.r + m.dr and t.c = a.c + m.dc
  left join recurring.reach o on o.uc_id = f.uc_id and o.cell_id = t.cell_id
  where o.d is null or f.d + (a.cost + t.cost) / 2 * m.len < o.d - 1e-9
  group by 1, 2
), total as (select uc_id, cell_id, d from reach),
linked as (
  select t.uc_id uc_a, n.uc_id uc_b, min(round(d, 6)) as cost, arg_min(n.cell_id, round(d, 6) * 1e6 + n.cell_id / 1e4) target
  from total t join nodes n using (cell_id) where t.uc_id < n.uc_id group by 1, 2
), both_ways as (
  select l.uc_a, l.uc_b, a.cell_id, a.d + b.d total from linked l join total a on a.uc_id = l.uc_a join total b on b.uc_id = l.uc_b and b.cell_id = a.cell_id
), corridor as (
  select uc_a, uc_b, cell_id from both_ways qualify total <= min(total) over (partition by uc_a, uc_b) * 1.1 * (1 + 1e-12)
)
"""
