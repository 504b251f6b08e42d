"""Grid, scalar, focal, accuracy, allocation, Markov and path operators on tiny inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.grid import Grid, divergences, grid_from_bounds
from gridloom.operators import allocate, costpath, focal, markov, metrics, mlp, sampling, temporal, vector
from gridloom.plans import derived, quality, simulate


def square(n, res=30.0):
    return Grid("local", res, 0.0, n * res, n, n)


def layer(spark, grid, values, kind="double"):
    flat = np.asarray(values).ravel().tolist()
    return spark.createDataFrame([(i, v) for i, v in enumerate(flat)], f"cell_id long, v {kind}")


def as_array(df, grid, column):
    out = np.full(grid.width * grid.height, np.nan)
    for r in df.select("cell_id", column).collect():
        out[r[0]] = np.nan if r[1] is None else r[1]
    return out.reshape(grid.height, grid.width)


def test_grid_covers_bounds_and_margin():
    g = grid_from_bounds((152479.9, 7327982.8, 297867.2, 7467425.1), "EPSG:31983", 30, 10_000)
    assert (g.width, g.height) == (5514, 5316)
    assert g.xmin % 30 == 0 and g.ymax % 30 == 0
    assert divergences(g, g) == []
    assert len(divergences(Grid("x", 30, g.xmin + 1, g.ymax, g.width, 1), g)) == 3


def test_distance_is_exact_and_null_without_mask(spark):
    g = square(11)
    m = np.zeros((11, 11), bool)
    m[5, 5] = True
    d = as_array(focal.distance_to(layer(spark, g, m.tolist(), "boolean"), g, F.col("v")), g, "distance")
    assert (d[5, 5], d[5, 8], d[8, 9]) == (0, 90, 150)
    none = focal.distance_to(layer(spark, g, np.zeros((11, 11), bool).tolist(), "boolean"), g, F.col("v"))
    assert none.where("distance is not null").count() == 0 and none.count() == 121


def test_distance_equals_brute_force(spark):
    g = Grid("local", 2.0, 0.0, 0.0, 9, 13)
    rng = np.random.default_rng(0)
    m = rng.random((13, 9)) < 0.07
    d = as_array(focal.distance_to(layer(spark, g, m.tolist(), "boolean"), g, F.col("v")), g, "distance")
    hits = np.argwhere(m)
    want = np.array([[np.sqrt(((hits - (r, c)) ** 2).sum(1)).min() * 2 for c in range(9)] for r in range(13)])
    assert np.allclose(d, want)


def test_signed_distance(spark):
    g = square(9)
    m = np.zeros((9, 9), bool)
    m[3:6, 3:6] = True
    d = as_array(focal.signed_distance_to(layer(spark, g, m.tolist(), "boolean"), g, F.col("v")), g, "distance")
    assert d[4, 4] == -60 and d[0, 0] > 0
    full = focal.signed_distance_to(layer(spark, g, np.ones((9, 9), bool).tolist(), "boolean"), g, F.col("v"))
    assert full.where("distance is not null").count() == 0


@pytest.mark.parametrize("res, want", [(1.0, 45.0), (30.0, math.degrees(math.atan(1 / 30)))])
def test_slope_of_a_plane(spark, res, want):
    g = square(20, res)
    s = as_array(focal.slope_horn(layer(spark, g, np.tile(np.arange(20.0), (20, 1))), g), g, "slope")
    assert np.allclose(s[1:-1, 1:-1], want)


def test_slope_of_nothing_is_null(spark):
    g = square(5)
    assert focal.slope_horn(layer(spark, g, [None] * 25), g).where("slope is not null").count() == 0


def test_focal_share_replicates_edges(spark):
    g = square(6)
    cat = np.random.default_rng(1).integers(0, 7, (6, 6))
    out = focal.focal_share(layer(spark, g, cat.tolist(), "int"), g, value="v")
    pad = np.pad(cat, 2, mode="edge")
    for k in (1, 6):
        want = np.array([[(pad[r : r + 5, c : c + 5] == k).mean() for c in range(6)] for r in range(6)])
        assert np.allclose(as_array(out, g, f"nbr_{k}"), want)


def test_index_needs_the_offset(spark):
    row = spark.createDataFrame([(8016.0, 18525.0)], "red double, nir double")
    red, nir = (scalar.scaled(F.col(c), 2.75e-5, -0.2) for c in ("red", "nir"))
    assert row.select(scalar.normalized_difference(nir, red)).first()[0] == pytest.approx(0.8761, abs=1e-4)
    assert row.select(scalar.normalized_difference(F.col("nir"), -F.col("nir"))).first()[0] is None


def test_reclassify_codes(spark):
    codes = [3.0, 15.0, 24.0, 33.0, 0.0, 27.0, -9999.0, 300.0, 3.7, None]
    rows = spark.createDataFrame([(c,) for c in codes], "code double")
    got = [r[0] for r in rows.select(scalar.reclassify(F.col("code"), scalar.reclass_table(derived.RECLASS))).collect()]
    assert got == [1, 3, 5, 6, 0, 0, 0, 0, 1, 0]


def test_masks_and_bits(spark):
    rows = spark.createDataFrame([(0, -1.0), (30, 45.0), (33, 46.0)], "bits int, v double")
    got = rows.select(scalar.clear_of(F.col("bits"), (1, 2, 3, 4)), scalar.in_range(F.col("v"), 0, 45), scalar.from_sentinel(F.col("v"), 46)).collect()
    assert [tuple(r) for r in got] == [(True, None, -1.0), (False, 45.0, 45.0), (True, None, None)]


def test_kappa_of_a_known_table(spark):
    cm = spark.createDataFrame([(1, 1, 20), (1, 2, 5), (2, 1, 10), (2, 2, 15)], "ref int, sim int, n long")
    assert metrics.overall(cm).first()["kappa"] == pytest.approx(0.4)


def test_disagreement_adds_up_to_error(spark):
    rng = np.random.default_rng(0)
    ref = rng.integers(1, 7, 5000)
    sim = np.where(rng.random(5000) < 0.7, ref, rng.integers(1, 7, 5000))
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ref, sim)], "a int, b int")
    o = metrics.overall(metrics.confusion(rows, "a", "b")).first()
    assert o["quantity"] + o["allocation"] == pytest.approx(1 - o["accuracy"])
    same = metrics.overall(metrics.confusion(rows, "a", "a")).first()
    assert same["kappa"] == pytest.approx(1) and same["quantity"] == 0 and same["allocation"] == pytest.approx(0)


def test_merit_of_six_cells(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 1, 1, 2, 2], [1, 3, 3, 1, 2, 4], [1, 3, 2, 3, 2, 2])), "t0 int, ref int, sim int")
    m = metrics.merit(rows, "t0", "ref", "sim").first()
    assert tuple(m)[:5] == (1, 1, 1, 1, 0.25)
    assert metrics.merit(rows, "t0", "t0", "t0").first()["merit"] is None


def test_allocation_meets_quotas_and_freezes_moved_cells(spark):
    up = [i / 10 for i in range(10)]
    rows = [(i, 1, 1, False, [0.0, 0.0, up[i], 1 - up[i], 0.0, 0.0]) for i in range(10)]
    cells = spark.createDataFrame(rows, "cell_id long, c0 int, cur int, moved boolean, prob array<double>")
    quotas = spark.createDataFrame([(1, 3, 2), (1, 4, 2)], "c0 int, c1 int, q long")
    half = allocate.allocate(cells, quotas, 0.5)
    left = allocate.left_over(cells, half, quotas)
    assert {(r["c1"], r["q"]) for r in left.collect()} == {(3, 1), (4, 1)}
    last = allocate.allocate(half, left, 1.0)
    got = {r["cell_id"]: r["cur"] for r in last.where("moved").collect()}
    assert got == {8: 3, 9: 3, 0: 4, 1: 4}
    assert all(r["q"] == 0 for r in allocate.left_over(half, last, left).collect())


@pytest.mark.parametrize("few", [20_000, 25, 3])
def test_allocation_equals_the_sequential_order(spark, few):
    rng = np.random.default_rng(5)
    c0, prob = rng.integers(1, 5, 120), np.round(rng.random((120, 6)), 1)
    q = rng.integers(0, 30, (6, 6))
    cur, moved, share = c0.copy(), np.zeros(120, bool), 0.5
    for i in range(1, 5):
        for j in sorted((j for j in range(1, 7) if j != i), key=lambda j: (q[i - 1, j - 1], j)):
            take = min(math.ceil(q[i - 1, j - 1] * share), q[i - 1, j - 1])
            cand = sorted(np.flatnonzero((c0 == i) & ~moved), key=lambda x: (-prob[x, j - 1], x))[:take]
            cur[cand], moved[cand] = j, True
    cells = spark.createDataFrame([(k, int(c0[k]), int(c0[k]), False, prob[k].tolist()) for k in range(120)], "cell_id long, c0 int, cur int, moved boolean, prob array<double>")
    quotas = spark.createDataFrame([(i + 1, j + 1, int(q[i, j])) for i in range(6) for j in range(6)], "c0 int, c1 int, q long")
    got = {r["cell_id"]: r["cur"] for r in allocate.allocate(cells, quotas, share, few).collect()}
    assert [got[k] for k in range(120)] == cur.tolist()


def test_markov_rows_and_priors(spark):
    counts = spark.createDataFrame([(i, j, 91 if i == j else 1) for i in range(1, 7) for j in range(1, 7)], "c0 int, c1 int, n long")
    m = markov.markov_matrix(counts, (5, 6)).collect()
    for i in range(1, 7):
        assert sum(r["p"] for r in m if r["c0"] == i) == pytest.approx(1)
    assert all(r["p"] == (r["c1"] == r["c0"]) for r in m if r["c0"] in (5, 6))
    w = counts.select("c0", "c1", F.when((F.col("c0") == 1) & (F.col("c1") == 2), 0.1).otherwise(1.0).alias("w"))
    p = spark.createDataFrame([(1, [1 / 6] * 6), (2, [1 / 6] * 6), (3, [0.0] * 6)], "c0 int, prob array<double>")
    got = {r["c0"]: r["prob"] for r in sampling.correct_priors(p, w).collect()}
    assert sum(got[1]) == pytest.approx(1) and got[1][1] < got[1][0] and got[2][1] == pytest.approx(1 / 6) and got[3] == [0.0] * 6


def test_measures_of_a_table_worked_by_hand(spark):
    cm = spark.createDataFrame([(i, j, n) for i, row in enumerate([[50, 2, 3], [4, 30, 1], [0, 5, 5]], 1) for j, n in enumerate(row, 1)], "ref int, sim int, n long")
    o = metrics.overall(cm).first()
    assert o["accuracy"] == pytest.approx(0.85) and o["quantity"] == pytest.approx(0.02) and o["allocation"] == pytest.approx(0.13)


def plain_costs(cost, width, start):
    """Bellman-Ford over all cells."""
    best = {i: 0.0 if i in start else math.inf for i in range(len(cost))}
    changed = True
    while changed:
        changed = False
        for i in range(len(cost)):
            for dr, dc, n in costpath.MOVES:
                r, c = i // width + dr, i % width + dc
                if 0 <= r < len(cost) // width and 0 <= c < width:
                    new = best[r * width + c] + (cost[i] + cost[r * width + c]) / 2 * n
                    if new < best[i] - 1e-9:
                        best[i], changed = new, True
    return best


@pytest.mark.parametrize("size", [256, 4, 3])
def test_cost_paths_by_tiles_equal_brute_force(spark, size):
    g = Grid("local", 30.0, 0.0, 0.0, 9, 8)
    cost = np.random.default_rng(2).integers(1, 100, 72).astype(float)
    rows = layer(spark, g, cost).withColumnRenamed("v", "cost")
    nodes = spark.createDataFrame([(0, 1), (1, 1), (71, 2), (35, 3)], "cell_id long, uc_id int")
    total = costpath.cost_from_nodes(rows, nodes, g, size)
    got = {(r["uc_id"], r["cell_id"]): r["total"] for r in total.collect()}
    want = {(u, i): d for u, start in ((1, {0, 1}), (2, {71}), (3, {35})) for i, d in plain_costs(cost, 9, start).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    found = costpath.links(costpath.traced(total, costpath.cheapest_pairs(total, nodes), g, size), nodes, g.res).collect()
    assert {(r["uc_a"], r["uc_b"]) for r in found} == {(1, 2), (1, 3), (2, 3)}
    for link in found:
        path, own = link["path"], {1: {0, 1}, 2: {71}, 3: {35}}
        assert path[0] in own[link["uc_a"]] and path[-1] in own[link["uc_b"]]
        assert all(max(abs(x // 9 - y // 9), abs(x % 9 - y % 9)) == 1 for x, y in zip(path, path[1:]))
        walked = sum((cost[x] + cost[y]) / 2 * (math.sqrt(2) if abs(x // 9 - y // 9) + abs(x % 9 - y % 9) == 2 else 1) for x, y in zip(path, path[1:]))
        assert walked == pytest.approx(link["cost"], abs=1e-5)
        third = {u for u in own if u not in (link["uc_a"], link["uc_b"]) and own[u] & set(path)}
        assert link["direct"] == (not third) and link["crosses"] == ",".join(map(str, sorted(third)))


def test_a_later_map_is_held_against_reference_corridors(spark):
    g = Grid("local", 100.0, 0.0, 0.0, 12, 5)
    owners = spark.createDataFrame([(r * 12 + c, u) for r in range(1, 4) for u, cols in ((1, (0, 1)), (2, (6,)), (3, (10, 11))) for c in cols], "cell_id long, uc_id int")
    names = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "uc_id int, nome string")
    first = np.where(np.arange(60) // 12 == 2, 1, 3)
    for r in (1, 2, 3):
        first[[r * 12 + c for c in (0, 1, 6, 10, 11)]] = 1
    second = first.copy()
    second[[24 + 3, 24 + 4]] = 3  # a gap between A and B
    second[[r * 12 + c for r in (1, 2, 3) for c in (10, 11)]] = 4  # C is no node any more
    table = {1: 1, 3: 50, 4: 90}
    maps = [layer(spark, g, m.astype(float)).select("cell_id", F.col("v").cast("int").alias("cat")) for m in (first, second)]
    one = costpath.evaluate(maps[0], owners, g, table, names=names, min_ha=2, size=4)
    rows = {(r["uc_a"], r["uc_b"]): r for r in one.links.collect()}
    assert set(rows) == {(1, 2), (2, 3)}  # 1 to 3 leads through 2
    assert rows[1, 2]["name_a"] == "A" and rows[1, 2]["name_b"] == "B" and rows[1, 2]["exists"] and not rows[1, 2]["contiguous"]
    assert rows[1, 2]["cost"] == 5 and rows[1, 2]["length_km"] == pytest.approx(0.6)
    assert tuple(one.info.first()) == (3, 3, 2) and one.all_links.count() == 3
    ref = one.reference()
    later = costpath.evaluate(maps[1], owners, g, table, names=names, ref=ref, min_ha=2, size=4)
    got = {(r["uc_a"], r["uc_b"]): r for r in later.links.collect()}
    assert set(got) == {(1, 2), (2, 3)} and got[1, 2]["exists"] and not got[2, 3]["exists"] and not got[2, 3]["direct"] and got[2, 3]["cost"] is None
    held = {p: {r["cell_id"] for r in ref.corridors.where(f"uc_a = {p[0]} and uc_b = {p[1]}").collect()} for p in got}
    for p, r in got.items():
        natural = {c for c in held[p] if first[c] in (1, 2)}
        lost = {c for c in natural if second[c] not in (1, 2)}
        assert r["natural_ref_ha"] == pytest.approx(len(natural)) and r["natural_lost_ha"] == pytest.approx(len(lost)) and r["forest_lost_ha"] == pytest.approx(len(lost))
        assert r["rupture_pct"] == pytest.approx(100 * len(lost) / len(natural))
    assert got[1, 2]["cost_ref"] == 5 and got[1, 2]["cost_delta_pct"] == pytest.approx(100 * (got[1, 2]["cost"] / 5 - 1)) and got[1, 2]["cost"] > 50
    s = costpath.horizon_summary(later.links.withColumn("scenario", F.lit("x")).withColumn("year", F.lit(2030))).first()
    assert (s["nodes"], s["links_ref"], s["links_existing"], s["links_direct"]) == (2, 2, 1, 1) and s["mean_cost_delta_pct"] == pytest.approx(got[1, 2]["cost_delta_pct"])


def test_decade_of_net_and_not_gross_loss(spark):
    rows = [(1990, 1, 3, 50), (1990, 3, 1, 48), (1990, 1, 1, 100), (1995, 1, 3, 50), (1995, 3, 1, 48), (1995, 1, 1, 98), (2000, 1, 3, 20), (2000, 1, 1, 126), (2005, 1, 4, 20), (2005, 1, 1, 106)]
    counts = spark.createDataFrame(rows, "period int, c0 int, c1 int, n long")
    r = markov.decade_argmax(counts).first()
    assert (r["loss_period"], r["loss"]) == (2000, 40)  # 146 - 106; by gross loss 1990 would win with 100
    assert (r["gain_period"], r["gain"]) == (2000, 20)
    assert simulate.demand(counts, "pressure", ()).where("c0 = 1 and c1 = 4").first()["p"] == pytest.approx(20 / (146 + 126))


def test_cutoffs_narrow_down_ties(spark):
    rng = np.random.default_rng(1)
    p = np.r_[np.full(300, 0.25), np.round(rng.random(300), 3)]
    rows = spark.createDataFrame([(1 + i % 2, float(x), i) for i, x in enumerate(p)], "c0 int, p double, cell_id long")
    for few in (20_000, 10):
        got = allocate.cutoffs(rows, {1: 250, 2: 7}, bins=16, few=few)
        for c0, n in ((1, 250), (2, 7)):
            assert got[c0] == sorted(((float(x), i) for i, x in enumerate(p) if 1 + i % 2 == c0), key=lambda z: (-z[0], z[1]))[n - 1]
    assert allocate.cutoffs(rows, {1: 1000}) == {1: None}


def test_fill_level_of_cells_without_observation(spark):
    obs = spark.createDataFrame([(1, 2000, 5.0), (2, 2000, None), (3, 2003, 1.0)], "cell_id long, year int, v double")
    got = {(r["cell_id"], r["year"]): (r["v"], r["level"]) for r in temporal.gap_filled(obs, [2000, 2003], [(0, 0), (-1, 1)], 2003, ["v"], "v", spark.range(1, 5).withColumnRenamed("id", "cell_id")).collect()}
    assert got == {(1, 2000): (5.0, 0), (1, 2003): (None, 255), (2, 2000): (None, 255), (2, 2003): (None, 255), (3, 2000): (None, 255), (3, 2003): (1.0, 0), (4, 2000): (None, 255), (4, 2003): (None, 255)}


def plain_step(cat, width, prob_of, weights, matrix, iterations=3):
    """One step of the automaton, cell by cell; prob_of(map) -> class probabilities of all cells."""
    n0 = {k: int((cat == k).sum()) for k in range(1, 7)}
    quota = {(i, j): 0 if i == j else round(n0[i] * matrix[i - 1][j - 1]) for i in range(1, 7) for j in range(1, 7)}
    cur, moved = cat.copy(), np.zeros(len(cat), bool)
    free = (cat > 0) & (cat != 5) & (cat != 6)
    for it in range(iterations):
        prob = prob_of(cur)
        for i in (1, 2, 3, 4):
            q = prob[:, :] * np.array(weights[i - 1])
            q = q / np.where(q.sum(1, keepdims=True) > 0, q.sum(1, keepdims=True), 1)
            for j in sorted((j for j in range(1, 7) if j != i), key=lambda j: (quota[i, j], j)):
                take = min(math.ceil(quota[i, j] / (iterations - it)), quota[i, j])
                got = sorted(np.flatnonzero(free & (cat == i) & ~moved), key=lambda x: (-q[x, j - 1], x))[:take]
                cur[got], moved[got] = j, True
                quota[i, j] -= len(got)
    return cur


def test_a_step_of_the_automaton_equals_plain_loops(spark):
    g, rng = Grid("local", 30.0, 0.0, 0.0, 12, 10), np.random.default_rng(3)
    cat = rng.integers(0, 7, 120)
    matrix = rng.random((6, 6)) * 0.2
    weights = rng.integers(1, 9, (6, 6)).astype(float)
    stored = rng.random(120)
    names = ["nbr_1", "oh_3", "dist_urban", "v"]
    model = [[0.1 * k, 0.7 * (k % 3), 0.4 * (k % 2), -0.004 * k, 0.9 * (k % 4)] for k in range(6)]

    def prob_of(now):
        m = now.reshape(10, 12)
        pad = np.pad(m, 2, mode="edge")
        nbr = np.array([(pad[r : r + 5, c : c + 5] == 1).mean() for r in range(10) for c in range(12)])
        urban = np.argwhere(m == 5)
        dist = np.array([30 * np.sqrt(((urban - (r, c)) ** 2).sum(1).min()) for r in range(10) for c in range(12)])
        x = np.stack([nbr, (now == 3).astype(float), dist, stored], axis=1)
        e = np.exp(np.array([[row[0] + sum(w * v for w, v in zip(row[1:], z)) for row in model] for z in x]))
        return e / e.sum(1, keepdims=True)

    want = plain_step(cat.astype(int), 12, prob_of, weights, matrix)
    frame = lambda m, c: spark.createDataFrame([(i + 1, j + 1, float(m[i][j])) for i in range(6) for j in range(6)], f"c0 int, c1 int, {c} double")
    cells = layer(spark, g, cat.astype(float)).select("cell_id", F.col("v").cast("int").alias("cat"))
    v = spark.createDataFrame([(i, float(x)) for i, x in enumerate(stored)], "cell_id long, v double")
    score = lambda rows: rows.withColumn("prob", mlp.linear_softmax(names, model))
    got = simulate.simulate_step(cells, g, score, frame(weights, "w"), frame(matrix, "p"), names=names, stored=v, recompute=True)
    assert [r["cat"] for r in got.orderBy("cell_id").collect()] == want.tolist()
    areas, maps = simulate.project(cells, g, score, frame(weights, "w"), {"trend": frame(matrix, "p")}, 2025, [2030], names=names, stored=v)
    rows = {r["year"]: r for r in areas.collect()}
    assert set(rows) == {2025, 2030} and rows[2025]["class_5"] == pytest.approx((cat == 5).sum() * g.cell_ha) and rows[2030]["class_5"] == pytest.approx((want == 5).sum() * g.cell_ha)
    assert set(maps) == {("trend", 2025), ("trend", 2030)}


def test_polygons(spark):
    ring = [(0.0, 0.0), (60.0, 0.0), (60.0, 45.0), (0.0, 45.0)]
    shapes = spark.createDataFrame([(1, ring), (2, None), (3, [(1.0, 1.0)])], f"id int, ring {vector.RING}")
    g = Grid("local", 30.0, 0.0, 90.0, 3, 3)
    assert shapes.where("id = 1").select(vector.area(F.col("ring"))).first()[0] == 2700
    assert sorted(r["cell_id"] for r in vector.rasterize(shapes, g).collect()) == [6, 7]
    assert sorted(r["cell_id"] for r in vector.rasterize(shapes, g, touched=True).collect()) == [3, 4, 5, 6, 7, 8]
    assert vector.usable(shapes).count() == 1


def test_network_learns_and_survives_a_save(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 0.5)
    rows = [(i, *map(float, x[i]), int(y[i]) + 1, ("train", "val", "test")[i % 3]) for i in range(600)]
    samples = spark.createDataFrame(rows, "cell_id long, a double, b double, c double, c1 int, split string")
    net = mlp.train(samples, ["a", "b", "c"], epochs=60, rate=0.01, batch=64, drop=0.1)
    net.save(spark, f"{tmp_path}/net")
    scored = mlp.score(samples.where("split = 'test'"), ["a", "b", "c"], mlp.Network.load(spark, f"{tmp_path}/net"))
    hit = scored.select(F.avg((scalar.argmax(F.col("prob")) == F.col("c1")).cast("double"))).first()[0]
    assert hit > 0.85 and net.history[0]["val_loss"] > min(h["val_loss"] for h in net.history)
    gain = {r["name"]: r["gain"] for r in mlp.importance(samples, ["a", "c"], mlp.train(samples, ["a", "c"], epochs=30, rate=0.01, batch=64)).collect()}
    assert gain["c"] > 0 and gain["a"] > 0


def test_simulated_step_moves_its_quotas(spark):
    g = square(8)
    cat = np.random.default_rng(3).integers(0, 7, (8, 8))
    cells = layer(spark, g, cat.tolist(), "int").withColumnRenamed("v", "cat")
    counts = spark.createDataFrame([(i, j, 8 if i == j else 1) for i in range(1, 7) for j in range(1, 7)], "c0 int, c1 int, n long")
    matrix = markov.markov_matrix(counts)
    w = counts.select("c0", "c1", F.lit(1.0).alias("w"))
    names = ["nbr_1", "dist_urban"]
    model = lambda rows: rows.withColumn("prob", mlp.linear_softmax(names, [[0.1 * k, 0.5, -0.01 * k] for k in range(6)]))
    out = as_array(simulate.simulate_step(cells, g, model, w, matrix, names=names, recompute=True), g, "cat").astype(int)
    for i in range(1, 7):
        for j in range(1, 7):
            n = (cat == i).sum()
            want = 0 if i == j or i in (5, 6) else round(n * 1 / 13)
            if i != j:
                assert ((cat == i) & (out == j)).sum() == want
    assert (out[cat == 0] == 0).all()


def test_scalers_skip_nulls_and_use_train_rows(spark):
    rows = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (None, "train"), (100.0, "test")], "a double, split string")
    s = sampling.scaler(rows, ["a"]).first()
    assert tuple(s) == ("a", 2.0, 1.0, 2.0)
    assert sorted(r["a"] for r in sampling.standardize(rows, sampling.scaler(rows, ["a"]), ["a"]).collect()) == [-1.0, 0.0, 1.0, 98.0]


def test_gap_filling_takes_the_first_window(spark):
    obs = spark.createDataFrame([(1, 2000, None), (1, 1999, 4.0), (1, 2001, 8.0), (2, 2000, 5.0), (3, 1990, 1.0)], "cell_id long, year int, v double")
    got = {r["cell_id"]: (r["v"], r["level"]) for r in temporal.gap_filled(obs, [2000], [(0, 0), (-2, 0), (-4, 2)], 2001, ["v"], "v").collect()}
    assert got == {1: (4.0, 1), 2: (5.0, 0), 3: (None, 255)}


def test_quality_gates(spark):
    g = square(2)
    good, bad = layer(spark, g, [[1.0, 2.0], [3.0, None]]), layer(spark, g, [[1.0, -9999.0], [3.0, 4.0]])
    assert quality.alignment({"a": (g, good)}, g) == []
    with pytest.raises(quality.QualityError):
        quality.require(quality.alignment({"b": (g, bad)}, g))
    stack = spark.createDataFrame([(2000,), (2002,)], "year int")
    assert quality.missing_years(stack, [2000, 2001, 2002]) == ["stack: no year 2001"] and quality.band_count(stack, 3)
