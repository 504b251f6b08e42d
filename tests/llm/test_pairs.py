"""Near-duplicates and nearest neighbours against brute force; skew, nulls, ties, empty tables, extra columns."""

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import ann, common, embed_dedup, simhash, similar


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    real = [e for e in edges if e[0] != e[1]]
    want = brute_components({x for e in real for x in e}, real)
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_range_rank(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 13)
    got = common.range_rank(rows, [F.col("k").asc_nulls_last(), F.col("id")]).collect()
    want = sorted(range(100), key=lambda i: (i % 13, i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == want


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(60)]
    out = [" ".join(w) for w in base]
    for w in base[:30]:
        v = list(w)
        v[rng.randrange(len(v))] = "X"
        out.append(" ".join(v).upper())
    out += [out[0]] * 40 + [None, "", " \t\n", "One", "ONE", "é É ü", "a\x0bb\x0cc\x1cd"]
    return out + [" ".join(base[1] * 300)]


def test_fingerprints_are_plain(spark):
    for t in texts():
        assert simhash.fingerprint(t) == plain_print(t)


@pytest.mark.parametrize("radius, tile", [(4, 2048), (4, 16), (7, 2048)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, radius, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = list(enumerate(texts(), 10))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("h", F.lit(1)).repartition(5)
    prints = {i: plain_print(t) for i, t in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= radius]
    want = brute_components(prints, links)
    got = simhash.near_duplicates(docs, radius=radius).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert {r["id"]: int(r["x"], 16) for r in simhash.near_duplicates(docs).select("id", simhash.hex64(F.col("fp")).alias("x")).collect()} == prints


def test_dense_near_copies_stay_one_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 64)
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in range(600)} | {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.near_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    un = lambda f: f % 2**64
    want = brute_components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if (un(a) ^ un(b)).bit_count() <= 4])
    assert all(got.get(f, f) == want[f] for f in fps)


def test_seed_masks_miss_no_pair():
    rng = random.Random(3)
    for n in (10, 10**6, 10**9):
        masks = simhash.seed_masks(n, 4)
        for _ in range(200):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not d & m for m in masks)


def test_keep_first_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f"), (3, "A B C D E F"), (3, "A B C D E F"), (None, "a b c d e f"), (7, None), (8, ""), (9, "other words entirely in this one"), (None, "only null id here now"), (9, "same id but a very different text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("root", "row", "key", "_k", "node")})
    got = similar.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(3, "A B C D E F"), (7, None), (9, "other words entirely in this one"), (0, "only null id here now"), (9, "same id but a very different text")])
    assert similar.keep_first(docs.limit(0)).count() == 0


def family(rng, word, n_bases, copies):
    texts, passage = [None, "", " ", "One", "ONE", "a b c d e"], [word() for _ in range(25)]
    for k in range(n_bases):
        base = [word() for _ in range(rng.randint(5, 150))] + passage * (k % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(copies if k == 1 else rng.randint(0, 4)):
            v = list(base)
            for _ in range(rng.randint(0, max(1, len(v) // 35))):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v * rng.randint(1, 2)).upper())
    rng.shuffle(texts)
    return texts


def shingle_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture
def many_partitions(spark):
    """Shuffles keep all their partitions, so that groups of equal keys are cut."""
    new = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_groups_cut_by_partitions_equal_brute_force(spark, many_partitions, monkeypatch):
    test_groups_at_four_fifths_equal_brute_force(spark, monkeypatch, 2048, 64)


def test_few_rows_make_few_files(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(similar, "NEAR", 4)  # so that there is a second round
    paths, discarded = [], []
    monkeypatch.setattr(common, "new_path", lambda s, name, f=common.new_path: paths.append(f(s, name)) or paths[-1])
    monkeypatch.setattr(similar, "discard", lambda *tables: discarded.extend(tables))
    rng = random.Random(5)
    texts = family(rng, lambda: "".join(rng.choice("abcdefgh") for _ in range(4)), 60, 90)
    similar.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)).count()
    count = {p.rpartition("/")[2].rpartition("-")[0]: len([f for f in os.listdir(p.removeprefix("file://")) if f.startswith("part-")]) for p in paths if os.path.isdir(p.removeprefix("file://"))}
    assert {"similar-nodes", "similar-pairs", "similar-first-texts", "similar-second-links", "edges"} <= set(count) and len(discarded) == 6
    assert max(count.values()) == 1, count


def test_rows_are_dealt_evenly_to_files(spark, monkeypatch):
    monkeypatch.setattr(common, "FILE_ROWS", 100)
    got = common.written(spark.range(0, 1000, 1, 30).where("id < 990"), "dealt", 990)
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 10 and min(sizes) > 50 and got.agg(F.sum("id")).first()[0] == 989 * 990 // 2


@pytest.mark.parametrize("tile, near", [(2048, 64), (16, 8), (2048, 2)])
def test_groups_at_four_fifths_equal_brute_force(spark, monkeypatch, tile, near):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "NEAR", near)
    rng = random.Random(5)
    texts = family(rng, lambda: "".join(rng.choice("abcdefgh") for _ in range(4)), 60, 90)
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = sorted(set(brute_components(range(len(sets)), links).values()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit(0)).repartition(4)
    got = similar.keep_first(docs, recall=1 - 1e-9)  # so that none is left to chance
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    hit = near = total = 0
    bits, bands, short_bands, radius = similar.calibrate(1_000_000, 0.8, 0.99)
    for _ in range(400):
        n = int(rng.integers(8, 300))
        m = -(-8 * n // 9)  # n and n shingles, m of them common: 0.8 or a little more
        h = rng.integers(0, 2**63, 2 * n - m).astype(np.uint64)
        p = np.stack([similar.majorities(h[:n], similar.PRINTS), similar.majorities(h[n - m :], similar.PRINTS)])
        keys = similar.band_keys(p, bits, short_bands if n < similar.SHORT else bands, 42)
        agree = (keys[0] == keys[1]).any()
        total, hit, near = total + 1, hit + agree, near + (agree and (int(p[0, 0]) ^ int(p[1, 0])).bit_count() <= radius)
    assert hit >= 0.95 * total and near >= 0.94 * total


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, 16))
    x = np.concatenate([c + 0.04 * rng.standard_normal((25, 16)) for c in centre] + [rng.standard_normal((120, 16))]).astype(np.float32)
    rows = [(int(i), v.tolist(), int(i) % 2) for i, v in enumerate(x)]
    n = len(rows)
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 16, [nan] * 16, [inf] + [0.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)]
    rows += [(n + 10, rows[0][1], None), (n + 11, rows[0][1], 0), (n + 12, [2 * c for c in rows[0][1]], 0), (n + 13, rows[0][1], 0), (n + 14, [1.0, 2.0], 0), (n + 14, [1.0, 2.0], 0)]
    return rows


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    rows = vectors()
    usable = lambda v: v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if usable(v) else None for _, v, _ in rows]
    links = {k: [] for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(len(rows)):
            u, v = unit[a], unit[b]
            if a != b and u is not None and v is not None and len(u) == len(v) and rows[a][2] == rows[b][2] is not None and u @ v >= 0.98:
                links[a].append(b)
    place = brute_components(range(len(rows)), [(a, b) for a in links for b in links[a]])
    ids = [r[0] for r in rows]
    low = {}
    for k, c in place.items():
        low[c] = min(low.get(c, ids[k]), ids[k])
    want = sorted((ids[k], len(links[k]), low[place[k]], ids[k] == low[place[k]]) for k in range(len(rows)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1)).withColumn("n", F.lit("x"))
    for tile in (2048, 32):
        monkeypatch.setattr(embed_dedup, "TILE", tile)
        assert sorted(tuple(r) for r in embed_dedup.near_duplicates(df).collect()) == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_collision_count_is_calibrated():
    half, window, least = embed_dedup.calibrate(64, 0.98, 24, 1e-4)
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o
    directions = embed_dedup.projections(64, 24)
    gap = np.abs((a - b) @ directions)
    assert ((gap <= window).sum(1) >= least).mean() > 0.999 and (gap[:, 0] <= half).mean() > 0.999
    found = {(int(i), int(j)) for x, y in embed_dedup.pairs(a, 1.0001 * b, 0.98, directions, half, window, least) for i, j in zip(x, y)}
    real = {(int(i), int(j)) for i, j in zip(*np.nonzero(a @ (1.0001 * b).T >= 0.98))}
    assert found <= real and len(found) >= 0.999 * len(real) and len(real) >= 4000


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((1500, 12)), np.tile(rng.standard_normal(12), (300, 1))]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1800, [0.0] * 12), (1900, None), (2000, [1.0, 2.0]), (None, x[0].tolist()), (1600, x[1600].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)).withColumn("tiles", F.lit(9))
    monkeypatch.setattr(ann, "TILE", 100)
    got = {}
    for r in ann.search(df, leaf_rows=40, sample_rows=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1800, 100))
    y, hit = x.astype(float), 0
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 11))
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        assert all(s == pytest.approx(d[v], abs=1e-12) and v != q for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        d[q] = np.inf
        hit += len({v for _, v, _ in found} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"]) for r in ann.search(few).collect()] == [(0, 1), (0, 2)]
    assert ann.search(df.limit(0)).count() == 0


def test_repeated_rows_take_no_neighbours_place(spark):
    x = np.random.default_rng(3).standard_normal((60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(3)] + [(0, (x[0] + 1e-3 * k).tolist()) for k in range(1, 15)]
    rows += [(7, (2 * x[0] - x[7]).tolist())]
    found = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for r in ann.search(df, every=30).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert sorted(found) == [0, 30] and all(len(set(v)) == 10 for v in found.values())
    want = sorted({(round(float(np.linalg.norm(np.array(v) - x[30])), 9), i) for i, v in rows if i != 30})[:10]
    assert [(round(s, 9), i) for s, i in found[30]] == want


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(0).standard_normal((900, 5))
    tree = ann.fit(x, 4, 30, 0)
    order = ann.best_bins(tree, x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and order[0] == ann.descend(tree, x[:1])[0]
    assert ann.fit(np.ones((1, 3)), 4, 30, 0).leaves == 1
