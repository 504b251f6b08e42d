"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import components, roots, salted_join, written

#: Rows of a tile, about: the rows of a label come in tiles along the first projection.
TILE = 4096
#: Bins of the first projection's histogram, from which tiles are cut.
BINS = 4096


def projections(dim: int, n: int, seed: int = 7) -> np.ndarray:
    """n unit directions of `dim` components, orthogonal as far as there are dimensions."""
    rng = np.random.default_rng(seed)
    blocks = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-n // dim))]
    return np.concatenate(blocks, axis=1)[:, :n]


def calibrate(dim: int, cosine: float, n: int, miss: float) -> tuple[float, float, int]:
    """(reach of a tile, window half width, least collisions) for pairs at the threshold.

    The gap of such a pair along a random direction has standard deviation s = sqrt(2 - 2 cosine) / sqrt(dim), about
    normal. A window of 2.5 s holds it with probability p, so the count of n windows is binomial; the least
    count is the largest whose chance to miss is below `miss`. Tiles further apart than 4.5 s, or than the whole gap if
    that is smaller (then nothing can be missed), do not meet. Closer pairs collide more often.
    """
    gap = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-12
    s = gap / math.sqrt(dim)
    window = min(gap, 2.5 * s)
    p = 1.0 if window == gap else math.erf(2.5 / math.sqrt(2))
    tail, least = 0.0, 0
    for k in range(n):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > miss:
            break
        least = k + 1
    return min(gap, 4.5 * s), window, n if p == 1.0 else least


def unit(batch: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of the usable vectors, and those vectors in double precision with norm 1."""
    at, out = [], []
    for i, x in enumerate(batch):
        if x is None or not len(x):
            continue
        v = np.array([np.nan if c is None else c for c in x], float) if getattr(x, "dtype", None) == object or isinstance(x, list) else np.asarray(x, float)
        top = np.abs(v).max()
        if np.isfinite(v).all() and top > 0:
            v = v / top
            at.append(i)
            out.append(v / math.sqrt(float(v @ v)))
    return np.array(at, int), out


def _placed(cosine: float, n: int, miss: float, seed: int):
    """Each usable vector with its length, its place along the first projection as a bin, and the bins that a tile reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            at, vectors = unit(x["embedding"])
            dims = np.array([len(v) for v in vectors], int)
            bins, reach = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                place = np.stack([vectors[i] for i in mine]) @ projections(dim, n, seed)[:, 0]
                bins[mine] = np.floor((place + 1) * (BINS / 2))
                reach[mine] = math.ceil(calibrate(dim, cosine, n, miss)[0] * BINS / 2) + 1
            yield x.iloc[at].assign(dim=dims, bin=bins, reach=reach)

    return run


def pairs(a: np.ndarray, b: np.ndarray, cosine: float, directions: np.ndarray, reach: float, window: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of unit vectors a[i], b[j] at `cosine` or more, in blocks of i.

    Every projection of b is sorted, and the window around a query's own projection is a range of ranks, found by
    binary search. A pair collides where the rank lies in the range; its collisions are counted over the projections.
    Pairs out of more windows than n - least, or out of reach on the first projection, are dropped as they fall behind, the rest are verified.
    """
    ahead, behind = a @ directions[:, 0], directions.shape[1] - least
    rows = np.argsort(ahead, kind="stable")  # queries of a block are neighbours, so their first windows overlap
    cols = np.argsort(b @ directions[:, 0], kind="stable")
    pa, pb = a[rows] @ directions, b[cols] @ directions
    n = directions.shape[1]
    rank, low, wide = np.empty((n, len(b)), np.uint16), np.empty((n, len(a)), np.uint16), np.empty((n, len(a)), np.uint16)
    for k in range(n):
        order = np.argsort(pb[:, k], kind="stable")
        rank[k, order] = np.arange(len(b))
        lo, hi = (np.searchsorted(pb[order, k], pa[:, k] + d, side) for d, side in ((-window, "left"), (window, "right")))
        low[k], wide[k] = lo, hi - lo
    for s in range(0, len(a), 256):
        block = slice(s, s + 256)
        first, last = np.searchsorted(pb[:, 0], [pa[block, 0].min() - reach, pa[block, 0].max() + reach])
        part = slice(first, last)
        missed = np.zeros((len(pa[block]), last - first), np.uint8)
        k = 0
        while k < min(n, behind + 4):  # until most pairs are out of reach, all at once; a rank below the range wraps round
            missed += (rank[k, part] - low[k, block, None]) >= wide[k, block, None]
            k += 1
        i, j = np.nonzero(missed <= behind)
        count = missed[i, j].astype(int)
        j, i = j + first, i + s
        while k < n and len(i):
            count = count + ((rank[k, j] - low[k, i]) >= wide[k, i])
            keep = count <= behind
            i, j, count = i[keep], j[keep], count[keep]
            k += 1
        i, j = rows[i], cols[j]
        for t in range(0, len(i), 1 << 16):
            p, q = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
            keep = np.einsum("ij,ij->i", a[p], b[q]) >= cosine
            yield p[keep], q[keep]


def near_duplicates(
    vectors: DataFrame,
    *,
    cosine: float = 0.98,
    n_projections: int = 24,
    miss: float = 1e-4,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one non-null label (and length) link at `cosine` or more, in double precision. Null, zero and
    non-finite vectors, vectors with a null component and rows with a null label link with nothing: n_links 0,
    component_id their own id. Equal vectors of a label are one class, of its smallest id and size; links
    between classes count size by size and copies count each other. Rows that repeat an id are vectors of
    their own. A row with a null id links with nothing. An empty table gives no rows. Other columns are not carried.

    The classes of a label are cut into tiles of about TILE rows along the first projection, and only tiles within the
    reach of a pair at the threshold meet; vectors travel as they are. A task returns a row per linked class (its link count and forest root), never the pairs.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    keys = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    able &= ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    able &= F.exists("embedding", lambda c: c != 0)
    able = F.coalesce(able, F.lit(False))
    ids = written(rows.select("vec_id", "label", *keys, able.alias("able")), "embed-ids")
    classes = ids.where("able").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("n"))
    classes = written(classes, "embed-classes")
    # A class's vector is read from its smallest row; rows that repeat id and vector come once.
    mine = rows.where(able).select("*", *keys).join(classes, ["label", "k1", "k2"]).where("vec_id = cid")
    # classes that differ only by id clash (one id, two vectors) are told apart by their key
    mine = mine.select("label", F.xxhash64("label", "k1", "k2").alias("key"), "n", "embedding").dropDuplicates(["key"])
    named = mine.select("label", F.col("key").alias("cid"), "n", "embedding")
    vector, kind = rows.schema["embedding"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    placed = named.mapInPandas(_placed(cosine, n_projections, miss, seed), f"label {kind}, cid long, n long, embedding {vector}, dim int, bin long, reach long")
    placed = written(placed, "embed-rows")
    # Tiles are runs of bins; a bin above TILE rows is dealt into several.
    of = ["label", "dim"]
    before = F.sum("count").over(Window.partitionBy(*of).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = placed.groupBy(*of, "bin", "reach").count().select(*of, "bin", "reach", F.ceil(F.col("count") / TILE).alias("parts"), F.floor(F.coalesce(before, F.lit(0)) / TILE).alias("first"))
    bins = written(bins, "embed-bins")
    tiled = salted_join(placed, bins.drop("reach"), [*of, "bin"], "cid", salts=4)
    tiled = tiled.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts")))
    own = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("tile")
    tiles = bins.select(*of, "bin", "reach", own).groupBy(*of, "tile").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.max("reach").alias("reach"))
    tiles = written(tiles, "embed-tiles")
    other = tiles.select(*of, F.col("tile").alias("tb"), F.col("low").alias("from"), F.col("high").alias("upto"))
    met = tiles.join(other, of).where("tb >= tile and from - high <= reach and low - upto <= reach").select(*of, F.col("tile").alias("ta"), "tb")
    met = written(met, "embed-met")
    visits = met.select(*of, F.col("ta").alias("tile"), "ta", "tb").union(met.where("ta <> tb").select(*of, F.col("tb").alias("tile"), "ta", "tb"))
    tasks = tiled.join(visits, [*of, "tile"]).select(*of, "ta", "tb", "tile", "cid", "n", "embedding").groupBy(*of, "ta", "tb")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        cid, n = (x[c].to_numpy() for c in ("cid", "n"))
        alone = x["ta"].iloc[0] == x["tb"].iloc[0]
        mine = (x["tile"] == x["ta"]).to_numpy()
        a, b = np.flatnonzero(mine), np.arange(len(x)) if alone else np.flatnonzero(~mine)
        if not len(a) or not len(b):
            return pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
        dim = int(x["dim"].iloc[0])
        how = calibrate(dim, cosine, n_projections, miss)
        v = np.stack(unit(x["embedding"])[1])
        total = np.zeros(len(x), np.int64)
        p_all, q_all = [], []
        for i, j in pairs(v[a], v[b], cosine, projections(dim, n_projections, seed), *how):
            i, j = a[i], b[j]
            if alone:  # a pair is met from both sides
                keep = i < j
                i, j = i[keep], j[keep]
            np.add.at(total, i, n[j])
            np.add.at(total, j, n[i])
            node, root = roots(cid[i], cid[j])
            p_all.append(node)
            q_all.append(root)
        node, root = roots(np.concatenate(p_all), np.concatenate(q_all)) if p_all else (np.empty(0, np.int64),) * 2
        hit = total > 0
        out = pd.DataFrame({"cid": cid[hit], "links": total[hit]}).set_index("cid")["links"]
        return pd.DataFrame({"cid": node, "links": out.reindex(node).fillna(0).astype("int64").to_numpy(), "root": root})

    found = written(tasks.applyInPandas(run, "cid long, links long, root long"), "embed-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    reach = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.withColumn("key", F.xxhash64("label", "k1", "k2"))
    named = named.join(links, F.col("key") == links["cid"], "left").select("label", "k1", "k2", "key", classes["cid"].alias("low"), "n", "links")
    named = named.join(reach, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("component", "key"))
    named = written(named.select("label", "k1", "k2", "low", "root", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "embed-named")
    least_id = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(salted_join(named, least_id, ["root"], "k1").select("label", "k1", "k2", "n_links", "component_id"), "embed-components")
    yes = salted_join(ids.where("able"), named, ["label", "k1", "k2"], "vec_id").select("vec_id", "n_links", "component_id")
    no = ids.where("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return yes.union(no).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
