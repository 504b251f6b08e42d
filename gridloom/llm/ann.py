"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import written

#: Rows that one task searches, about: neighbouring leaves together, or a tile of a large one.
TILE = 4096


@dataclass
class Tree:
    """Node i has centre[i] and the children first[i] .. first[i] + n[i] - 1; a leaf has none and a leaf number."""

    centre: np.ndarray
    first: np.ndarray
    n: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.n == 0).sum())


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centre)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre, _nearest(x, centre)


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)


def fit(sample: np.ndarray, branches: int, leaf_rows: int, seed: int) -> Tree:
    """Splits the sample into `branches` by k-means, again and again, down to leaf_rows distinct vectors at most."""
    rng = np.random.default_rng(seed)
    centre, first, n = [sample.mean(axis=0)], [0], [0]
    todo = [(0, sample)]
    while todo:
        i, x = todo.pop(0)
        if len(x) <= leaf_rows:
            continue
        c, near = _kmeans(x, min(branches, len(x)), rng)
        used = np.unique(near)
        if len(used) < 2:
            continue
        first[i], n[i] = len(centre), len(used)
        for u in used:
            todo.append((len(centre), x[near == u]))
            centre.append(c[u])
            first.append(0)
            n.append(0)
    n = np.array(n)
    return Tree(np.array(centre), np.array(first), n, np.where(n == 0, np.cumsum(n == 0) - 1, -1))


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf number of each row: at each node the nearest child."""
    node = np.zeros(len(x), np.int64)
    while True:
        inner = np.unique(node[tree.n[node] > 0])
        if not len(inner):
            return tree.leaf[node]
        for i in inner:
            at = np.flatnonzero(node == i)
            node[at] = tree.first[i] + _nearest(x[at], tree.centre[tree.first[i] : tree.first[i] + tree.n[i]])


def best_bins(tree: Tree, q: np.ndarray, visits: int) -> list[int]:
    """Leaf numbers in the order of best-bin-first: the queue always gives the unopened branch whose centre is nearest."""
    gap = ((tree.centre - q) ** 2).sum(axis=1)
    queue, out = [(gap[0], 0)], []
    while queue and len(out) < visits:
        _, i = heapq.heappop(queue)
        while tree.n[i]:  # down to a leaf; the siblings wait in the queue
            children = range(tree.first[i], tree.first[i] + tree.n[i])
            best = min(children, key=gap.__getitem__)
            for c in children:
                if c != best:
                    heapq.heappush(queue, (gap[c], c))
            i = best
        out.append(int(tree.leaf[i]))
    return out


def usable(vector: str) -> Column:
    """The vector is not null, empty or zero, and has no null or non-finite component."""
    c = F.col(vector)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda v: v != 0), F.lit(False))


def _top(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of x to each row of q by exact distance, the query's own id aside; ties to the smaller id.

    Equal results of one id, as repeated rows give, count once.
    """
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    if (xid[1:] == xid[:-1]).any():
        same = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.sort(np.unique(np.stack([xid, same]), axis=1, return_index=True)[1])
        x, xid = x[order], xid[order]
    often = int(np.unique(xid, return_counts=True)[1].max())
    norm = (x**2).sum(axis=1)
    found = []
    m = min((k + 1) * often, len(x))  # of k + 1 ids at least; the query's own may be among them
    for s in range(0, len(q), 128):
        part = q[s : s + 128]
        rough = norm - 2 * part @ x.T
        slack = 1e-9 * (norm.max() + (part**2).sum(axis=1))
        edge = np.partition(rough, m - 1, axis=1)[:, m - 1]
        i, j = np.nonzero(rough <= (edge + slack)[:, None])  # rounding and ties: all rows that may be among the first
        keep = xid[j] != qid[s + i]
        i, j = i[keep], j[keep]
        d = np.sqrt(((x[j] - part[i]) ** 2).sum(axis=1))
        best = np.lexsort((xid[j], d, i))
        i, j, d = i[best], j[best], d[best]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (xid[j[1:]] != xid[j[:-1]]) | (d[1:] != d[:-1])
        i, j, d = i[new], j[new], d[new]
        first = np.searchsorted(i, i, "left")
        keep = np.arange(len(i)) - first < k
        found.append((qid[s + i[keep]], xid[j[keep]], d[keep]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))


def _merged(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """Brute force of a bounded set of queries: blocks of rows keep their k nearest, then the blocks' merge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield _top(q, ids, matrix(x["v"]), x["vec_id"].to_numpy(), k)

    return _merged(rows.mapInPandas(run, "query_id long, vec_id long, score double").distinct(), k).toPandas()


def search(
    vectors: DataFrame,
    *,
    k: int = 10,
    every: int = 100,
    branches: int = 8,
    leaf_rows: int = 96,
    sample_rows: int = 32_768,
    calibration: int = 64,
    recall: float = 0.95,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each row whose id is divisible by `every`.

    The tree is fitted on sample_rows rows at most (those of the smallest id hashes); every row is in a leaf.
    `calibration` queries at most, the smallest hashes again, are answered exactly against all rows; queries then visit as many leaves as
    hold `recall` of those answers. A task has a run of neighbouring leaves of about TILE rows, or a tile of a larger leaf, and the
    queries that visit some of them; it searches the visited leaves in full, so distances are exact and no leaf has a cap.

    Score is the Euclidean distance of the vectors as they are, in double precision; ties go to the smaller id.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no
    part. Vectors of another length than the most common are not comparable and take no part either. Rows that repeat an id are searched as rows of their
    own; equal results of one id come once. Fewer than k candidates: all of them. An empty table gives no
    rows. Other columns are not carried.
    """
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows, kind = rows.where(F.size("v") == common["n"]), rows.schema["v"].dataType.simpleString()
    tree = fit(np.unique(matrix(_first(rows, sample_rows, seed)["v"]), axis=0), branches, leaf_rows, seed)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield x.assign(leaf=descend(tree, matrix(x["v"])))

    placed = written(rows.mapInPandas(place, f"vec_id long, v {kind}, leaf long"), "ann-rows")
    queries = placed.where(F.col("vec_id") % every == 0)
    probe = _first(queries.select("vec_id", "v"), calibration, seed)
    if not len(probe):
        return rows.sparkSession.createDataFrame([], schema)
    visits = _visits(placed, tree, probe, k, recall)

    # One row per leaf, and sample_rows bounds the leaves: runs of leaves up to TILE rows share a task, a larger leaf has several.
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    group, tiles, at, held_rows = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0, 0
    for leaf in range(tree.leaves):
        n = sizes.get(leaf, 0)
        if held_rows and held_rows + n > TILE:
            at, held_rows = at + 1, 0
        group[leaf], tiles[leaf], held_rows = at, max(1, -(-n // TILE)), held_rows + n

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(i, v, g, t, b) for i, v in zip(x["vec_id"], x["v"]) for g, t, b in _tasks(best_bins(tree, np.asarray(v, float), visits), group, tiles)]
            yield pd.DataFrame(out, columns=["vec_id", "v", "in_group", "in_tile", "leaves"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            leaf = x["leaf"].to_numpy()
            yield x.assign(group=group[leaf], tile=x["turn"].to_numpy() % tiles[leaf]).drop(columns="turn")

    asked = queries.select("vec_id", "v").dropDuplicates(["vec_id", "v"]).mapInPandas(route, f"vec_id long, v {kind}, in_group long, in_tile long, leaves array<long>")
    held = placed.withColumn("turn", F.xxhash64("vec_id")).mapInPandas(deal, f"vec_id long, v {kind}, leaf long, group long, tile long")

    def scan(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})]
        if len(q) and len(x):
            qid, qv, xid, xv, leaf = q["vec_id"].to_numpy(), matrix(q["v"]), x["vec_id"].to_numpy(), matrix(x["v"]), x["leaf"].to_numpy()
            asks: dict[int, list[int]] = {}
            for i, leaves in enumerate(q["leaves"]):
                for b in leaves:
                    asks.setdefault(b, []).append(i)
            for b, i in asks.items():
                mine = leaf == b
                if mine.any():
                    found.append(_top(qv[i], qid[i], xv[mine], xid[mine], k))
        return _best(pd.concat(found, ignore_index=True), k)

    pair = asked.groupBy("in_group", "in_tile").cogroup(held.groupBy("group", "tile"))
    found = pair.applyInPandas(scan, "query_id long, vec_id long, score double")
    return _merged(found.distinct(), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(float)


def _tasks(leaves: list[int], group: np.ndarray, tiles: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """(group, tile, leaves) of the tasks that a visit to these leaves takes."""
    found: dict[tuple[int, int], list[int]] = {}
    for b in leaves:
        for t in range(tiles[b]):
            found.setdefault((int(group[b]), t), []).append(b)
    for (g, t), own in found.items():
        yield g, t, own


def _best(x: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each query's different (vec_id, score) rows."""
    x = x.drop_duplicates().sort_values(["query_id", "score", "vec_id"], ignore_index=True)
    return x[x.groupby("query_id").cumcount() < k]


def _first(rows: DataFrame, n: int, seed: int) -> pd.DataFrame:
    """The n ids of the smallest hashes with one vector each; copies are dropped before any row is collected."""
    turn = F.xxhash64("vec_id", F.lit(seed)).alias("turn")
    ids = rows.select("vec_id", turn).distinct().orderBy("turn", "vec_id").limit(n)
    last = ids.agg(F.max("turn").alias("turn")).first()["turn"]
    if last is None:
        return pd.DataFrame({"vec_id": [], "v": []})
    mine = rows.select("vec_id", turn, "v").where(F.col("turn") <= last).groupBy("turn", "vec_id").agg(F.min("v").alias("v"))
    return mine.orderBy("turn", "vec_id").limit(n).select("vec_id", "v").toPandas()


def _visits(placed: DataFrame, tree: Tree, probe: pd.DataFrame, k: int, recall: float) -> int:
    """Leaves to visit so that `recall` of the probes' exact answers lie in visited leaves."""
    exact = _exact(placed, probe["vec_id"].to_numpy(), matrix(probe["v"]), k)
    # probes x k rows: their leaves come by a join with a bounded broadcast
    spark = placed.sparkSession
    wanted = spark.createDataFrame(exact[["vec_id"]].drop_duplicates(), "vec_id long")
    leaf = placed.join(F.broadcast(wanted), "vec_id").groupBy("vec_id").agg(F.min("leaf").alias("leaf")).toPandas().set_index("vec_id")["leaf"]
    need = []
    for qid, v in zip(probe["vec_id"], probe["v"]):
        order = {b: i + 1 for i, b in enumerate(best_bins(tree, np.asarray(v, float), tree.leaves))}
        need += [order[leaf[x]] for x in exact.loc[exact["query_id"] == qid, "vec_id"]]
    return int(np.quantile(need, recall, method="higher")) if need else 1
