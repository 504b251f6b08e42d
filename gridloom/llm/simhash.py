"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, roots, salted_join, whole_groups, written

#: Reference fingerprints of a distance table, drawn from a fixed seed.
PIVOTS = 24
#: Hashes whose bits are unpacked at once.
HASHES = 1 << 16
#: Fingerprints of one comparison tile.
TILE = 2048


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle in order, A-Z lower-cased, repeats included; a shorter text is one, none gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(width, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], seed) for i, j in zip(first, last)), np.uint64, len(last))


def remixed(h: np.ndarray) -> np.ndarray:
    """Other hashes from hashes, for a fingerprint of its own."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def majorities(hashes: np.ndarray, n_prints: int = 1) -> np.ndarray:
    """Majority fingerprint of the hashes (none: zero), then those of the hashes remixed once, twice, ..."""
    ones, n = np.zeros((n_prints, 64), np.int64), len(hashes)
    for at in range(0, n, HASHES):
        h = hashes[at : at + HASHES]
        for p in range(n_prints):
            h = remixed(h) if p else h
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for k in range(0, len(bits), 255):  # so many bits fit a byte's sum
                ones[p] += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit majority fingerprint of the text's word shingles (A-Z lower-cased, repeats included)."""
    return int(majorities(shingle_hashes(text, width, seed))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) of each row; fp holds the unsigned fingerprint's bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = np.array([fingerprint(t, width, seed) for t in x["text"]], np.uint64)
            yield pd.DataFrame({"id": x["id"], "fp": found.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long")


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int16)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 2**64, n, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, radius: int, refs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i], b[j] at `radius` bits or fewer.

    Each side's table of distances to the references is built once. A pair whose distances to some reference
    differ by more than the radius is too far apart by the triangle inequality, so it is discarded; the
    survivors of all references are verified.
    """
    ta, tb = (np.stack([distance(x, p) for p in refs]) for x in (a, b))
    order = np.argsort(tb[0], kind="stable")  # the first reference's window is a slice of the sorted side
    low = np.searchsorted(tb[0][order], ta[0] - radius, "left")
    high = np.searchsorted(tb[0][order], ta[0] + radius, "right")
    for s in range(0, len(a), 512):
        n = (high - low)[s : s + 512]
        i = np.repeat(np.arange(s, s + len(n)), n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[s : s + 512], n)]
        for k in range(1, len(refs)):
            if len(i) < 64:
                break
            keep = np.abs(ta[k][i] - tb[k][j]) <= radius
            i, j = i[keep], j[keep]
        keep = distance(a[i], b[j]) <= radius
        yield i[keep], j[keep]


def seed_masks(n: int, radius: int, fill: int = 256) -> list[int]:
    """Bit masks such that fingerprints at `radius` bits or fewer agree on one mask at least.

    The bits are cut into k > radius blocks; radius differing bits leave k - radius blocks untouched. k is the
    smallest for which about `fill` of n spread fingerprints share a mask's value.
    """
    for k in range(radius + 1, 65):
        edges = [round(64 * i / k) for i in range(k + 1)]
        blocks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(k)]
        found = [sum(x) for x in itertools.combinations(blocks, k - radius)]
        if n <= fill * 2 ** min(m.bit_count() for m in found) or len(found) > 80:
            return found
    return found


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def near_fingerprints(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b) edges, both fp long, that connect exactly the distinct fingerprints (column fp) within `radius` bits.

    A distance to references restricted to some bits is 0 apart where those bits agree, so seed groups - equal
    values under one of seed_masks - hold every pair in range. A seed group above TILE rows is dealt
    into tiles and each pair of tiles is its own task row group. Within a task pivot distance tables discard and the survivors are
    verified; only a spanning forest of the links leaves it.
    """
    masks = seed_masks(prints.count(), radius)
    seeds = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.expr(f"fp & {_signed(x)}L").alias("v")) for m, x in enumerate(masks)]))
    keyed = prints.select("fp", seeds.alias("s")).select("fp", "s.*")
    groups = keyed.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1")
    groups = written(groups.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "simhash-groups")
    # A row goes to the tasks of all tile pairs that its tile is in; a group of one tile is one task.
    rows = salted_join(keyed, groups.select("m", "v", "tiles"), ["m", "v"], "fp", salts=4)
    rows = rows.withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("fp", "m", "v", "t", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"))
    return rows.repartition(*TASK).sortWithinPartitions(*TASK).mapInPandas(_searcher(radius), "a long, b long")


TASK = ["m", "v", "ta", "tb"]


def _searcher(radius: int):
    """Links within tasks; rows come sorted by task, and a task's rows may go over several batches."""
    refs = pivots()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, starts in whole_groups(batches, TASK):
            yield _search(x, starts, radius, refs)

    return run


def _search(x: pd.DataFrame, starts: np.ndarray, radius: int, refs: np.ndarray) -> pd.DataFrame:
    """Forest of the links of whole tasks."""
    fp = x["fp"].to_numpy(np.int64).view(np.uint64)
    t, ta, tb = (x[c].to_numpy() for c in ("t", "ta", "tb"))
    ends = np.r_[starts[1:], len(x)]
    low, high = [], []
    small = (ta[starts] == tb[starts]) & (ends - starts <= 64)
    for s, e in zip(starts[~small], ends[~small]):
        alone = ta[s] == tb[s]
        first = np.ones(e - s, bool) if alone else t[s:e] == ta[s]
        a, b = fp[s:e][first], fp[s:e] if alone else fp[s:e][~first]
        for i, j in linked(a, b, radius, refs) if len(a) and len(b) else ():
            node, root = roots(a[i], b[j])
            low.append(root[node != root])
            high.append(node[node != root])
    for size in np.unique((ends - starts)[small]):  # small tasks of one size are compared together
        block = fp[starts[small & (ends - starts == size)][:, None] + np.arange(size)]
        tables = [distance(block, p) for p in refs]
        for u in range(size - 1):
            g, w = np.nonzero(np.abs(tables[0][:, u + 1 :] - tables[0][:, u, None]) <= radius)
            for table in tables[1:]:
                if len(g) < 64:
                    break
                keep = np.abs(table[g, u] - table[g, u + 1 + w]) <= radius
                g, w = g[keep], w[keep]
            keep = distance(block[g, u], block[g, u + 1 + w]) <= radius
            low.append(block[g, u][keep])
            high.append(block[g, u + 1 + w][keep])
    a, b = roots(*(np.concatenate([*z, np.empty(0, np.uint64)]).view(np.int64) for z in (low, high)))
    return pd.DataFrame({"a": a[a != b], "b": b[a != b]})


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """Per row of docs: id, fp (long), component_id - the smallest id whose fingerprint is reachable in steps of `radius` bits or fewer.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other; texts
    shorter than a shingle hash as one. Texts are hashed whole, at any length. Rows that repeat an id or a text
    each get a row; equal fingerprints are one node. A null id names a component only where it has no other.
    An empty table gives no rows. Other columns are not carried.
    """
    rows = written(fingerprints(docs, id_col, text_col, width, seed), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    reach = components(near_fingerprints(nodes.select("fp"), radius))
    joined = written(nodes.join(reach, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(salted_join(joined, least, ["root"], "fp").select("fp", "component_id"), "simhash-named")
    return salted_join(rows, named, ["fp"], "id").select("id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
