"""SimHash near-duplicates at a Jaccard similarity of word shingles: fingerprints propose pairs, whole sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, discard, salted_join, trimmed, whole_groups, written
from gridloom.llm.simhash import distance, majorities, pivots, shingle_hashes

#: Fingerprints of a set: the first is compared, the bits of the others make the band keys.
PRINTS = 5
#: Neighbours in a band group's order that the first round looks at; larger groups go on to the second.
NEAR = 64
#: Rows of one comparison tile.
TILE = 2048
#: Bytes of the parity sketch: of all sets, and of large ones at most.
SKETCH, WIDE = 64, 4096
#: Slots of the bit map of wanted texts.
SLOTS = 1 << 24
#: Sets of fewer shingles flip more bits at one similarity, SHORT_BIT of them at most.
SHORT, SHORT_BIT = 16, 0.19


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    return np.unique(shingle_hashes(text, width, seed))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = 0.8) -> bool:
    """Jaccard similarity of two sets is `similarity` or more. Empty sets are alike."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def calibrate(n: int, similarity: float, recall: float) -> tuple[int, int, int, int]:
    """(bits of a band key, bands, bands of short sets, radius of the compared fingerprint) for n sets.

    Two sets at the threshold have majority vectors at cosine 2s / (1 + s) or more, so each bit differs with
    probability acos(.) / pi. Keys are as long as leaves about 16 unrelated sets in a group; there are as many bands as
    make one agree with probability `recall`. The radius is that of the last 1 in 1000 such pairs.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(48, max(8, round(math.log2(max(1, n))) - 4))
    bands = [1 if p == 0 else math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** bits)) for p in (differ, max(differ, SHORT_BIT))]
    radius, tail = 64, 0.0
    while radius and tail + math.comb(64, radius) * differ**radius * (1 - differ) ** (64 - radius) < 1e-3:
        tail += math.comb(64, radius) * differ**radius * (1 - differ) ** (64 - radius)
        radius -= 1
    return bits, bands[0], bands[1], radius


def band_keys(prints: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """(rows, bands) keys: `bits` bits each, drawn for every band from all prints but the first, and the band's number."""
    line = np.unpackbits(prints[:, 1:].astype("<u8").view(np.uint8), axis=1, bitorder="little")
    rng, out = np.random.default_rng(seed), np.empty((len(prints), bands), np.int64)
    for b in range(bands):
        pick = rng.choice(line.shape[1], bits, replace=False)
        out[:, b] = line[:, pick] @ (np.int64(1) << np.arange(bits)) + (b << 48)
    return out


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's slots, a power of two of them and two an element if possible: two sets' sketches, folded to
    one size, differ in no more bits than the sets in elements."""
    size = SKETCH
    while 4 * size < len(s) and size < WIDE:
        size *= 2
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % (8 * size), minlength=8 * size) & 1).astype(np.uint8).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def near(table: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (i, j) are in range: pivot coordinates further apart than the radius discard, the distance decides."""
    at = np.arange(len(i))
    for row in table:
        if len(at) < 64:
            break
        at = at[np.abs(row[i[at]] - row[j[at]]) <= radius]
    return at[distance(fp[i[at]], fp[j[at]]) <= radius]


def _first_round(similarity: float, radius: int):
    """Of each row the pair with the last earlier row of its group in range. What that leaves out goes to the second round:
    (key, node) of rows that have further pairs in range, and the key of a group of more than NEAR rows. The first and the last
    key of a partition are told, as a group may go over several partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, held, none = pivots(), pd.DataFrame(), np.empty(0, np.int64)
        for x in batches:
            if not len(x):
                continue
            old = len(held)
            if not old:
                yield pd.DataFrame({"a": x["key"].iloc[:1], "b": 0, "kind": "edge"})
            x = pd.concat([held, x], ignore_index=True)
            key, node, n = (x[c].to_numpy() for c in ("key", "node", "n"))
            fp = x["fp"].to_numpy(np.int64).view(np.uint64)
            table = np.stack([distance(fp, p) for p in refs])
            paired, pairs, over, hot = np.zeros(len(x), bool), [np.empty((2, 0), np.int64)], [none], none
            for d in range(1, NEAR + 1):
                i = np.arange(max(0, old - d), max(0, len(x) - d))
                i = i[key[i] == key[i + d]]
                if d == NEAR:
                    hot = np.unique(key[i])
                if d == NEAR or not len(i):
                    break
                i = i[(np.minimum(n[i], n[i + d]) >= similarity * np.maximum(n[i], n[i + d]) - 1e-9) & (node[i] != node[i + d])]
                i = i[near(table, fp, i, i + d, radius)]
                again = paired[i + d]
                over += [i[again], i[again] + d]
                i = i[~again]
                paired[i + d] = True
                pairs.append(np.sort(np.stack([node[i], node[i + d]]), axis=0))
            a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
            k, m = np.unique(np.stack([key, node])[:, np.concatenate(over)], axis=1)
            yield pd.DataFrame({"a": np.r_[a, k, hot], "b": np.r_[b, m, hot], "kind": np.repeat(["pair", "member", "group"], [len(a), len(k), len(hot)])})
            held = x.iloc[-NEAR:]
        if len(held):
            yield pd.DataFrame({"a": held["key"].iloc[-1:], "b": 1, "kind": "edge"})

    return run


def _second_round(similarity: float, radius: int):
    """Pairs of one tile pair that are not yet connected, as far as sizes, fingerprints and sketches allow them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs = pivots()
        for x, starts in whole_groups(batches, ["key", "ta", "tb"]):
            for i, j in zip(starts, [*starts[1:], len(x)]):
                yield from _tile(x.iloc[i:j], similarity, radius, refs)

    return run


def _tile(x: pd.DataFrame, similarity: float, radius: int, refs: np.ndarray) -> Iterator[pd.DataFrame]:
    alone = x["ta"].iloc[0] == x["tb"].iloc[0]
    x = x.sort_values("n", ignore_index=True)
    mine = np.arange(len(x)) if alone else np.flatnonzero(x["t"] == x["ta"])
    other = mine if alone else np.flatnonzero(x["t"] != x["ta"])
    if not len(mine) or not len(other) or x["root"].nunique() < 2:
        return
    node, n, root = (x[c].to_numpy() for c in ("node", "n", "root"))
    fp = x["fp"].to_numpy(np.int64).view(np.uint64)
    bits = np.stack([np.frombuffer(v, np.uint64) for v in x["small"]])
    table = np.stack([distance(fp, p) for p in refs])
    low = np.searchsorted(n[other], np.ceil(similarity * n[mine] - 1e-9), "left")
    high = np.searchsorted(n[other], np.floor(n[mine] / similarity + 1e-9), "right")
    for k, p in enumerate(mine):
        j = other[low[k] : high[k]]
        j = j[(root[j] != root[p]) & ((node[j] > node[p]) | (not alone))]
        j = j[near(table, fp, np.full(len(j), p), j, radius)]
        j = j[_allowed(np.bitwise_count(bits[j] ^ bits[p]).sum(axis=1, dtype=np.int64), n[j] + n[p], similarity)]
        if len(j):
            yield pd.DataFrame({"a": np.minimum(node[p], node[j]), "b": np.maximum(node[p], node[j])})


def _allowed(apart: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Sets of these sizes in sum at the similarity or more differ in (1 - s) / (1 + s) of them at most."""
    return apart * (1 + similarity) <= (1 - similarity) * sizes + 1e-9


def _confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, key: Column, text: Column, width: int, seed: int, similarity: float, name: str, rows: int) -> DataFrame:
    """The pairs of nodes (a, b) whose texts are similar. Only texts of some pair are moved. rows: see written()."""

    def plausible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            apart = []
            for a, b in zip(x["sketch_a"], x["sketch_b"]):
                size = min(len(a), len(b))
                apart.append(int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum(dtype=np.int64)))
            yield x.loc[_allowed(np.array(apart, np.int64), (x["n_a"] + x["n_b"]).to_numpy(), similarity), ["a", "b"]]

    wide = nodes.select("node", "n", "sketch")
    pairs = pairs.join(wide.toDF("a", "n_a", "sketch_a"), "a").join(wide.toDF("b", "n_b", "sketch_b"), "b")
    pairs = written(pairs.mapInPandas(plausible, "a long, b long"), f"{name}-plausible", rows)
    want = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    want = written(want.join(nodes.select("node", "k"), "node"), f"{name}-wanted", rows)
    # a bit map of fixed size says which texts may be wanted; the join decides
    slot = F.col("k").bitwiseAND(SLOTS - 1)
    words = want.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((k & {SLOTS - 1}) & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(SLOTS >> 6, np.int64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def wanted(k: pd.Series) -> pd.Series:
        at = k.to_numpy(np.int64) & (SLOTS - 1)
        return pd.Series((held.value[at >> 6] >> (at & 63) & 1).astype(bool))

    texts = docs.select(key.alias("k"), text.alias("text")).where(wanted("k")).join(want, "k")
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), f"{name}-texts", rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[int, np.ndarray] = {}
        size = 0
        for x in batches:
            keep = []
            for a, b, ta, tb in zip(x["a"], x["b"], x["text_a"], x["text_b"]):
                if size > 1 << 21:  # sixteen megabytes of hashes
                    sets, size = {}, 0
                for i, t in ((a, ta), (b, tb)):
                    if i not in sets:
                        sets[i] = shingles(t, width, seed)
                        size += len(sets[i]) + 16
                keep.append(similar(sets[a], sets[b], similarity))
            yield x.loc[keep, ["a", "b"]]

    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = written(both.select("a", "b", "text_a", "text_b").mapInPandas(trimmed(run), "a long, b long"), f"{name}-links", rows)
    discard(pairs, want, texts)
    return links


def keep_first(
    docs: DataFrame, *, similarity: float = 0.8, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42
) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest id (nulls last), then row hash.

    Groups are the connected components of the texts whose sets of `width`-word shingles have a Jaccard similarity of
    `similarity` or more. SimHash proposes the pairs: texts that agree on one of many draws of fingerprint bits (see
    calibrate(); at least `recall` of the pairs at the threshold, more above it) are compared by pivot distance tables
    and fingerprint distance, then by parity sketches, which discard without loss, and each link is confirmed
    on whole sets, so none below the threshold is linked. Texts of equal sets are one node. A first round pairs each row
    of a group with one other in range; a second one what is left between rows that this has not connected, in tiles.

    Null and empty texts, and those without words, are alike. Columns stay as they are; of equal (id, text) rows one
    stays. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for t in x["text"]:
                s = shingles(t, width, seed)
                wide = sketch(s)
                node = np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed)).astype(np.int64)
                out.append((node, len(s), majorities(s, PRINTS).view(np.int64), wide, folded(wide, SKETCH).tobytes()))
            yield pd.concat([x[["id", "k"]], pd.DataFrame(out, columns=["node", "n", "prints", "sketch", "small"], index=x.index)], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), key.alias("k"), text.alias("text"))
    rows = written(rows.mapInPandas(trimmed(run), f"id {kind}, k long, node long, n int, prints array<long>, sketch binary, small binary"), "similar-rows")
    # Of the rows of a node only its first is looked at further; the rest of a node's columns follow from its set.
    first = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "k")).alias("first")
    nodes = rows.groupBy("node").agg(first, *(F.any_value(c).alias(c) for c in ("n", "prints", "sketch", "small")))
    nodes = written(nodes.withColumn("k", F.col("first.k")), "similar-nodes", rows.count())
    n_nodes = nodes.count()
    bits, bands, short_bands, radius = calibrate(n_nodes, similarity, recall)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                keys = band_keys(np.stack(x["prints"].to_numpy()).view(np.uint64), bits, short_bands, seed)
                keys = [k if n < SHORT else k[:bands] for k, n in zip(keys, x["n"])]
                yield pd.DataFrame({"node": x["node"], "n": x["n"], "fp": [p[0] for p in x["prints"]], "keys": keys})

    ahead = nodes.select("node", "n", "prints").mapInPandas(keyed, "node long, n int, fp long, keys array<long>")
    ahead = written(ahead, "similar-keys").select("node", "n", "fp", F.explode("keys").alias("key"))
    # Ranges, not hashes, deal the rows out: a group with much of all rows goes over many tasks.
    dealt = ahead.repartitionByRange("key", "fp", "node").sortWithinPartitions("key", "fp", "node")
    found = written(dealt.mapInPandas(trimmed(_first_round(similarity, radius)), "a long, b long, kind string").distinct(), "similar-pairs", n_nodes)
    cold = found.where("kind = 'pair'").select("a", "b")
    links = _confirmed(docs, cold, nodes, key, text, width, seed, similarity, "similar-first", n_nodes)
    # A key that ends one partition and begins another is a group that was cut, which the second round takes up whole.
    hot = found.where("kind in ('group', 'edge')").groupBy(F.col("a").alias("key")).agg(F.max(F.col("kind") == "group").alias("large"), F.count("*").alias("ends"))
    hot = hot.where("large or ends > 1").select("key")
    members = found.where("kind = 'member'").select(F.col("a").alias("key"), F.col("b").alias("node"))
    if hot.limit(1).count() or members.limit(1).count():
        whole = salted_join(ahead.select("key", "node"), hot, ["key"], "node").union(members).distinct()
        named = nodes.join(components(links, n_nodes), "node", "left")
        named = written(named.select("node", "n", F.col("prints")[0].alias("fp"), "small", F.coalesce("component", "node").alias("root")), "similar-named", n_nodes)
        slim = written(whole.join(named.select("node", "root"), "node"), "similar-hot", n_nodes)
        # A group that the first round has connected leaves nothing to compare.
        open_ = slim.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / TILE).cast("int").alias("of"))
        open_ = written(open_.where("x <> y").select("key", "of"), "similar-open", n_nodes)
        r = salted_join(slim.select("key", "node"), open_, ["key"], "node").join(named, "node")
        r = r.withColumn("t", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
        r = r.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        r = r.select("key", "node", "n", "fp", "small", "root", "t", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"))
        more = r.repartition("key", "ta", "tb").sortWithinPartitions("key", "ta", "tb").mapInPandas(trimmed(_second_round(similarity, radius)), "a long, b long")
        more = written(more.distinct().join(cold, ["a", "b"], "left_anti"), "similar-more", n_nodes)
        links = links.union(_confirmed(docs, more, nodes, key, text, width, seed, similarity, "similar-second", n_nodes))
    group = nodes.join(components(links, n_nodes), "node", "left").groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = group.select(F.col("first.k").alias("_k"))
    mine = [F.col(c) for c in docs.columns]
    whole = docs.select(F.struct(*mine).alias("row"), key.alias("key"))
    return whole.join(kept, F.col("key") == F.col("_k"), "left_semi").dropDuplicates(["key"]).select("row.*")
