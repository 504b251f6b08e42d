"""Shared plumbing: the shared work folder, salted joins, distributed ranks and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.sources.tables import shared_dir

#: Words are runs of everything but these seven white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a file of a slim table, about.
FILE_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor loses nothing.

    With rows, about its number of rows, they are dealt evenly to files of FILE_ROWS, by one more shuffle. Otherwise each task
    has a file of its own, however few its rows; on a local file system Hadoop starts processes for each, which share the executor's memory at first.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if rows is not None:
        df = df.repartition(1 + rows // FILE_ROWS)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: Python workers are reused by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with freed memory given back after each batch and at the end."""

    def inner(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            release()
        release()

    return inner


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt_by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Equi-join whose left side may have hot keys: each key is dealt to `salts` tasks, the right side repeated in each.

    right should hold few rows for a key; salt_by is a left column that varies within a key.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by, F.lit(7)), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def range_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with a global row number from 1 by `order`, without a one-task window: range partitions, their counts, then offsets."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    offset = F.element_at(F.create_map(*[F.lit(x) for s in starts for x in s]), F.col("_part")) if starts else F.lit(0)
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, (row + offset).cast("long")).drop("_part")


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that come sorted by `by`, in frames of whole groups, and the groups' starts; a group may go over several batches."""
    held: list[pd.DataFrame] = []
    for x in batches:
        if not len(x):
            continue
        cut = int(starts_of(x, by)[-1])  # the last group may go on
        if held and (cut or (held[-1][by].iloc[-1] != x[by].iloc[0]).any()):
            done = pd.concat([*held, x.iloc[:cut]], ignore_index=True)
            yield done, starts_of(done, by)
            held = []
        elif cut:
            yield x.iloc[:cut], starts_of(x.iloc[:cut], by)
        held.append(x.iloc[cut:])
    if held:
        done = pd.concat(held, ignore_index=True)
        yield done, starts_of(done, by)


def starts_of(x: pd.DataFrame, by: list[str]) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = np.any([x[c].to_numpy()[1:] != x[c].to_numpy()[:-1] for c in by], axis=0)
    return np.flatnonzero(new)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and each node's smallest connected node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        was = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(was, root):
            return nodes, nodes[root]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each partition's edges as stars; a forest is kept between batches, so memory follows the nodes, not the edges."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = roots(np.concatenate([a, batch["a"].to_numpy(np.int64)]), np.concatenate([b, batch["b"].to_numpy(np.int64)]))
        a, b = a[a != b], b[a != b]
        if len(a) > 500_000:
            yield pd.DataFrame({"a": a, "b": b})
            a = b = np.empty(0, np.int64)
    yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) of every node of the edges (a, b: long); component is the smallest reachable node.

    Edges contract to stars within partitions, then alternating large-star and small-star rounds run over
    written tables until a round changes nothing. Nothing but one checksum row reaches the driver. rows: see written().
    """
    edges = written(edges.select("a", "b").where("a <> b").mapInPandas(_contract, "a long, b long"), "edges", rows)
    last = None
    while True:
        sum_ = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count("*"), sum_).first())
        if now == last or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        last = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = salted_join(both, least, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, ["a"], "b")
        small = small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        was, edges = edges, written(small, "edges", rows)
        discard(was)
