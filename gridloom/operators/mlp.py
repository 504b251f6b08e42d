"""A small softmax network: numpy training on a bounded sample, scoring by Arrow batches, permutation importance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.sampling import turn
from gridloom.sources.tables import cut


@dataclass
class Network:
    """Dense layers (weights, bias); ReLU between them, softmax at the end."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    history: list[dict] = field(default_factory=list)

    @classmethod
    def fresh(cls, inputs: int, hidden: tuple[int, ...] = (64, 32), classes: int = 6, seed: int = 42) -> Network:
        rng, sizes = np.random.default_rng(seed), (inputs, *hidden, classes)
        return cls([(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])

    def scores(self, x: np.ndarray, drop: float = 0.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        kept = []
        for i, (w, b) in enumerate(self.layers):
            last = i == len(self.layers) - 1
            z = x @ w + b
            mask = None
            y = z if last else np.maximum(z, 0)
            if drop and not last:
                mask = (rng.random(y.shape) >= drop) / (1 - drop)
                y = y * mask
            kept.append((x, z, mask))
            x = y
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), kept

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w.tolist(), b.tolist()) for i, (w, b) in enumerate(self.layers)]
        spark.createDataFrame(rows, "layer int, weights array<array<double>>, bias array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["layer"])
        return cls([(np.array(r["weights"]), np.array(r["bias"])) for r in rows])


def fit(net: Network, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, *, epochs: int = 200, batch: int = 1024, patience: int = 15, rate: float = 1e-3, drop: float = 0.2, seed: int = 42) -> Network:
    """Adam on cross-entropy; stops when the validation loss has not fallen for `patience` epochs and keeps the best weights. y: classes from 0."""
    rng = np.random.default_rng(seed)
    flat = [p for layer in net.layers for p in layer]
    m, v, t = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    best, since = (np.inf, [p.copy() for p in flat]), 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // batch))):
            p, kept = net.scores(x[rows], drop, rng)
            d, grads = (p - np.eye(p.shape[1])[y[rows]]) / len(rows), []
            for i in reversed(range(len(kept))):
                a, _, _ = kept[i]
                grads[:0] = [a.T @ d, d.sum(axis=0)]
                if i:
                    d = d @ net.layers[i][0].T * (kept[i - 1][1] > 0) * (1 if kept[i - 1][2] is None else kept[i - 1][2])
            t += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                flat[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
        p, _ = net.scores(vx)
        loss = float(-np.log(np.maximum(p[np.arange(len(vy)), vy], 1e-15)).mean())
        net.history.append({"epoch": epoch + 1, "val_loss": loss, "val_accuracy": float((p.argmax(axis=1) == vy).mean())})
        if loss < best[0]:
            best, since = (loss, [q.copy() for q in flat]), 0
        else:
            since += 1
            if since >= patience:
                break
    for q, b in zip(flat, best[1]):
        q[...] = b
    return net


def train(samples: DataFrame, names: list[str], *, label: str = "c1", cap: int = 600_000, **how) -> Network:
    """Fits on the rows of split train, validates on val. The sample is stratified and so bounded; beyond `cap` rows it is thinned by turn(cell_id)."""
    rows = samples.where(F.col("split").isin("train", "val")).select(*names, (F.col(label) - 1).alias("_y"), "split", "cell_id")
    rows = rows.orderBy(turn(F.col("cell_id")), "cell_id").limit(cap).toPandas()
    a, b = rows[rows["split"] == "train"], rows[rows["split"] == "val"]
    x, vx = (f[names].to_numpy(float) for f in (a, b))
    return fit(Network.fresh(len(names)), x, a["_y"].to_numpy(int), vx, b["_y"].to_numpy(int), **how)


def score(rows: DataFrame, names: list[str], net: Network, out: str = "prob") -> DataFrame:
    """rows with the array of class probabilities, in Arrow batches; names are standardized columns."""
    layers = net.layers

    @F.pandas_udf("array<double>")
    def probs(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        mine = Network(layers)
        for x in batches:
            yield pd.Series(list(mine.scores(np.column_stack([np.asarray(s, float) for s in x]))[0]))

    return rows.withColumn(out, probs(*[F.col(n) for n in names]))


def linear_softmax(names: list[str], weights: list[list[float]]) -> Column:
    """Class probabilities of a linear model as one native expression; weights: per class its bias, then a weight per name."""
    z = F.array(*[sum((F.col(n) * F.lit(w) for n, w in zip(names, row[1:])), F.lit(float(row[0]))) for row in weights])
    e = F.transform(z, lambda v: F.exp(v))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u))


def importance(samples: DataFrame, names: list[str], net: Network, *, label: str = "c1", cap: int = 30_000) -> DataFrame:
    """(name, gain): by how much the log-loss rises when a column is dealt out anew, on `cap` rows of split test at most.

    Rows and the dealt-out column meet by two row numbers in different orders.
    """
    from pyspark.sql.window import Window

    rows = samples.where("split = 'test'").orderBy(turn(F.col("cell_id")), "cell_id").limit(cap)
    rows = cut(rows.withColumn("_i", F.row_number().over(Window.orderBy("cell_id"))))
    loss = lambda d: score(d, names, net).agg(F.avg(-F.log(F.greatest(F.get("prob", F.col(label) - 1), F.lit(1e-15)))).alias("loss"))
    base, out = loss(rows).withColumnRenamed("loss", "_base"), None
    for k, name in enumerate(names):
        other = rows.select(F.col(name).alias("_v"), F.row_number().over(Window.orderBy(turn(F.col("_i"), k + 1), "_i")).alias("_i"))
        one = loss(rows.drop(name).join(other, "_i").withColumnRenamed("_v", name)).crossJoin(base).select(F.lit(name).alias("name"), (F.col("loss") - F.col("_base")).alias("gain"))
        out = one if out is None else out.union(one)
    return out
