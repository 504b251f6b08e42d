"""Tiles from a slow or remote source: fetched in tasks, with retries, and put together."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gridloom.grid import Grid

#: Gives the values (height, width) of a tile, or None where the source has nothing.
Source = Callable[[int, int, int, int], "np.ndarray | None"]


class TooManyRequests(Exception):
    """A source's word that it is asked too often."""


def session(name: str = "gridloom", **conf: str) -> SparkSession:
    """The session of this process; conf keys have _ for dots."""
    builder = SparkSession.builder.appName(name)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def with_retries(call: Callable, retries: int = 5, first: float = 2.0, longest: float = 120.0, wait: Callable[[float], None] = time.sleep):
    """call(), tried again after an error: waits grow evenly up to `longest` when asked too often, else they double. The last error is raised."""
    for i in range(retries):
        try:
            return call()
        except Exception as e:  # whatever the source raises
            if i == retries - 1:
                raise
            wait(min(longest, first * 15 * (i + 1)) if isinstance(e, TooManyRequests) else first * 2**i)


def fetch(tiles: DataFrame, grid: Grid, source: Source, fill: float | None = None, retries: int = 5, first: float = 2.0) -> DataFrame:
    """(cell_id, v) of all cells of the tiles (row0, col0, height, width); cells of a tile that the source lacks have the fill.

    A task has a few tiles and asks for one at a time; a task that is lost asks for its tiles again.
    """
    width = grid.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r, c, h, w in zip(x["row0"], x["col0"], x["height"], x["width"]):
                got = with_retries(lambda: source(int(r), int(c), int(h), int(w)), retries, first)  # noqa: B023
                cell = ((r + np.arange(h))[:, None] * width + c + np.arange(w)).ravel()
                yield pd.DataFrame({"cell_id": cell, "v": np.full(h * w, fill, object) if got is None else np.asarray(got, float).ravel()})

    n = tiles.count()
    return tiles.repartition(max(1, min(n, 10_000))).mapInPandas(run, "cell_id long, v double")
