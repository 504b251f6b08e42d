"""Packing: length buckets of least padding, and batches under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import written
from gridloom.llm.mixing import words

#: Rows that one numbering task gets, about.
SHARD = 4096


def boundaries(histogram: list[tuple[int, int, int]], k: int) -> list[int]:
    """At most k upper lengths that minimise padding, exactly. histogram: (length, rows, sum of lengths) by ascending length.

    Dynamic programming: cost[j] = min over i < j of before[i] + length[j] * (rows i..j) - (sum i..j). The terms
    in i are lines in length[j] with falling slopes, so their lower hull gives each minimum in constant time.
    """
    rows, sums = [0], [0]
    for _, n, s in histogram:
        rows.append(rows[-1] + n)
        sums.append(sums[-1] + s)
    d = len(histogram)
    best, choice = [0] + [None] * d, []
    for _ in range(min(k, d)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        top, now, pick = 0, [None] * (d + 1), [0] * (d + 1)
        for j in range(1, d + 1):
            if best[j - 1] is not None:
                line = (-rows[j - 1], best[j - 1] + sums[j - 1], j - 1)
                while len(hull) - top >= 2 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            if len(hull) <= top:
                continue
            x = histogram[j - 1][0]
            while len(hull) - top >= 2 and hull[top + 1][0] * x + hull[top + 1][1] <= hull[top][0] * x + hull[top][1]:
                top += 1
            a, b, i = hull[top]
            now[j], pick[j] = a * x + b + x * rows[j] - sums[j], i
        choice.append(pick)
        best = now
        best_whole = best[d]
        if best_whole == 0:
            break
    out, j = [], d
    for pick in reversed(choice):
        if j == 0:
            break
        out.append(histogram[j - 1][0])
        j = pick[j]
    return out[::-1]


def _hidden(a: tuple, b: tuple, c: tuple) -> bool:
    """Line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, *, buckets: int = 12, max_tokens: int = 32_768, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Per row of docs: id, n_tokens, bucket (its padded length), batch, slot, padding.

    Boundaries come from dynamic programming over the histogram of all lengths. Inside a bucket rows are
    numbered by a seeded hash and cut into batches whose padded size is at most max_tokens; a row longer than that
    is a batch of its own. Lengths are length_col, or white-space words of the text.

    Null and empty texts (and null lengths) have length 0 and share batches of max_tokens rows. Rows that repeat an id each
    get a slot; ties of the hash go by id, then length. A null id is hashed as empty. An empty table gives no
    rows. Other columns are not carried.
    """
    size = F.coalesce(F.col(length_col).cast("long"), F.lit(0).cast("long")) if length_col else words(F.col(text_col))
    turn = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = written(docs.select(F.col(id_col).alias("id"), F.greatest(size, F.lit(0)).alias("n_tokens"), turn.alias("turn")), "pack-rows")
    # One row per different length, which grows with the longest text and not with the rows.
    bins = rows.groupBy("n_tokens").agg(F.count("*").alias("n"))
    histogram = sorted((r["n_tokens"], r["n"], r["n_tokens"] * r["n"]) for r in bins.toLocalIterator())
    tops = boundaries(histogram, buckets)
    if not tops:
        empty = F.lit(0).cast("long")
        return rows.select(F.col("id").alias(id_col), "n_tokens", empty.alias("bucket"), empty.alias("batch"), empty.alias("slot"), empty.alias("padding"))
    counts = [sum(n for top, n, _ in histogram if low < top <= high) for low, high in zip([-1, *tops], tops)]
    per = [max(1, max_tokens // max(1, top)) for top in tops]
    first = [0]
    for n, rows_each in zip(counts, per):
        first.append(first[-1] + -(-n // rows_each))
    number = F.size(F.filter(F.array(*map(F.lit, tops)), lambda t: t < F.col("n_tokens")))  # of the bucket, from 0
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("_b") + 1)
    rows = rows.withColumn("_b", number).withColumn("_shard", F.pmod("turn", pick([-(-n // SHARD) or 1 for n in counts])))
    sizes = rows.groupBy("_b", "_shard").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_b").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_b", "_shard", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b", "_shard").orderBy("turn", "id", "n_tokens"))
    rows = rows.withColumn("_rank", inside - 1).join(sizes, ["_b", "_shard"])
    rank = F.col("_before") + F.col("_rank")
    return rows.select(
        F.col("id").alias(id_col),
        "n_tokens",
        pick(tops).alias("bucket"),
        (pick(first[:-1]) + F.floor(rank / pick(per))).cast("long").alias("batch"),
        (rank % pick(per)).cast("long").alias("slot"),
        (pick(tops) - F.col("n_tokens")).alias("padding"),
    )
