"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import WORD, range_rank, written

#: Rows that one prefix-sum task gets of a source, about.
BUCKET_ROWS = 4096
#: Copies of one row that a task makes of repeated rows.
COPIES = 1000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """sources (size, weight) with target: share of all sizes dealt by weight, no target above cap x size.

    The level rises until no further source stops at its cap; a round is one aggregate row.
    """
    level, stopped = 0.0, -1
    while True:
        at_cap = F.col("size") * cap <= F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum("size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(at_cap, F.col("size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0)).alias("open"),
            F.coalesce(F.sum(at_cap.cast("long")), F.lit(0)).alias("n"),
        ).first()
        if row["n"] == stopped or not row["open"]:
            return sources.withColumn("target", F.when(at_cap, F.col("size") * cap).otherwise(F.lit(level) * F.col("weight")))
        stopped, level = row["n"], (share * row["total"] - cap * row["held"]) / row["open"]


def mix(
    docs: DataFrame,
    *,
    source_weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    quality: DataFrame | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, epochs, part, taken.

    Sources in code-point order (null last) take source_weights in turn. A source's complete epochs come
    first; the rest of its target goes to rows by ascending exponential key, -ln(u) / quality, and the row
    at the end of the budget gives the words that are left (part). u is a hash of seed and doc_id, so
    reruns agree. quality: one row (doc_id, quality) for a document at most; others weigh 1.

    Null text or id: size 0, or the key of the empty id. Null or non-positive quality: weight 1. Ties
    are ordered by doc_id, then size. Repeated rows each count. An empty table gives no rows; a source
    without words has target 0 and takes nothing. Other columns of docs are not carried.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), (-F.log(u)).alias("key"))
    if quality is not None:  # after the texts are gone, so the join moves slim rows
        rows = rows.join(quality.select(F.col("doc_id").alias("_id"), "quality"), F.col("doc_id") == F.col("_id"), "left")
        rows = rows.withColumn("key", F.col("key") / F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(1.0)))
    rows = written(rows.select("doc_id", "source", "size", "key"), "mix-rows")
    per = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    per = range_rank(per, [F.col("source").asc_nulls_last()])
    turn = F.element_at(F.array(*map(F.lit, source_weights)), (F.pmod(F.col("rank") - 1, F.lit(len(source_weights))) + 1).cast("int"))
    per = targets(written(per.withColumn("weight", turn), "mix-sources"), share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    per = per.select(
        F.col("source").alias("_source"), F.ceil(F.col("n") / BUCKET_ROWS).alias("_buckets"), F.col("size").alias("source_size"), "target"
    ).withColumn("epochs", epochs.cast("long"))
    per = written(per.withColumn("_rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-targets")

    # One row per source: Spark broadcasts it by its written size, else splits the hot source's side.
    rows = rows.join(per, rows["source"].eqNullSafe(per["_source"])).drop("_source")
    spread = (1 - F.exp(-F.col("key"))) * F.col("_buckets")  # rises with the key, so buckets are in key order
    rows = rows.withColumn("_bucket", F.least(F.floor(spread), F.col("_buckets") - 1).cast("long"))
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = rows.groupBy("_s", "_bucket").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_s", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_s", "_bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("size").over(inside)).join(sums, ["_s", "_bucket"])
    left = F.col("_rest") - (F.col("_before") + F.col("_upto") - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    rows = rows.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", "taken")


def quality_of(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): 2 where labels mark the document good, 0.5 where bad; disagreeing labels average."""
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg((F.lit(0.5) + F.lit(1.5) * F.avg("quality")).alias("quality"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as mix() deals them: each row in as many whole copies as its epochs say, one more where half of it or more is in its part.

    Columns stay as they are. Rows of a source without words stay once. Rows that agree in id, source and size
    share their copies evenly, by the hash of the row. Null, empty and repeated rows: see mix(). Keywords: those of mix().
    """
    extra = ((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))).cast("long")
    dealt = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    dealt = dealt.select(F.col("doc_id").alias("_i"), F.col("source").alias("_c"), F.col("size").alias("_z"), (F.col("epochs") + extra).alias("_n"))
    dealt = dealt.groupBy("_i", "_c", "_z").agg(F.sum("_n").alias("_copies"), F.count("*").alias("_rows"))
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")  # so no column of docs meets one of these
    mine = docs.select(row, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words(F.col(text_col)).alias("_size"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_c")) & (F.col("_size") == F.col("_z"))
    mine = mine.join(dealt, same)
    one = mine.where("_rows = 1 and _copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    # Equal rows come together as one with a count; then the first ones by hash get the copies that are over.
    many = mine.where("_rows > 1").groupBy("_row", "_i", "_c", "_z", "_copies", "_rows").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("_i", "_c", "_z").orderBy(F.xxhash64(F.to_json("_row"))).rowsBetween(Window.unboundedPreceding, 0))
    over = F.greatest(F.lit(0), F.least(F.col("_m"), F.col("_copies") % F.col("_rows") - (upto - F.col("_m"))))
    many = many.withColumn("_n", (F.floor(F.col("_copies") / F.col("_rows")) * F.col("_m") + over).cast("long")).where("_n > 0")
    many = many.select("_row", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))).alias("_part"))
    many = many.repartition(F.xxhash64("_n", "_part", F.to_json("_row")))  # many copies of a row are dealt out
    many = many.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("_n") - F.col("_part") * COPIES))))
    return one.select("_row.*").union(many.select("_row.*"))
