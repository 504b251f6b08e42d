"""URL filters by a temporal list join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    found = F.regexp_replace(found, r"\.+$", "")
    return F.when(found != "", found)


def suffixes(name: Column) -> Column:
    """The host and each parent domain."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (pattern, action, day) as validity intervals (pattern, action, valid_from, valid_to).

    An entry holds from its day until the next entry of its pattern; 'remove' ends one and starts none.
    Of one pattern's entries on one day the last action in code-point order holds. Entries with a null
    in any of the three columns are void; rows that repeat one change nothing, other columns are not read. No entries give no intervals.
    """
    one = entries.where("pattern is not null and action is not null and day is not null")
    one = one.groupBy(F.lower("pattern").alias("pattern"), "day").agg(F.max("action").alias("action"))
    nxt = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return one.withColumn("valid_to", nxt).where("action <> 'remove'").select("pattern", "action", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", day_col: str = "day", salts: int = 16) -> DataFrame:
    """Per capture: id, host, day, pattern, action, valid_from, valid_to, kept.

    As-of join: captures and the starts of intervals come in one order of days, and a capture takes the last interval of
    each of its patterns - host and parent domains - that began by its day, if it has not ended; the longest pattern decides, and
    'block' drops the capture. A null or hostless URL or a null day meets no entry and is kept. Rows that repeat an id, URL and
    day come out once with one decision, in as many copies as came in. Very long URLs are cut to their host. Without entries all
    are kept; without captures there are no rows. Other columns are not carried. Hot hosts are dealt to `salts` tasks, each with all entries of its patterns.
    """
    rows = captures.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), F.col(day_col).alias("day"))
    rows = rows.groupBy("id", "host", "day").agg(F.count("*").alias("_copies"))
    salt = F.pmod(F.xxhash64("id", "day"), F.lit(salts)).cast("int").alias("_salt")
    keys = rows.where("host is not null and day is not null").select("id", "host", "day", salt, F.explode(suffixes(F.col("host"))).alias("pattern"))
    starts = intervals(entries).select("pattern", F.col("valid_from").alias("day"), F.struct("action", "valid_from", "valid_to").alias("entry"))
    starts = starts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    order = Window.partitionBy("pattern", "_salt").orderBy("day", F.col("entry").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = keys.unionByName(starts, allowMissingColumns=True).withColumn("entry", F.last("entry", ignorenulls=True).over(order))
    met = met.where("host is not null and entry is not null and (entry.valid_to is null or day < entry.valid_to)").select("id", "host", "day", "pattern", "entry.*")
    best = F.max_by(F.struct("pattern", "action", "valid_from", "valid_to"), F.length("pattern")).alias("_best")
    best = met.groupBy(F.col("id").alias("_id"), F.col("host").alias("_host"), F.col("day").alias("_day")).agg(best)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("day") == F.col("_day"))
    out = rows.join(best, same, "left").select(F.col("id").alias(id_col), "host", F.col("day"), "_best.*", "_copies")
    out = out.withColumn("kept", F.coalesce(F.col("action") != "block", F.lit(True)))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copy", "_copies")
