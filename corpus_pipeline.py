"""Corpus pipeline: toxicity, near-dedup by shingles, personal data, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, packing, pii, similar, toxicity
from gridloom.llm.common import table, written


def apart(docs: DataFrame) -> DataFrame:
    """What the operators read, and the whole row in one column, so that no column of theirs meets one of its."""
    return docs.select("doc_id", "text", F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, whole and with all their columns; the network is trained on labelled rows of docs.

    Null and empty texts score alike, by the network's bias. Repeated rows stay or go together. With labels of one kind
    only, or none, the score is their share of toxic ones (0 without any). An empty table gives no rows.
    """
    return toxicity.score(apart(docs), table(spark, sf_dir, "labels")).where("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, SimHash candidates, Jaccard similarity of 0.8 or more.

    That of the smallest doc_id stays (a null one last). Null and empty texts are one group. Of equal rows one stays. All columns
    are kept. An empty table gives no rows.
    """
    return similar.keep_first(docs, similarity=0.8, width=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind; n_chars follows, all other columns stay.

    A null text stays null, with a null n_chars. Repeated rows are masked alike. An empty table gives no rows.
    """
    found = pii.detect(apart(docs), redact=True)
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their source's target says; all columns stay.

    Null sources are one source, the last. Null and empty texts weigh nothing and stay once an epoch. Repeated rows share
    their copies. An empty table gives no rows.
    """
    return mixing.mixed(docs, quality=mixing.quality_of(table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, batch, slot and padding of every document that is left.

    Null and empty texts have length 0. Each of repeated rows has a slot of its own. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the networks nor the near duplicates' components; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
