"""The corpus pipeline: STAGES in order, each a function (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, langid, mixing, secrets, simhash
from corpusloom.runtime import stored, table

#: No DuckDB SQL expresses language scores, SimHash or BPE; tests/llm holds the run against brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null, empty and letterless texts go.

    Where no row has a language to learn from, none is told apart and all documents with a letter stay.
    """
    found = langid.identify(docs)
    told = F.col(found.columns[-2]) != langid.UNDETERMINED
    if docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~langid.held_out()).isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return found.where(told).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id, null last, then of the smallest digest."""
    return simhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the characters of every reported span masked; null and empty texts and repeated rows stay."""
    return secrets.redact(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it is drawn, whole; null and empty texts have no words and are drawn with their block."""
    return mixing.mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text again, for every row; null is as empty."""
    both = bpe.round_trip(docs.select("doc_id", "text"))
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scan), ("mixing", mixing_weights), ("BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
