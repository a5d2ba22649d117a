"""Exact duplicates and set comparison of tables. Keys over long texts travel as digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*columns: str) -> Column:
    """SHA-256 over columns, nulls and borders told apart: the shuffle key of a long text."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("n")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in order; of rows equal in both, one. df is read once, and each task keeps the first
    row of a key before the shuffle, so a hot key is one row a task."""
    return first_examples(df.withColumn("__key", digest(*keys)), ["__key"], [order], 1).drop("__key")


def surplus(*keys: str) -> Column:
    """Rows beyond the first of each key; null keys don't count."""
    key = F.sha2(F.col(keys[0]).cast("string"), 256) if len(keys) == 1 else digest(*keys)
    return (F.count(key) - F.count_distinct(key)).cast("long")


def first_examples(df: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """At most `most` rows of each group in order; cut in every task before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def shared_texts(rows: DataFrame, text: str, id_col: str, side: str | None = None, most: int = 10) -> DataFrame:
    """Texts that several rows (or both sides) have: digest, count, and the first ids, `most` of them a side.

    With a side, a row that has a text twice counts once. Only digests are shuffled.
    """
    marked = rows.select(F.sha2(text, 256).alias("digest"), id_col, *([side] if side else []))
    marked = marked.distinct() if side else marked
    by = ["digest"] + ([side] if side else [])
    counts = marked.groupBy(*by).agg(F.count("*").alias("n"))
    if side:
        both = counts.groupBy("digest").agg(F.count("*").alias("__sides")).where(F.col("__sides") > 1).select("digest")
        counts = counts.join(both, "digest", "left_semi")
    else:
        counts = counts.where(F.col("n") > 1)
    ids = first_examples(marked.join(counts.select(*by), by, "left_semi"), by, [id_col], most)
    return counts.join(ids.groupBy(*by).agg(F.sort_array(F.collect_list(id_col)).alias("ids")), by)


def last_wins(parts: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of the greatest order."""
    others = [c for c in parts.columns if c not in (key, order)]
    return parts.groupBy(key).agg(F.max_by(F.struct(order, *others), order).alias("r")).select(key, "r.*")
