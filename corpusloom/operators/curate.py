"""Curation of (source, target) pairs: one pass of conditions, so Catalyst sees them all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.dedup import keep_first


def cleaned(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Pairs without null or blank side, both stripped, with their word counts n_source and n_target."""
    out = pairs.na.drop(subset=[source, target]).withColumn(source, X.pstrip(source)).withColumn(target, X.pstrip(target))
    out = out.where((F.col(source) != "") & (F.col(target) != ""))
    return out.withColumn("n_source", X.word_count(source)).withColumn("n_target", X.word_count(target))


def in_length_band(n_source: Column, n_target: Column, source: tuple[int, int] = (100, 1200), target: tuple[int, int] = (10, 150)) -> Column:
    """Both lengths in their bands, ends included."""
    return n_source.between(*source) & n_target.between(*target)


def in_ratio_band(n_source: Column, n_target: Column, low: float = 0.02, high: float = 0.50) -> Column:
    """target / source in the band, ends included."""
    return (n_target / F.nullif(n_source, F.lit(0))).between(low, high)


def curate(pairs: DataFrame, order: str, source: str = "source", target: str = "target", bands: dict | None = None, ratios: tuple[float, float] = (0.02, 0.50)) -> DataFrame:
    """Clean, drop equal pairs, filter by lengths and ratio, drop equal sources (first by `order`), then normalise.

    Normalisation comes last, as in the studies this follows, so lengths and duplicates are those of the raw texts.
    """
    kept = keep_first(cleaned(pairs, source, target), [source, target], order)
    kept = kept.where(in_length_band(F.col("n_source"), F.col("n_target"), **(bands or {})) & in_ratio_band(F.col("n_source"), F.col("n_target"), *ratios))
    kept = keep_first(kept, [source], order)
    return kept.withColumn(source, X.normalize_corpus(source)).withColumn(target, X.normalize_corpus(target))


def cosine(a: str, b: str, epsilon: float = 1e-9) -> Column:
    """Cosine of two arrays, epsilon added to each norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) + epsilon
    return dot / (norm(a) * norm(b))
