"""Dealing rows by ranges of a key when the order of the ranges must be known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def splits_of(df: DataFrame, key: str, parts: int, error: float | None = None) -> list[int]:
    """At most parts - 1 ascending, distinct split points of a long key with about as many rows between them."""
    if parts < 2:
        return []
    cuts = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [k / parts for k in range(1, parts)], error or 1 / (4 * parts))
    return sorted({int(x) for x in cuts})


def bucket_of(key: str, splits: list[int]) -> F.Column:
    """Number of split points <= key, by binary search; null keys come after all."""
    if not splits:
        return F.lit(0)
    points = F.array(*[F.lit(x).cast("long") for x in splits])
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, len(splits).bit_length()))),
        F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi")),
        lambda s, _: _step(s, points, F.col(key)),
        lambda s: s["lo"],
    )
    return F.when(F.col(key).isNull(), F.lit(len(splits))).otherwise(found)


def _step(s: F.Column, points: F.Column, key: F.Column) -> F.Column:
    mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    right = (s["lo"] < s["hi"]) & (F.get(points, mid) <= key)
    lo = F.when(right, mid + 1).otherwise(s["lo"])
    hi = F.when((s["lo"] < s["hi"]) & ~right, mid).otherwise(s["hi"])
    return F.struct(lo.alias("lo"), hi.alias("hi"))
