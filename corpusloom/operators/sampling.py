"""Deterministic ranks, samples, splits and blind labels: orders come from hashes, not from a generator's state.

A hash order is the same on any engine, for any partitioning, and a smaller sample is a prefix of a larger one. Ranks
within strata or groups shuffle by group alone; a rank over all rows (a global shuffle, exact split sizes) needs every
row's place, for which `place()` ranges the hashes over partitions and adds each one's start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import joined_key


def hash_order(*parts: Column | str) -> Column:
    return F.sha2(joined_key(*parts), 256)


def place(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with each row's place from 0 in the given order, without bringing all rows to one task.

    Rows are ranged over partitions by the order and numbered there; the starts of the partitions are sums over their
    counts, one row each. The order must tell rows apart for the numbers to be the same on every run.
    """
    from corpusloom.runtime import stored

    keys = [f"__k{i}" for i in range(len(order))]
    ranged = df.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(ranged.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "placed")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    return numbered.join(starts, "__part").withColumn(name, (F.col("__start") + F.col("__rn") - 1).cast("long")).drop("__part", "__rn", "__start", *keys)


def numbered(df: DataFrame, by: str | Sequence[str], id_col: str, name: str = "nth") -> DataFrame:
    """df with each row's number from 1 in its group by id. Groups, null ones too, are spread over tasks by place(), so one
    that holds most rows costs no single task."""
    by = [by] if isinstance(by, str) else list(by)
    placed = place(df, [*map(F.col, by), F.col(id_col)], "__place")
    first = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("__place").alias("__first"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return placed.join(first, same).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first", *[f"__{c}" for c in by])


def rank_strata(df: DataFrame, strata: int, order: Sequence[Column], name: str = "stratum") -> DataFrame:
    """Strata 1..n of equal size by rank, the first ones a row larger if the rows don't divide, like ntile()."""
    placed = place(df, order, "__place")
    total = placed.agg(F.count("*").alias("__all"))
    small, extra = F.floor(F.col("__all") / strata), F.pmod(F.col("__all"), F.lit(strata))
    p, edge = F.col("__place"), extra * (small + 1)
    number = F.when(p < edge, F.floor(p / (small + 1))).otherwise(extra + F.floor((p - edge) / F.greatest(small, F.lit(1))))
    return placed.crossJoin(total).withColumn(name, (number + 1).cast("int")).drop("__place", "__all")


def equal_strata(df: DataFrame, strata: int, order: Sequence[Column], name: str = "stratum") -> DataFrame:
    """rank_strata() of rows that divide evenly; others raise."""
    if n := df.count() % strata:
        raise ValueError(f"{n} rows are over in {strata} equal strata")
    return rank_strata(df, strata, order, name)


def sample_exactly(df: DataFrame, stratum: str, id_col: str, counts: dict, seed: str, namespace: str) -> DataFrame:
    """sample_strata() with a number for each stratum; a stratum that is missing or too small raises."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}  # one row a stratum
    if few := {s: n for s, n in counts.items() if n > sizes.get(s, 0)}:
        raise ValueError(f"strata are smaller than asked for: {few}")
    asked = F.coalesce(*[F.when(F.col(stratum) == F.lit(s), F.lit(n)) for s, n in counts.items()], F.lit(0))
    return sample_strata(df, stratum, id_col, max(counts.values(), default=0), seed, namespace).where(F.col("draw") <= asked)


def peek(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """n rows in hash order: the same on every run."""
    return df.orderBy(hash_order(F.lit(seed), F.lit("peek"), id_col), id_col).limit(n)


def sample_strata(df: DataFrame, stratum: str, id_col: str, per_stratum: int, seed: str, namespace: str) -> DataFrame:
    """per_stratum rows of each stratum without replacement; smaller numbers give prefixes of larger samples."""
    by_hash = Window.partitionBy(stratum).orderBy(hash_order(F.lit(seed), F.lit(namespace), id_col), id_col)
    return df.withColumn("draw", F.row_number().over(by_hash)).where(F.col("draw") <= per_stratum)


def blind_labels(samples: DataFrame, systems: Sequence[str], seed: str) -> DataFrame:
    """(sample_id, system, anon_id): a permutation A, B, ... of the systems for each sample."""
    rows = samples.select("sample_id", F.explode(F.array(*map(F.lit, systems))).alias("system"))
    order = Window.partitionBy("sample_id").orderBy(hash_order(F.lit(seed), F.lit("blind"), "sample_id", "system"), "system")
    return rows.select("sample_id", "system", F.char((F.lit(64) + F.row_number().over(order)).cast("long")).alias("anon_id"))


def split_exact(df: DataFrame, id_col: str, seed: str, shares: Sequence[tuple[str, float]], rest: str, name: str = "split") -> DataFrame:
    """Splits of exactly floor(share * rows) rows in hash order; the remainder goes to `rest`."""
    placed = place(df, [hash_order(F.lit(seed), id_col), F.col(id_col)], "__place").crossJoin(df.agg(F.count("*").alias("__all")))
    label, ends = F.lit(None).cast("string"), F.lit(0)
    for split, share in shares:
        ends = ends + F.floor(F.col("__all") * F.lit(share)).cast("long")
        label = F.coalesce(label, F.when(F.col("__place") < ends, F.lit(split)))
    return placed.withColumn(name, F.coalesce(label, F.lit(rest))).drop("__place", "__all")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Ranks from 1 within groups; ties share the mean of their ranks. Found from counts of distinct values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(*by, value, (before + (F.col("__n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])
