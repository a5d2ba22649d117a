"""Descriptive and inferential statistics; an undefined one is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.draws import binomial, let, portable_uniform
from corpusloom.operators.sampling import average_ranks
from corpusloom.runtime import stored

#: Fixed value: the standard normal quantile of 0.975.
Z95 = 1.959963984540054


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """The value at place round((n - 1) * p), halves to even, of each group and point.

    Found from the counts of distinct values, so a group is never sorted row by row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__upto", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = lambda p: F.bround((F.col("__all") - 1) * F.lit(p)).cast("long")
    return counts.groupBy(*by).agg(*[F.min(F.when(F.col("__upto") > at(p), F.col(value))).alias(name) for name, p in points.items()])


def mean_or_nan(c: Column | str) -> Column:
    """Aggregate: the mean, NaN where there is no value."""
    return F.coalesce(F.avg(c), F.lit(float("nan")))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """(low, high) of the Wilson interval; null for n = 0."""
    some = F.nullif(n, F.lit(0))
    p = hits / some
    middle = (p + z * z / (2 * some)) / (1 + z * z / some)
    half = z * F.sqrt(p * (1 - p) / some + z * z / (4 * some * some)) / (1 + z * z / some)
    return middle - half, middle + half


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation; null for fewer than two pairs or a constant side (corr() would raise)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    sides = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.var_pop(sides[0]) * F.var_pop(sides[1])
    return F.try_divide(F.covar_pop(*sides), F.sqrt(F.when(spread > 1e-300, spread)))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, rho): correlation of average ranks."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(pairs, x, by, "__x"), y, by, "__y")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson("__x", "__y").alias("rho"))


def spearman_sets(df: DataFrame, x: str, y: str, by: str, every: str = "all", name: str = "scope") -> DataFrame:
    """(scope, n, rho): the correlation of average ranks in each group of `by`, and under `every` in all rows.

    Both come from one scan: grouping sets count the distinct pairs of values, which are stored, since they are read for each
    side's ranks and for the sums; ranks are sums over those counts, and the mean rank is known, so the sums are of what lies
    around it.
    """
    pairs = df.select(by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    cells = pairs.groupingSets([[by, "__x", "__y"], ["__x", "__y"]], by, "__x", "__y").agg(F.count("*").alias("__n"), F.grouping(by).alias("__all"))
    cells = stored(cells.select(F.when(F.col("__all") == 1, F.lit(every)).otherwise(F.col(by)).alias(name), "__x", "__y", "__n"), "rank-cells")
    cells = cells.where("__x is not null and __y is not null")  # not earlier: a filter would find the values a second time
    total = F.sum("__n").over(Window.partitionBy(name))
    for side in ("__x", "__y"):
        counts = cells.groupBy(name, side).agg(F.sum("__n").alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(name).orderBy(side).rowsBetween(Window.unboundedPreceding, 0))
        ranks = counts.select(F.col(name).alias("__s"), F.col(side).alias("__v"), (upto - (F.col("__n") - 1) / 2.0 - (total + 1) / 2.0).alias(f"{side}r"))
        cells = cells.join(ranks, F.col(name).eqNullSafe(F.col("__s")) & (F.col(side) == F.col("__v"))).drop("__s", "__v")
    moment = lambda a, b: F.sum(F.col("__n") * F.col(f"__{a}r") * F.col(f"__{b}r"))
    spread = F.sqrt(moment("x", "x")) * F.sqrt(moment("y", "y"))
    return cells.groupBy(name).agg(F.sum("__n").alias("n"), F.try_divide(moment("x", "y"), F.nullif(spread, F.lit(0.0))).alias("rho"))


def weighted_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, kappa) with quadratic weights; if no disagreement is expected 1 where none is found, else null."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    s = df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum((x - y) * (x - y)).alias("d"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy")
    )
    # The expected sum over all pairs of (x - y)² needs the marginals' first two moments alone.
    expected = (F.col("n") * F.col("xx") + F.col("n") * F.col("yy") - 2 * F.col("sx") * F.col("sy")) / F.col("n")
    kappa = F.when(expected == 0, F.when(F.col("d") == 0, 1.0)).otherwise(1 - F.try_divide(F.col("d"), expected))
    return s.select(*by, "n", kappa.alias("kappa"))


def binary_kappa(x: Column, y: Column) -> Column:
    """Aggregate: Cohen's kappa of two booleans; 1 if agreement is certain by chance, null without rows."""
    both = x.isNotNull() & y.isNotNull()
    n = F.nullif(F.count_if(both), F.lit(0))
    seen = F.count_if(both & (x == y)) / n
    p, q = F.count_if(both & x) / n, F.count_if(both & y) / n
    chance = p * q + (1 - p) * (1 - q)
    return F.when(chance == 1, 1.0).otherwise((seen - chance) / F.nullif(1 - chance, F.lit(0.0)))


def _multinomial(key: Sequence[str], n: Column, values: Column, start: Column, step, seed: str) -> Column:
    """Fold over n draws dealt to values (array of structs with count c): each in turn takes a binomial of what is left."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x["c"])

    def taken(acc: Column, x: Column) -> Column:
        chance = lambda t, salt: portable_uniform(F.lit(seed), *key, acc["i"], t, F.lit(salt))
        drawn = binomial(acc["left"], F.when(acc["mass"] <= x["c"], 1.0).otherwise(x["c"] / acc["mass"]), chance)
        return let(drawn, lambda k: F.struct((acc["left"] - k).alias("left"), (acc["mass"] - x["c"]).alias("mass"), (acc["i"] + 1).alias("i"), step(acc["out"], x, k).alias("out")))

    first = F.struct(n.cast("long").alias("left"), total.alias("mass"), F.lit(0).alias("i"), start.alias("out"))
    return F.aggregate(values, first, taken, lambda acc: acc["out"])


def bootstrap_means(df: DataFrame, value: str, by: Sequence[str], resamples: int, seed: str, cell: int = 256) -> DataFrame:
    """(by, b, mean): the means of `resamples` resamples with replacement of each group.

    How often a resample takes each distinct value is multinomial, so rows are counted by value first and neither
    ordered nor drawn one by one: the work is resamples x distinct values, whatever the rows. Distinct values lie in
    cells of about `cell` by a hash; a resample is dealt to cells, then within each. Draws come from hashes of the seed,
    the resample and the cell, so groups of the same values have the same resamples on any partitioning.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(*by).agg(F.ceil(F.count("*") / cell).alias("__cells"))
    counts = counts.join(sizes, list(by)) if by else counts.crossJoin(sizes)
    counts = stored(counts.withColumn("cell", F.pmod(F.xxhash64("v"), F.col("__cells"))), "bootstrap-counts")
    cells = counts.groupBy(*by, "cell").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("values"), F.sum("c").alias("c"))
    groups = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cell", "c"))).alias("cells"), F.sum("c").alias("n"))
    inside = lambda k, values: _multinomial(["b", "cell"], k, values, F.lit(0.0), lambda out, x, n: out + x["v"] * n, seed)
    if counts.where("cell > 0").isEmpty():
        alone = cells.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).repartition(*by, "b")
        return alone.select(*by, "b", (inside(F.col("c"), F.col("values")) / F.col("c")).alias("mean"))
    drawn = groups.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).repartition(*by, "b")
    dealt = _multinomial(["b"], F.col("n"), F.col("cells"), F.array().cast("array<struct<cell:bigint,k:bigint>>"), lambda out, x, k: F.array_append(out, F.struct(x["cell"].alias("cell"), k.alias("k"))), f"{seed}|cells")
    dealt = drawn.select(*by, "b", "n", F.explode(dealt).alias("d")).select(*by, "b", "n", "d.cell", "d.k")
    inner = dealt.join(cells.select(*by, "cell", "values"), [*by, "cell"])
    return inner.select(*by, "b", "n", inside(F.col("k"), F.col("values")).alias("s")).groupBy(*by, "b").agg((F.sum("s") / F.first("n")).alias("mean"))


def interval(means: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """(by, low, high): the middle 95 % of resample means, and what else is told of them in the same pass."""
    cut = means.groupBy(*by).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("__p"), *more)
    low, high = (F.get("__p", F.lit(k)).alias(name) for k, name in enumerate(("low", "high")))
    return cut.select(*by, low, high, *cut.columns[len(by) + 1 :])


def paired_bootstrap(df: DataFrame, difference: str, by: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """(by, n, difference, low, high, p_greater): mean of a difference, its interval, and how often a resample's mean
    is above 0, half counted for 0."""
    above = F.when(F.col("mean") > 0, 1.0).when(F.col("mean") == 0, 0.5).otherwise(0.0)
    out = interval(bootstrap_means(df, difference, by, resamples, seed), by, F.avg(above).alias("p_greater"))
    whole = df.groupBy(*by).agg(F.count(difference).alias("n"), F.avg(difference).alias("difference"))
    return whole.join(out, list(by)) if by else whole.crossJoin(out)
