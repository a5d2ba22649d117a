"""Exact random draws as Column expressions, from hashes: the same on every run and partitioning."""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import unit_hash

#: chance(step, salt): independent uniform numbers between 0 and 1.
Chance = Callable[[Column, int], Column]


def uniform(*parts: Column | str) -> Column:
    """A number between 0 and 1 from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def portable_uniform(*parts: Column | str) -> Column:
    """A number between 0 and 1 from the parts' MD5, which any engine repeats."""
    return (unit_hash(*parts) + F.lit(0.5)) / F.lit(float(1 << 48))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def log_factorial(n: Column) -> Column:
    """ln n!, by the asymptotic series at n + 8, exact to a double's last digits there, less the eight factors between."""
    between = F.lit(1.0)
    for k in range(1, 9):
        between = between * (n + k)
    return let(n + F.lit(8.0), lambda x: (x + 0.5) * F.ln(x) - x + F.lit(0.5 * log(2 * pi)) + (1 - (1 - F.lit(2 / 7) / (x * x)) / (30 * x * x)) / (12 * x)) - F.ln(between)


def by_ratio(mean: Column, variance: Column, mode: Column, end: Column, cost: Callable[[Column], Column], chance: Chance) -> Column:
    """An exact draw from weights exp(-cost(k)), k from 0 to below end, by the ratio of uniforms.

    Points under the table mountain around the mean are accepted or rejected on the exact weights. A try fails about one
    time in three, so 200 tries are as good as endless; the mode would stand in.
    """
    #: The constants are 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
    spread = lambda v: F.sqrt(v + 0.5) * 1.7155277699214135 + 0.8989161620588988
    accept = lambda u, d: (u * (4 - u) - 3 <= d) | ((u * (u - d) < 1) & (2 * F.ln(u) <= d))

    def tried(f: Column, t: Column) -> Column:
        at = lambda u: f["a"] + f["h"] * (chance(t, 2) - 0.5) / u
        judged = lambda u, x: F.when((x >= 0) & (x < f["end"]), let(whole(x), lambda k: F.when(let(f["g"] - cost(k), lambda d: accept(u, d)), k)))
        return let(chance(t, 1), lambda u: let(at(u), lambda x: judged(u, x)))

    facts = F.struct((mean + 0.5).alias("a"), spread(variance).alias("h"), cost(mode).alias("g"), end.alias("end"), mode.alias("mode"))
    none, long = F.lit(None).cast("long"), lambda x: F.lit(x).cast("long")
    kept = lambda got, more: F.when(got.isNotNull(), got).otherwise(more)
    eight = lambda f, r: F.aggregate(F.sequence(r * 8 + 1, r * 8 + 8), none, lambda got, t: kept(got, tried(f, t)))
    tries = lambda f: F.aggregate(F.sequence(long(0), long(24)), none, lambda got, r: kept(got, eight(f, r)))
    return let(facts, lambda f: F.coalesce(tries(f), f["mode"]))


def hypergeometric(marked: Column, pop: Column, take: Column, chance: Chance) -> Column:
    """How many of `take` items drawn from `pop` without replacement are among its `marked` ones: an exact draw.

    Up to ten items are drawn one by one, more by the ratio of uniforms, at any size.
    """
    urn = F.struct(F.least(take, pop - take).alias("m"), F.least(marked, pop - marked).alias("less"), F.greatest(marked, pop - marked).alias("more"), pop.alias("pop"))

    def one_by_one(s: Column) -> Column:
        few, many = F.least(s["m"], s["less"]), F.greatest(s["m"], s["less"])
        step = lambda got, t: got + F.when(chance(t, 0) < (many - got) / (s["pop"] - t + 1), 1).otherwise(0).cast("long")
        return F.when(few <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(few, F.lit(1))), F.lit(0).cast("long"), step))

    def many(s: Column) -> Column:
        p = s["less"] / s["pop"]
        mean = s["m"] * p
        variance = (s["pop"] - s["m"]) * mean * (1 - p) / F.greatest(s["pop"] - 1, F.lit(1))
        mode = whole((s["m"] + 1) * ((s["less"] + 1) / (s["pop"] + 2)))
        end = F.least(F.least(s["m"], s["less"]) + 1, whole(mean + 0.5 + 16 * F.sqrt(variance + 0.5)))
        cost = lambda k: log_factorial(k) + log_factorial(s["less"] - k) + log_factorial(s["m"] - k) + log_factorial(s["more"] - s["m"] + k)
        return by_ratio(mean, variance, mode, end, cost, chance)

    def drawn(s: Column) -> Column:
        lesser = F.when(F.least(s["m"], s["less"]) <= 10, one_by_one(s)).otherwise(many(s))
        among = let(lesser, lambda z: F.when(marked * 2 > pop, s["m"] - z).otherwise(z))
        return let(among, lambda z: F.when(s["m"] < take, marked - z).otherwise(z))

    return let(urn, drawn)


def binomial(n: Column, p: Column, chance: Chance) -> Column:
    """How many of n tries of chance p succeed: an exact draw, one by one up to ten tries, else by the ratio of uniforms."""
    facts = F.struct(n.cast("long").alias("n"), F.least(p, 1 - p).alias("p"))

    def one_by_one(s: Column) -> Column:
        step = lambda got, t: got + F.when(chance(t, 0) < s["p"], 1).otherwise(0).cast("long")
        return F.when(s["n"] <= 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(s["n"], F.lit(1).cast("long"))), F.lit(0).cast("long"), step))

    def many(s: Column) -> Column:
        mean = s["n"] * s["p"]
        variance = mean * (1 - s["p"])
        end = F.least(s["n"] + 1, whole(mean + 0.5 + 16 * F.sqrt(variance + 0.5)))
        cost = lambda k: log_factorial(k) + log_factorial(s["n"] - k) - k * F.ln(s["p"] / (1 - s["p"]))
        return by_ratio(mean, variance, whole((s["n"] + 1) * s["p"]), end, cost, chance)

    def drawn(s: Column) -> Column:
        fewer = F.when(s["p"] <= 0, F.lit(0).cast("long")).when(s["n"] <= 10, one_by_one(s)).otherwise(many(s))
        return let(fewer, lambda z: F.when(p > 0.5, s["n"] - z).otherwise(z))

    return let(facts, drawn)
