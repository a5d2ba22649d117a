"""Overlap metrics of token arrays: n-gram multisets, ROUGE-N, longest common subsequence, ROUGE-L, compression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.draws import let
from corpusloom.functions.text import col


def _runs(tokens: Column | str, n: int, gram: Callable[[list[Column]], Column]) -> Column:
    """gram(the n tokens) of every place of a token array, in order; none if it is shorter.

    The array is found once, and tokens are taken from it by place: slices would copy all of it for each gram.
    """
    places = lambda t: F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
    return let(col(tokens), lambda t: F.transform(places(t), lambda i: gram([F.get(t, i + k) for k in range(n)])))


def ngrams(tokens: Column | str, n: int) -> Column:
    """The n-grams of a token array as arrays, in order; none if it is shorter."""
    return _runs(tokens, n, lambda g: F.array(*g))


def joined_ngrams(tokens: Column | str, n: int, sep: str = "\u0001") -> Column:
    """The n-grams as strings, which are cheaper to count than arrays."""
    return _runs(tokens, n, lambda g: F.concat_ws(sep, *g))


def scores(overlap: Column, predicted: Column, referred: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1); all 0 where a side is empty or nothing overlaps."""
    p = F.when(predicted > 0, overlap / predicted).otherwise(0.0)
    r = F.when(referred > 0, overlap / referred).otherwise(0.0)
    return p, r, F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)


def rouge_n(rows: DataFrame, keys: list[str], predicted: str, reference: str, n: int) -> DataFrame:
    """(keys, precision, recall, f1) of clipped n-gram overlap."""
    return rouge_ns(rows, keys, predicted, reference, [n]).select(*keys, *[F.col(f"{a}_{n}").alias(a) for a in ("precision", "recall", "f1")])


def rouge_ns(rows: DataFrame, keys: list[str], predicted: str, reference: str, sizes: list[int]) -> DataFrame:
    """(keys, precision_n, recall_n, f1_n for each n of sizes) of clipped n-gram overlap, each row by itself.

    A row's grams are counted where the row is, so nothing is shuffled and a task holds one row's grams at a time.
    """
    number = lambda c, n: F.coalesce(F.greatest(F.size(c) - (n - 1), F.lit(0)), F.lit(0))
    given = rows.select(*keys, *[clipped_overlap(predicted, reference, n).alias(f"__o{n}") for n in sizes], *[number(F.col(c), n).alias(f"__{a}{n}") for n in sizes for a, c in (("p", predicted), ("r", reference))])
    out = [c.alias(f"{a}_{n}") for n in sizes for c, a in zip(scores(*[F.col(f"__{x}{n}") for x in "opr"]), ("precision", "recall", "f1"), strict=True)]
    return given.select(*keys, *out)


def clipped_overlap(a: Column | str, b: Column | str, n: int) -> Column:
    """How many n-grams two token arrays share, each counted as often as the side has it that has it less; null shares none.

    Grams that both sides have count once each; of what a side has beyond its first of each gram, which is little, the grams
    of both are sorted together, of equal ones b's first, and each of a's takes one of b's that is left.
    """
    grams = lambda c: F.sort_array(col(c) if n == 1 else joined_ngrams(c, n))
    again = lambda t: F.filter(t, lambda x, k: F.get(t, k - 1) == x)
    side = lambda t, own: F.transform(again(t), lambda g: F.struct(g.alias("g"), F.lit(own).alias("own")))
    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(x["g"] == acc["g"], acc["left"]).otherwise(0)
        taken = F.struct(x["g"].alias("g"), F.greatest(left - 1, F.lit(0)).alias("left"), (acc["n"] + F.when(left > 0, 1).otherwise(0)).alias("n"))
        return F.when(x["own"], taken).otherwise(F.struct(x["g"].alias("g"), (left + 1).alias("left"), acc["n"].alias("n")))

    more = lambda s: F.aggregate(F.sort_array(F.concat(side(s["a"], True), side(s["b"], False))), start, step, lambda acc: acc["n"])
    both = let(F.struct(grams(a).alias("a"), grams(b).alias("b")), lambda s: F.size(F.array_intersect(s["a"], s["b"])) + more(s))
    return F.when(col(a).isNotNull() & col(b).isNotNull(), both).otherwise(0)


#: Bits of a word of the table's row: a sum of two words and a carry stays within a long.
WORD = 62


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of two token arrays, inside the JVM; null is as empty.

    What both begin and end with is counted and cut off. Of the rest, the row of the table is kept as bits over the shorter
    side, in words of 62: each token of the longer side that the other has adds its matches to the row, with the carry from
    word to word, and a bit that has gone to 0 is one more common token. Work is (longer side) x (words), and (shorter side)
    x (distinct common tokens) for the matches.
    """
    given = F.struct(*[F.coalesce(col(x), F.array().cast("array<string>")).alias(n) for x, n in ((a, "a"), (b, "b"))])
    less = lambda g: F.size(g["a"]) <= F.size(g["b"])
    sides = let(given, lambda g: F.struct(F.when(less(g), g["a"]).otherwise(g["b"]).alias("s"), F.when(less(g), g["b"]).otherwise(g["a"]).alias("l")))

    def alike(x: Column, y: Column) -> Column:
        """How many tokens the arrays begin with alike; x is no longer than y."""
        first_other = F.array_position(F.zip_with(x, F.slice(y, F.lit(1), F.size(x)), lambda u, v: u == v), F.lit(False))
        return F.when(first_other > 0, first_other.cast("int") - 1).otherwise(F.size(x))

    def rest(x: Column, head: Column, tail: Column) -> Column:
        return F.slice(x, head + 1, F.size(x) - head - tail)

    def cut(p: Column) -> Column:
        head = alike(p["s"], p["l"])
        tail = lambda n: alike(F.reverse(rest(p["s"], n, F.lit(0))), F.reverse(rest(p["l"], n, F.lit(0))))
        both = let(head, lambda n: F.struct(n.alias("head"), tail(n).alias("tail")))
        return let(both, lambda e: F.struct((e["head"] + e["tail"]).cast("long").alias("n"), rest(p["s"], e["head"], e["tail"]).alias("s"), rest(p["l"], e["head"], e["tail"]).alias("l")))

    def power(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def matches(s: Column, x: Column) -> Column:
        """The bits of x in s, a word after the other."""
        bit = lambda part, k: F.when(F.get(part, k) == x, power(k)).otherwise(F.lit(0).cast("long"))
        bits = lambda part: F.aggregate(F.sequence(F.lit(0), F.size(part) - 1), F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(bit(part, k)))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / WORD).cast("int")), lambda w: let(F.slice(s, w * WORD + 1, WORD), bits))

    full = F.lit((1 << WORD) - 1).cast("long")

    def add(row: Column, hits: Column) -> Column:
        """(row + (row & hits)) | (row & ~hits), over words."""
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def word(acc: Column, p: Column) -> Column:
            total = p["v"] + p["v"].bitwiseAND(p["m"]) + acc["carry"]
            kept = lambda t: t.bitwiseAND(full).bitwiseOR(p["v"].bitwiseAND(F.bitwise_not(p["m"])))
            return let(total, lambda t: F.struct(F.shiftright(t, WORD).alias("carry"), F.array_append(acc["out"], kept(t)).alias("out")))

        return F.aggregate(F.zip_with(row, hits, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), start, word, lambda acc: acc["out"])

    def few(s: Column, known: Column, longer: Column) -> Column:
        """For a row of one word."""
        table = F.map_from_arrays(known, F.transform(known, lambda x: F.get(matches(s, x), F.lit(0))))
        step = lambda v, m: (v + v.bitwiseAND(m)).bitwiseAND(full).bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
        ended = let(table, lambda t: F.aggregate(longer, full, lambda v, x: let(F.try_element_at(t, x), lambda m: F.when(m.isNull(), v).otherwise(step(v, m)))))
        return F.bit_count(F.bitwise_not(ended).bitwiseAND(power(F.size(s)) - 1))

    def many(s: Column, known: Column, longer: Column) -> Column:
        table = F.map_from_arrays(known, F.transform(known, lambda x: matches(s, x)))
        row = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / WORD).cast("int")), lambda _: full)
        ended = let(table, lambda t: F.aggregate(longer, row, lambda v, x: let(F.try_element_at(t, x), lambda m: F.when(m.isNull(), v).otherwise(add(v, m)))))
        valid = lambda w: F.when((w + 1) * WORD <= F.size(s), full).otherwise(power(F.pmod(F.size(s), F.lit(WORD))) - 1)
        return F.aggregate(F.transform(ended, lambda v, w: F.bit_count(F.bitwise_not(v).bitwiseAND(valid(w)))), F.lit(0), lambda n, x: n + x)

    def counted(p: Column) -> Column:
        of = lambda known: F.when(F.size(known) == 0, 0).when(F.size(p["s"]) <= WORD, few(p["s"], known, p["l"])).otherwise(many(p["s"], known, p["l"]))
        return p["n"] + let(F.array_intersect(p["s"], p["l"]), of)

    return let(let(sides, cut), counted)


def rouge_l(predicted: Column | str, reference: Column | str) -> Column:
    """A struct (precision, recall, f1) by the longest common subsequence, which is found once."""
    sides = F.struct(col(predicted).alias("p"), col(reference).alias("r"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    named = lambda x, n: F.struct(*[c.alias(a) for c, a in zip(scores(n, size(x["p"]), size(x["r"])), ("precision", "recall", "f1"), strict=True)])
    return let(sides, lambda x: let(lcs_length(x["p"], x["r"]), lambda n: named(x, n)))


def compression(predicted: Column | str, source: Column | str) -> Column:
    """Predicted over source tokens, 0 for an empty source."""
    return F.when(F.size(col(source)) > 0, F.size(col(predicted)) / F.nullif(F.size(col(source)), F.lit(0))).otherwise(0.0)


def banned_next(ids: Column | str, n: int) -> Column:
    """Ids that would repeat an n-gram of the history if they came next; distinct, ascending; none for n = 0."""
    h = col(ids)
    if n < 1:
        return F.slice(h, 1, 0)
    tail = F.slice(h, F.greatest(F.size(h) - n + 2, F.lit(1)), n - 1)
    starts = F.sequence(F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(1)))
    hits = F.filter(starts, lambda i: F.slice(h, i, n - 1) == tail)
    return F.when(F.size(h) >= n, F.array_sort(F.array_distinct(F.transform(hits, lambda i: F.element_at(h, i + n - 1))))).otherwise(F.slice(h, 1, 0))
