"""Rule-based sentence splitting and lead summaries, as regular-expression chains inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.draws import let
from corpusloom.functions.text import UWS, col, pstrip

#: Abbreviations whose full stop ends no sentence before a capital.
ABBREVIATIONS = ("BS", "TS", "GS", "PGS", "ThS", "KS", "NSND", "NSƯT", "TP")
DOT, END = "\u0001", "\u0002"


def split_sentences(c: Column | str) -> Column:
    """Sentences of a text, stripped; blank texts have none.

    An end mark with an optional closing quote ends a sentence before a capital, a digit, an opening quote or bracket,
    or the end; line ends always do. The stop of an abbreviation before a capital doesn't, nor an ellipsis before a
    small letter. Any capital of any script counts.
    """
    t = pstrip(c)
    first = "".join(sorted({a[0] for a in ABBREVIATIONS}))  # cheaper to look for than what lies before
    t = F.regexp_replace(t, rf"(?=[{first}])(?<![\p{{L}}\p{{N}}_])({'|'.join(ABBREVIATIONS)})\.{UWS}+(?=\p{{Lu}})", f"$1{DOT} ")
    t = F.regexp_replace(t, rf"(\.\.\.|…){UWS}+(?=\p{{Ll}})", "$1 ")
    t = F.regexp_replace(t, rf"([.!?…][\"”']?){UWS}+(?=[\p{{Lu}}\p{{Nd}}\"“(])", f"$1{END}")
    parts = F.split(F.regexp_replace(t, r"\n+", END), END)
    clean = F.transform(parts, lambda s: F.replace(pstrip(s), F.lit(DOT), F.lit(".")))
    return F.when(col(c).isNull(), F.array().cast("array<string>")).otherwise(F.filter(clean, lambda s: s != ""))


def first_sentences(c: Column | str, n: int, head: int = 1024) -> Column:
    """The first n sentences, those of slice(split_sentences(c), 1, n), without taking a long text apart.

    Where a sentence ends is told by the marks, the white space and the one character around the end. So if the first `head`
    characters hold more than n sentences, the first n of them end inside and are the text's; else the whole text is split.
    """
    text = col(c)
    enough = lambda s: F.when((F.size(s) > n) | (F.length(text) <= head), F.slice(s, 1, n))
    return F.coalesce(let(split_sentences(F.substring(text, 1, head)), enough), F.slice(split_sentences(text), 1, n))


def lead(c: Column | str, n: int) -> Column:
    """The first n sentences joined by a space; the whole text where there is none."""
    return F.coalesce(F.nullif(F.array_join(first_sentences(c, n), " "), F.lit("")), col(c))
