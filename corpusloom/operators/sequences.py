"""Token-id sequences: a corpus vocabulary, training samples, padding, special ids, beam ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import col
from corpusloom.operators.sampling import place

#: The reserved ids.
PAD, UNK, BOS, EOS = 0, 1, 2, 3


def vocabulary(rows: DataFrame, tokens: str, least: int = 2) -> DataFrame:
    """(token, id): tokens that occur `least` times or more, the commonest first from id 4 on, ties by token."""
    counts = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return place(counts, [-F.col("n"), F.col("token")]).select("token", (F.col("place") + EOS + 1).cast("int").alias("id"))


def ids_of(rows: DataFrame, keys: list[str], tokens: dict[str, str], vocab: DataFrame) -> DataFrame:
    """(keys, and for each name in `tokens` the ids of that array of tokens); unknown tokens are UNK.

    All arrays are looked up in one join; each row's ids are put together again in order.
    """
    named = lambda n: lambda t, i: F.struct(F.lit(n).alias("name"), i.alias("pos"), t.alias("token"))
    parts = [F.transform(F.col(c), named(n)) for n, c in tokens.items()]
    flat = rows.select(*keys, F.explode(F.concat(*parts)).alias("x")).select(*keys, "x.*")
    found = flat.join(vocab, "token", "left").withColumn("id", F.coalesce("id", F.lit(UNK)))
    pick = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("pos", "id")))), lambda s: s["id"])
    made = found.groupBy(*keys).agg(*[pick(n).alias(n) for n in tokens])
    none = F.array().cast("array<int>")
    return rows.select(*keys).join(made, keys, "left").select(*keys, *[F.coalesce(n, none).alias(n) for n in tokens])


def samples(encoded: DataFrame, keys: list[str], source: str = "source", target: str = "target", most_source: int = 768, most_target: int = 96) -> DataFrame:
    """Training samples: sources cut to fit their end mark, longer targets dropped, decoder inputs shifted by BOS."""
    fits = encoded.where(F.size(target) <= most_target - 1)
    source_ids = F.concat(F.slice(source, 1, most_source - 1), F.array(F.lit(EOS)))
    decoder, labels = F.concat(F.array(F.lit(BOS)), F.col(target)), F.concat(F.col(target), F.array(F.lit(EOS)))
    return fits.select(*keys, source_ids.alias("source_ids"), decoder.alias("decoder_input_ids"), labels.alias("labels"), F.size(source_ids).alias("source_len"), F.size(labels).alias("target_len"), (F.size(source) > most_source - 1).alias("was_source_truncated"))


def padded(rows: DataFrame, batch: str, ids: str) -> DataFrame:
    """rows with padded ids and their mask, as long as the longest of the batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    gap = F.col("__longest") - F.size(ids)
    out = rows.withColumn("__longest", longest)
    return out.withColumn("mask", F.concat(F.transform(ids, lambda _: F.lit(True)), F.array_repeat(F.lit(False), gap))).withColumn("padded", F.concat(F.col(ids), F.array_repeat(F.lit(PAD), gap))).drop("__longest")


def without_specials(ids: Column | str) -> Column:
    """Ids before the first end mark, without reserved ones but UNK."""
    x = col(ids)
    end = F.array_position(x, EOS)
    return F.filter(F.when(end > 0, F.slice(x, F.lit(1), (end - 1).cast("int"))).otherwise(x), lambda i: ~i.isin(PAD, BOS, EOS))


def penalized(score: Column, length: Column, alpha: Column | float) -> Column:
    """A hypothesis' log probability over its length penalty."""
    return score / F.pow((5 + length) / 6, F.lit(alpha) if isinstance(alpha, float) else alpha)


def best_beams(hypotheses: DataFrame, sample: str, score: str, length: str, alpha: float, k: int) -> DataFrame:
    """The k best hypotheses of each sample by penalised score, ties by beam; cut in every task before the shuffle."""
    ranked = hypotheses.withColumn("penalized", penalized(F.col(score), F.col(length), alpha))
    by_score = Window.partitionBy(sample).orderBy(F.desc("penalized"), "beam")
    return ranked.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
