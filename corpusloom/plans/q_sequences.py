"""Queries of token-id datasets, tokenizer statistics, padding, decoding constraints and sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.functions import text as X
from corpusloom.operators import sequences as Q
from corpusloom.plans import views as V
from corpusloom.plans.registry import query
from corpusloom.runtime import stored, table

VOCAB = f"""select token, row_number() over (order by n desc, token)::int + 3 id from (select token, count(*) n from (select unnest({V.tokens_sql('text')}) token
 from conversations) group by token having count(*) >= 2)"""
PAIRS = f"select conv_id, turn, {V.tokens_sql('source')} s, {V.tokens_sql('target')} t, {V.words_sql('source')} sw, {V.words_sql('target')} tw from ({V.TURNS})"
IDS = f"""(with v as (select map_from_entries(list((token, id))) m from ({VOCAB})) select conv_id, turn, sw, tw, list_transform(s, lambda x: coalesce(m[x], 1)) s, list_transform(t, lambda x: coalesce(m[x], 1)) t from ({PAIRS}), v)"""
SAMPLES = f"""(select conv_id, turn, s[1:767] || [3] source_ids, [2] || t decoder_input_ids, t || [3] labels, len(s[1:767]) + 1 source_len, len(t) + 1 target_len,
 len(s) > 767 was_source_truncated from {IDS} where len(t) <= 95)"""
KEYS = ["conv_id", "turn"]


def encoded(spark, d):
    texts = table(spark, d, "conversations").select(X.tokens("text").alias("t"))
    vocab = stored(Q.vocabulary(texts, "t"), "vocabulary")
    pairs = V.turns(spark, d).select(*KEYS, X.tokens("source").alias("s"), X.tokens("target").alias("t"))
    return Q.ids_of(pairs, KEYS, {"source": "s", "target": "t"}, vocab)


def sizes(spark, d):
    n = V.turns(spark, d).select(*KEYS, X.word_count("source").alias("sw"), X.word_count("target").alias("tw"))
    return encoded(spark, d).join(n, KEYS).withColumn("sn", F.size("source").cast("long")).withColumn("tn", F.size("target").cast("long"))


@query(f"select conv_id, turn, source_ids, decoder_input_ids, labels, source_len::int source_len, target_len::int target_len, was_source_truncated from {SAMPLES}")
def token_dataset(spark, d):
    return Q.samples(encoded(spark, d), KEYS)


@query(f"""select count(*) n, min(source_len)::bigint source_min, max(source_len)::bigint source_max, min(target_len)::bigint target_min, max(target_len)::bigint
 target_max, max(source_len) <= 768 and max(target_len) <= 96 and min(target_len) > 0 within_limits from {SAMPLES}""")
def token_length_stats(spark, d):
    s, t = F.col("source_len").cast("long"), F.col("target_len").cast("long")
    ok = (F.max(s) <= 768) & (F.max(t) <= 96) & (F.min(t) > 0)
    return Q.samples(encoded(spark, d), KEYS).agg(F.count("*").alias("n"), F.min(s).alias("source_min"), F.max(s).alias("source_max"), F.min(t).alias("target_min"), F.max(t).alias("target_max"), ok.alias("within_limits"))


@query(f"""select count(*) n_total, count(*) filter (len(t) > 95) n_dropped, count(*) filter (len(s) > 767) n_truncated, count(*) filter (len(t) <= 95) n_saved,
 round(100.0 * count(*) filter (len(t) <= 95) / count(*), 6) saved_percent from {IDS}""")
def build_counters(spark, d):
    fits = F.size("target") <= 95
    return encoded(spark, d).agg(F.count("*").alias("n_total"), F.count_if(~fits).alias("n_dropped"), F.count_if(F.size("source") > 767).alias("n_truncated"), F.count_if(fits).alias("n_saved"), F.round(100.0 * F.count_if(fits) / F.count("*"), 6).alias("saved_percent"))


@query(f"""select quantile_cont(len(t), 0.5)::double p50, quantile_cont(len(t), 0.75)::double p75, quantile_cont(len(t), 0.9)::double p90, quantile_cont(len(t),
 0.95)::double p95, round(avg(len(t)), 6) mean from {IDS}""")
def token_length_percentiles(spark, d):
    found = encoded(spark, d).agg(F.percentile(F.size("target"), F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95)))).alias("p"), F.round(F.avg(F.size("target")), 6).alias("mean"))
    return found.select(*[F.get("p", F.lit(k)).alias(f"p{n}") for k, n in enumerate((50, 75, 90, 95))], "mean")


@query(f"select round(coalesce(sum(len(s) + len(t)) / nullif(sum(sw + tw), 0), 0), 6) fertility from {IDS}")
def fertility_micro(spark, d):
    words = F.nullif(F.sum(F.col("sw") + F.col("tw")), F.lit(0))
    return sizes(spark, d).agg(F.round(F.coalesce(F.sum(F.col("sn") + F.col("tn")) / words, F.lit(0.0)), 6).alias("fertility"))


@query(f"""select round(avg(f), 6) mean, round(quantile_cont(f, 0.5), 6) median, round(quantile_cont(f, 0.95), 6) p95
 from (select (len(s) + len(t))::double / nullif(sw + tw, 0) f from {IDS})""")
def fertility_macro(spark, d):
    f = (F.col("sn") + F.col("tn")) / F.nullif(F.col("sw") + F.col("tw"), F.lit(0))
    found = sizes(spark, d).agg(F.round(F.avg(f), 6).alias("mean"), F.percentile(f, F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
    return found.select("mean", F.round(F.get("p", F.lit(0)), 6).alias("median"), F.round(F.get("p", F.lit(1)), 6).alias("p95"))


@query(f"""select sum(u)::bigint n_unk, sum(n)::bigint n_ids, round(100.0 * sum(u) / sum(n), 6) percent
 from (select len(list_filter(s || t, lambda x: x = 1)) u, len(s) + len(t) n from {IDS})""")
def unk_rate(spark, d):
    both = F.concat("source", "target")
    unk, n = F.sum(F.size(F.filter(both, lambda x: x == Q.UNK))), F.sum(F.size(both))
    return encoded(spark, d).agg(unk.alias("n_unk"), n.alias("n_ids"), F.round(100.0 * unk / n, 6).alias("percent"))


@query(f"""select round(avg((len(s) > 768)::int), 6) source_rate, round(avg((len(t) > 96)::int), 6) target_rate, round(avg((len(s) > 768 or len(t) > 96)::int),
 6) either_rate from {IDS}""")
def truncation_rates(spark, d):
    s, t = F.size("source") > 768, F.size("target") > 96
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    return encoded(spark, d).agg(rate(s, "source_rate"), rate(t, "target_rate"), rate(s | t, "either_rate"))


@query(f"""select conv_id, turn, source_ids || list_transform(generate_series(1, m - len(source_ids)), lambda x: 0) padded, list_transform(source_ids, lambda x:
 true) || list_transform(generate_series(1, m - len(source_ids)), lambda x: false) mask
 from (select *, max(len(source_ids)) over (partition by conv_id // 8) m from {SAMPLES})""")
def pad_batch(spark, d):
    rows = Q.samples(encoded(spark, d), KEYS).withColumn("batch", F.floor(F.col("conv_id") / 8))
    return Q.padded(rows, "batch", "source_ids").select(*KEYS, "padded", "mask")


@query(f"select conv_id, turn, labels[1:len(labels) - 1] ids, decoder_input_ids[2:] again from {SAMPLES}")
def strip_specials(spark, d):
    return Q.samples(encoded(spark, d), KEYS).select(*KEYS, Q.without_specials("labels").alias("ids"), Q.without_specials("decoder_input_ids").alias("again"))


@query(f"""select conv_id, turn, decoder_input_ids[1] = 2 starts, labels[len(labels)] = 3 ends, len(labels) = len(decoder_input_ids) as same_length,
 labels[1:len(labels) - 1] = decoder_input_ids[2:] same_text from {SAMPLES}""")
def shift_invariants(spark, d):
    rows = Q.samples(encoded(spark, d), KEYS)
    return rows.select(*KEYS, (F.get("decoder_input_ids", F.lit(0)) == Q.BOS).alias("starts"), (F.element_at("labels", -1) == Q.EOS).alias("ends"), (F.size("labels") == F.size("decoder_input_ids")).alias("same_length"), (Q.without_specials("labels") == Q.without_specials("decoder_input_ids")).alias("same_text"))


@query(f"""select conv_id, turn, case when len(t) >= 3 then list_sort(list_distinct(list_transform(list_filter(generate_series(1, len(t) - 2), lambda i: t[i:i +
 1] = t[len(t) - 1:]), lambda i: t[i + 2]))) else [] end banned from (select conv_id, turn, t from {IDS})""")
def banned_next_tokens(spark, d):
    return encoded(spark, d).select(*KEYS, M.banned_next("target", 3).alias("banned"))


BEAMS = f"""select doc_id sample_id, b as beam, -1.0 - {V.draw_sql('''doc_id || '|' || b || '|score' ''', 1000)} / 100.0 score, 5 +
 {V.draw_sql('''doc_id || '|' || b || '|len' ''', 60)} len from (select doc_id, unnest(generate_series(1, 4)) b from documents)"""


def beams(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("beam"))
    score = F.lit(-1.0) - V.draw("sample_id", "beam", F.lit("score"), out_of=1000) / 100.0
    return rows.withColumn("score", score).withColumn("len", 5 + V.draw("sample_id", "beam", F.lit("len"), out_of=60))


@query(f"""select sample_id, beam, rank, round(p, 6) penalized from (select *, row_number() over (partition by sample_id order by p desc, beam)::int rank
 from (select sample_id, beam, score::double / pow((5 + len) / 6.0, 1.1) p from ({BEAMS}))) where rank <= 2""")
def beam_rerank(spark, d):
    return Q.best_beams(beams(spark, d), "sample_id", "score", "len", 1.1, 2).select("sample_id", "beam", "rank", F.round("penalized", 6).alias("penalized"))


@query(f"""with x as (select b.sample_id, b.beam, a.alpha, b.score::double / pow((5 + len) / 6.0, a.alpha) p
 from ({BEAMS}) b, (select unnest([0.8, 1.0, 1.1])::double alpha) a), g as (select alpha, sample_id, max(p) best from x group by all)
 select 'beam4_lp' || alpha || '_nr3' config, round(avg(best), 6) metric, row_number() over (order by round(avg(best), 6) desc, alpha)::int rank from g
 group by alpha""")
def config_leaderboard(spark, d):
    from pyspark.sql import Window

    rows = beams(spark, d).withColumn("alpha", F.explode(F.array(F.lit(0.8), F.lit(1.0), F.lit(1.1))))
    best = rows.groupBy("alpha", "sample_id").agg(F.max(Q.penalized(F.col("score"), F.col("len"), F.col("alpha"))).alias("best"))
    means = best.groupBy("alpha").agg(F.round(F.avg("best"), 6).alias("metric"))
    config = F.concat(F.lit("beam4_lp"), F.col("alpha").cast("string"), F.lit("_nr3"))
    return means.select(config.alias("config"), "metric", F.row_number().over(Window.orderBy(F.desc("metric"), "alpha")).alias("rank"))


@query()
def unigram_pieces(spark, d):
    """Turns of conversations as ids of scored pieces, by the best path; the pieces are words and letters of the turns."""
    from corpusloom.operators import decoding

    t = table(spark, d, "conversations")
    words = t.select(F.explode(X.words("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    vocabulary = stored(decoding.word_pieces(words, "token", "n", 8000), "pieces")
    return decoding.encode_pieces(t.select("conv_id", "turn", "text"), "text", vocabulary).select("conv_id", "turn", "ids")


def next_scores(sources, tokens):
    """A stand-in for a network: prefers the source's tokens in order, then the end mark."""
    out, rows = np.zeros((len(sources), 64)), np.arange(len(sources))
    place = np.array([len(own) - 1 for own in tokens], int)
    out[rows, [source[k] % 60 + 4 if k < len(source) else 3 for source, k in zip(sources, place.tolist(), strict=True)]] = 2.0
    out[rows, 4 + (place * 7) % 60] += 1.0
    return out


def ordered_parts(spark, d):
    """(l_orderkey, ids): parts of an order by line. The number of partitions is given, since adaptive ones go by bytes and
    would leave small rows that are dear to decode to few cores."""
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("int").alias("p")).repartition(n, "l_orderkey")
    return lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))), lambda s: s["p"]).alias("ids"))


@query()
def greedy_decode(spark, d):
    """Greedy decoding of parts by order with a stand-in scorer: at least 2, at most 12 tokens, no trigram twice."""
    from corpusloom.operators import decoding

    return decoding.decode_greedily(ordered_parts(spark, d), "ids", next_scores, 12, 2, 3).select("l_orderkey", "decoded")


@query()
def beam_decode(spark, d):
    """The same by a search of 4 beams with length penalty 1.1."""
    from corpusloom.operators import decoding

    return decoding.decode_beams(ordered_parts(spark, d), "ids", next_scores, 4, 12, 2, 3, 1.1).select("l_orderkey", "decoded")
