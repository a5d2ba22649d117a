"""Queries of overlap metrics, descriptive statistics, intervals and agreement."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import metrics as M
from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.plans import views as V
from corpusloom.plans.registry import query
from corpusloom.runtime import dealt_table as table

PAIR_TOKENS = f"select conv_id, turn, {V.tokens_sql('target')} p, {V.tokens_sql('source')} r, {V.tokens_sql('source')} s from ({V.TURNS})"


def pair_tokens(spark, d):
    return V.turns(spark, d).select("conv_id", "turn", "role", X.tokens("target").alias("p"), X.tokens("source").alias("r"))


def grams_sql(t: str, n: int) -> str:
    return f"list_transform(generate_series(1, len({t}) - {n} + 1), lambda i: array_to_string({t}[i:i + {n - 1}], chr(1)))"


def rouge_sql(n: int, rows: str = PAIR_TOKENS, keys: str = "conv_id, turn") -> str:
    side = lambda t: f"select {keys}, g, count(*) n from (select {keys}, unnest({grams_sql(t, n)}) g from ({rows})) group by all"
    return f"""with p as ({side('p')}), r as ({side('r')}), o as (select {keys}, sum(least(p.n, r.n)) o from p join r using ({keys}, g) group by all),
 k as (select {keys}, coalesce(o, 0) o, greatest(len(p) - {n - 1}, 0) p, greatest(len(r) - {n - 1}, 0) r from ({rows}) left join o using ({keys})),
 m as (select {keys}, case when p > 0 then o::double / p else 0 end a, case when r > 0 then o::double / r else 0 end b from k)
 select {keys}, round(a, 6) as precision, round(b, 6) recall, round(case when a + b > 0 then 2 * a * b / (a + b) else 0 end, 6) f1 from m"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(rouge_sql(1))
def rouge_1(spark, d):
    return rounded(M.rouge_n(pair_tokens(spark, d), ["conv_id", "turn"], "p", "r", 1), "precision", "recall", "f1")


@query(rouge_sql(2))
def rouge_2(spark, d):
    return rounded(M.rouge_n(pair_tokens(spark, d), ["conv_id", "turn"], "p", "r", 2), "precision", "recall", "f1")


@query(f"select gram, count(*) n from (select unnest({grams_sql('t', 2)}) gram from (select {V.tokens_sql('text')} t from documents)) group by gram")
def ngram_counts(spark, d):
    grams = table(spark, d, "documents").select(F.explode(M.joined_ngrams(X.tokens("text"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def lcs_sql(rows: str) -> str:
    """rows (keys, p, r) with n, the length of the longest common subsequence, found another way than in Spark.

    Of what is left between a common beginning and end, every token of p in turn lowers the least places in r where common
    subsequences of 1, 2, ... tokens can end; how many such places there are in the end is the length.
    """
    alike = lambda a, b: f"coalesce(nullif(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]), false), 0) - 1, least(len({a}), len({b})))"
    lower = "list_filter(list_transform(range(1, len(t) + 2), lambda k: least(coalesce(t[k], 2000000000), coalesce(list_min(list_filter(js, lambda j: j > coalesce(t[k - 1], 0))), 2000000000))), lambda j: j < 2000000000)"
    places = "list_filter(list_transform(a, lambda x: list_filter(range(1, len(b) + 1), lambda j: b[j] = x)), lambda js: len(js) > 0)"
    return f"""select * exclude (head, a, b), head + len(list_reduce({places}, lambda t, js: {lower}, []::bigint[])) n from (
 select * exclude (head, tail, a, b), head + tail head, a[:len(a) - tail] a, b[:len(b) - tail] b from (
 select *, {alike('list_reverse(a)', 'list_reverse(b)')} tail from (select *, p[head + 1:] a, r[head + 1:] b from (select *, {alike('p', 'r')} head from ({rows})))))"""


def rouge_l_sql(rows: str) -> str:
    """rows (keys, p, r) with a, b and f: ROUGE-L precision, recall and F1."""
    return f"""select *, case when a + b > 0 then 2 * a * b / (a + b) else 0 end f from (
 select *, case when len(p) > 0 then n::double / len(p) else 0 end a, case when len(r) > 0 then n::double / len(r) else 0 end b from ({lcs_sql(rows)}))"""


@query(f"select conv_id, turn, n lcs from ({lcs_sql(PAIR_TOKENS)})")
def lcs_length(spark, d):
    return pair_tokens(spark, d).select("conv_id", "turn", M.lcs_length("p", "r").alias("lcs"))


@query(f"select conv_id, turn, round(a, 6) as precision, round(b, 6) recall, round(f, 6) f1 from ({rouge_l_sql(PAIR_TOKENS)})")
def rouge_l(spark, d):
    return rounded(pair_tokens(spark, d).select("conv_id", "turn", M.rouge_l("p", "r").alias("x")).select("conv_id", "turn", "x.*"), "precision", "recall", "f1")


@query(f"select conv_id, turn, round(case when len(s) > 0 then len(p)::double / len(s) else 0 end, 6) ratio from ({PAIR_TOKENS})")
def compression_ratio_tokens(spark, d):
    return pair_tokens(spark, d).select("conv_id", "turn", F.round(M.compression("p", "r"), 6).alias("ratio"))


@query(f"""with p as ({V.PREDICTIONS}), m as ({V.MANIFEST}), x as (select p.system, {V.words_sql('p.prediction')}::double / nullif({V.words_sql('m.source')}, 0)
 c from p join m using (id)) select round(avg(c) filter (system = 'lead1'), 6) lead1, round(avg(c) filter (system = 'lead3'), 6) lead3 from x""")
def compression_ratio(spark, d):
    m = V.manifest(spark, d).select("id", X.word_count("source").alias("s"))
    rows = V.predictions(spark, d).select("id", "system", X.word_count("prediction").alias("p")).join(m, "id").withColumn("c", F.col("p") / F.nullif("s", F.lit(0)))
    wide = rows.groupBy().pivot("system", ["lead1", "lead3"]).agg(F.avg("c"))
    return wide.select(F.round("lead1", 6).alias("lead1"), F.round("lead3", 6).alias("lead3"))


@query(f"""with p as ({V.PREDICTIONS}), m as ({V.MANIFEST}), x as (select p.system, p.status = 'ok' and m.id is not null ok, {V.tokens_sql('p.prediction')} p, {V.tokens_sql('m.source')} s from p left join m using (id))
 select system, count(*) n_total, count(*) filter (ok) n_valid, count(*) filter (not ok) n_error, round(coalesce(avg(case when len(s) > 0 then 100.0 * len(p) / len(s) else 0 end) filter (ok), 0), 6) compression from x group by system""")
def eval_join(spark, d):
    m = V.manifest(spark, d).select("id", X.tokens("source").alias("s"), F.lit(True).alias("known"))
    rows = V.predictions(spark, d).select("id", "system", "status", X.tokens("prediction").alias("p")).join(m, "id", "left")
    ok = (F.col("status") == "ok") & F.coalesce("known", F.lit(False))
    return rows.groupBy("system").agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_error"), F.round(F.coalesce(F.avg(F.when(ok, 100 * M.compression("p", "s"))), F.lit(0.0)), 6).alias("compression"))


#: Predictions that are no errors beside what they are scored against.
SCORED = f"""select id, system, doc_id, {V.tokens_sql('prediction')} p, {V.tokens_sql('reference')} r, {V.tokens_sql('source')} s
 from (select id, system, prediction from ({V.PREDICTIONS}) where status = 'ok') join ({V.MANIFEST}) using (id)"""


def scored(spark, d):
    m = V.manifest(spark, d).select("id", "doc_id", X.tokens("reference").alias("r"), F.size(X.tokens("source")).alias("s"))
    return V.predictions(spark, d).where("status = 'ok'").select("id", "system", X.tokens("prediction").alias("p")).join(m, "id")


@query(f"""with t as materialized ({SCORED}), one as ({rouge_sql(1, 't', 'id, system')}), two as ({rouge_sql(2, 't', 'id, system')}), l as ({rouge_l_sql('select id, system, s, p, r from t')})
 select system, count(*) n, round(100 * avg(one.f1), 4) rouge_1, round(100 * avg(two.f1), 4) rouge_2, round(100 * avg(l.f), 4) rouge_l,
 round(100 * avg(case when len(l.s) > 0 then len(l.p)::double / len(l.s) else 0 end), 4) compression
 from l join one using (id, system) join two using (id, system) group by system""")
def eval_summary(spark, d):
    """ROUGE-1, -2 and -L F1 and compression of the leads against first lines, over whole texts."""
    compression = F.when(F.col("s") > 0, F.size("p") / F.nullif("s", F.lit(0))).otherwise(0.0)
    rows = scored(spark, d).select("system", "p", "r", M.rouge_l("p", "r")["f1"].alias("fl"), compression.alias("c"))
    every = M.rouge_ns(rows, ["system", "fl", "c"], "p", "r", [1, 2])
    mean = lambda c, a: F.round(100 * F.avg(c), 4).alias(a)
    return every.groupBy("system").agg(F.count("*").alias("n"), mean(F.round("f1_1", 6), "rouge_1"), mean(F.round("f1_2", 6), "rouge_2"), mean("fl", "rouge_l"), mean("c", "compression"))


LENGTHS = f"select lang, doc_id, {V.words_sql('text')} n from documents"


def lengths(spark, d):
    return table(spark, d, "documents").select("lang", "doc_id", X.word_count("text").alias("n"))


@query(f"""with x as (select lang, n, row_number() over (partition by lang order by n) - 1 i, count(*) over (partition by lang) c from ({LENGTHS}))
 select lang, min(n) lowest, max(n) filter (i = round_even((c - 1) * 0.5, 0)) median, max(n) filter (i = round_even((c - 1) * 0.95, 0)) p95, max(n)
 highest from x group by lang""")
def length_stats_nearest(spark, d):
    return S.nearest_rank(lengths(spark, d), ["lang"], "n", {"lowest": 0.0, "median": 0.5, "p95": 0.95, "highest": 1.0})


@query(f"select least(49, n // 100)::bigint as bin, count(*) n_docs from ({LENGTHS}) group by all")
def length_histogram(spark, d):
    bin_ = F.least(F.lit(50), F.width_bucket("n", F.lit(0), F.lit(5000), F.lit(50))) - 1
    return lengths(spark, d).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n_docs"))


@query(f"""select lang, count(n) as count, round(avg(n), 6) mean, round(stddev_samp(n), 6) std, min(n) as lowest, quantile_cont(n, 0.25)::double q1,
 quantile_cont(n, 0.5)::double q2, quantile_cont(n, 0.75)::double q3, max(n) highest from ({LENGTHS}) group by lang""")
def describe_lengths(spark, d):
    rows = lengths(spark, d).groupBy("lang").agg(F.count("n").alias("count"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("lowest"), F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("n").alias("highest"))
    return rows.select("lang", "count", "mean", "std", "lowest", *[F.get("q", F.lit(k)).alias(f"q{k + 1}") for k in range(3)], "highest")


LABEL_COUNTS = """select l.label, count(x.quality) n, round(count(x.quality) / (select count(*) from labels)::double, 6) share
 from (select unnest(['good', 'bad', 'toxic good', 'toxic bad']) as label) l left
 join (select *, case when toxic = 1 then 'toxic ' else '' end || case when quality = 1 then 'good' else 'bad' end as label
 from labels) x using (label) group by l.label"""


@query(LABEL_COUNTS)
def label_distribution(spark, d):
    labels = ["good", "bad", "toxic good", "toxic bad"]
    named = F.concat(F.when(F.col("toxic") == 1, "toxic ").otherwise(""), F.when(F.col("quality") == 1, "good").otherwise("bad"))
    counts = table(spark, d, "labels").groupBy(named.alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    domain = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return domain.join(counts, "label", "left").crossJoin(total).select("label", n.alias("n"), F.round(n / F.col("all"), 6).alias("share"))


ERRORS = f"""select sample_id, system, list_filter([case when major_error then 'hallucination' end, case when faithfulness < 3 then 'wrong_entity' end, case when
 informativeness < 2 then 'omission' end, case when fluency < 2 then 'incoherence' end], lambda x: x is not null) e from ({V.SCORES})"""


def error_types():
    return F.array_compact(F.array(F.when(F.col("major_error"), "hallucination"), F.when(F.col("faithfulness") < 3, "wrong_entity"), F.when(F.col("informativeness") < 2, "omission"), F.when(F.col("fluency") < 2, "incoherence")))


@query(f"select system, error_type, count(*) n from (select system, unnest(case when len(e) = 0 then ['none'] else e end) error_type from ({ERRORS})) group by all")
def error_type_counts(spark, d):
    kinds = F.when(F.size(error_types()) == 0, F.array(F.lit("none"))).otherwise(error_types())
    return V.scores(spark, d).select("system", F.explode(kinds).alias("error_type")).groupBy("system", "error_type").agg(F.count("*").alias("n"))


@query(f"""select system, field, round(avg(score), 6) mean, median(score)::double median, round(avg(major_error::int), 6) error_rate
 from (unpivot (select sample_id, system, major_error, faithfulness, informativeness, fluency, conciseness
 from ({V.SCORES})) on faithfulness, informativeness, fluency, conciseness into name field value score) group by system, field""")
def score_summary(spark, d):
    long = V.scores(spark, d).unpivot(["sample_id", "system", "major_error"], list(V.FIELDS), "field", "score")
    return long.groupBy("system", "field").agg(F.round(F.avg("score"), 6).alias("mean"), F.median("score").alias("median"), F.round(F.avg(F.col("major_error").cast("int")), 6).alias("error_rate"))


@query("""select event_type, k as key, sum(v) total from (select event_type, unnest(json_keys(props)) k, try_cast(json_extract_string(props, '$.k') as double) v
 from events) group by all""")
def usage_totals(spark, d):
    usage = F.from_json("props", "map<string,double>")
    return table(spark, d, "events").select("event_type", F.explode(usage)).groupBy("event_type", "key").agg(F.sum("value").alias("total"))


@query("select event_type, round(sum(value * event_id) / sum(event_id), 6) weighted from events group by event_type")
def weighted_mean(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("event_id")) / F.sum("event_id"), 6).alias("weighted"))


#: Resamples of the studies.
RESAMPLES = 2000


def log_factorial_sql(n: str) -> str:
    x, between = f"({n} + 8.0)", " * ".join(f"({n} + {k})" for k in range(1, 9))
    return f"(({x} + 0.5) * ln({x}) - {x} + {0.5 * log(2 * pi)!r} + (1 - (1 - {2 / 7!r} / ({x} * {x})) / (30 * {x} * {x})) / (12 * {x}) - ln(1.0::double * {between}))"


def bootstrap_sql(rows: str, by: str, seed: str) -> str:
    """(by, b, mean) of RESAMPLES resamples of rows (by, x): a walk over each resample's distinct values in order.

    A step draws how often the value is taken, from what is left of the resample; one by one up to ten, else a try of the
    ratio of uniforms, and a step that is rejected tries again. Groups of up to 256 distinct values.
    """
    chance = lambda t, salt: f"((('0x' || substr(md5('{seed}|' || b || '|0|' || (i - 1) || '|' || {t} || '|{salt}'), 1, 12))::bigint + 0.5) / {float(1 << 48)!r}::double)"
    cost = lambda k: f"({log_factorial_sql(k)} + {log_factorial_sql(f'(n - {k})')} - {k} * ln(q / (1 - q)))"
    whole = lambda x: f"floor({x})::bigint"
    return f"""with recursive given as materialized ({rows}), counted as (select {by}, x::double v, count(*) c from given where x is not null group by {by}, x),
 vals as materialized (select {by}, v, c, row_number() over (partition by {by} order by v) i from counted),
 walk as (
  select {by}, b, 1::bigint i, 1::bigint t, n, n mass, n size, 0.0::double total from (select {by}, sum(c)::bigint n from counted group by {by}), (select unnest(range(1, {RESAMPLES + 1})) b)
  union all
  select {by}, b, if(k is null, i, i + 1), if(k is null, t + 1, 1), if(k is null, n, n - k), if(k is null, mass, mass - c), size, if(k is null, total, total + v * k)
  from (
   select * replace (if(p > 0.5, n - k, k) as k) from (
    select *, case when q <= 0 then 0
      when n <= 10 then len(list_filter(range(1, n + 1), lambda j: {chance('j', 0)} < q))
      when hit >= 0 and hit < least(n + 1, {whole('mean + 0.5 + 16 * sqrt(variance + 0.5)')}) and (u * (4 - u) - 3 <= d or (u * (u - d) < 1 and 2 * ln(u) <= d)) then {whole('hit')} end k
    from (
     select *, case when n > 10 and q > 0 and hit >= 0 and hit < n + 1 then {cost(whole('(n + 1) * q'))} - {cost(whole('hit'))} end d from (
      select *, mean + 0.5 + (sqrt(variance + 0.5) * 1.7155277699214135 + 0.8989161620588988) * (w - 0.5) / u hit from (
       select *, n * q mean, n * q * (1 - q) variance, {chance('t', 1)} u, {chance('t', 2)} w from (
        select *, least(p, 1 - p) q from (select walk.*, v, c, case when mass <= c then 1.0 else c::double / mass end p from walk join vals using ({by}, i)))))))))
 select {by}, b, total / size mean from walk where (({by}), i) in (select (({by}), max(i) + 1) from vals group by {by})"""


def interval_sql(rows: str, by: str, seed: str) -> str:
    """(by, low, high, p_greater) of the resamples' means."""
    means = bootstrap_sql(rows, by, seed)
    return f"select {by}, quantile_cont(mean, 0.025) low, quantile_cont(mean, 0.975) high, avg(case when mean > 0 then 1.0 when mean = 0 then 0.5 else 0.0 end) p_greater from ({means}) group by {by}"


@query(f"select system, round(low, 6) low, round(high, 6) high from ({interval_sql(f'select system, faithfulness x from ({V.SCORES})', 'system', 'boot')})")
def bootstrap_ci(spark, d):
    """95 % interval of each system's mean faithfulness."""
    means = S.bootstrap_means(V.scores(spark, d), "faithfulness", ["system"], RESAMPLES, "boot")
    return rounded(S.interval(means, ["system"]), "low", "high")


GAPS = f"""select 1 g, a.faithfulness::double - b.faithfulness x from ({V.SCORES}) a join ({V.SCORES}) b using (sample_id) where a.system = 'lead1' and b.system = 'neural'"""


@query(f"""select w.n, round(w.difference, 6) difference, round(low, 6) low, round(high, 6) high, round(p_greater, 6) p_greater
 from (select 1 g, count(*) n, avg(x) difference from ({GAPS})) w join ({interval_sql(GAPS, 'g', 'pair')}) using (g)""")
def paired_bootstrap(spark, d):
    """Mean faithfulness of lead1 less neural on the samples of both, its interval, and how often it is above 0."""
    wide = V.scores(spark, d).where(F.col("system").isin("lead1", "neural")).groupBy("sample_id").pivot("system", ["lead1", "neural"]).agg(F.max("faithfulness"))
    out = S.paired_bootstrap(wide.select((F.col("lead1") - F.col("neural")).alias("x")), "x", [], RESAMPLES, "pair")
    return rounded(out, "difference", "low", "high", "p_greater")


PAIRS_OF = f"""select a.system || '>' || b.system pair, field, a.score::double - b.score x, a.system first, b.system as second
 from (unpivot (select sample_id, system, faithfulness, informativeness, fluency, conciseness, major_error::int major_error from ({V.SCORES})) on {', '.join(V.FIELDS)}, major_error into name field value score) a
 join (unpivot (select sample_id, system, faithfulness, informativeness, fluency, conciseness, major_error::int major_error from ({V.SCORES})) on {', '.join(V.FIELDS)}, major_error into name field value score) b
 using (sample_id, field) where list_position({list(V.SYSTEMS)}, a.system) < list_position({list(V.SYSTEMS)}, b.system)"""


@query(f"""select pair, field, n, round(difference, 6) difference, round(low, 6) low, round(high, 6) high, round(p_greater, 6) p_greater,
 case when difference = 0 then 'equal' when (difference > 0) = (field <> 'major_error') then first else second end better
 from (select pair, field, first, second, count(*) n, avg(x) difference from ({PAIRS_OF}) group by all) join ({interval_sql(PAIRS_OF, 'pair, field', 'systems')}) using (pair, field)""")
def paired_systems(spark, d):
    """All pairs of systems by score and error rate, with intervals of the mean difference."""
    from corpusloom.operators.study import compare_systems

    return rounded(compare_systems(V.scores(spark, d), V.SYSTEMS, V.FIELDS, RESAMPLES, "systems"), "difference", "low", "high", "p_greater")


@query(f"""select g.system, coalesce(avg(s.faithfulness) filter (quality = 1 and toxic = 1), 'nan'::double) mean
 from (select unnest(['lead1', 'lead3', 'neural', 'pretrained', 'absent']) as system) g left join ({V.SCORES}) s using (system) group by g.system""")
def mean_or_nan(spark, d):
    """Mean of a group's values, NaN where it has none."""
    groups = spark.range(1).select(F.explode(F.array(*map(F.lit, (*V.SYSTEMS, "absent")))).alias("system"))
    rows = groups.join(V.scores(spark, d), "system", "left")
    return rows.groupBy("system").agg(S.mean_or_nan(F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.col("faithfulness"))).alias("mean"))


@query(f"""select system, n, hits, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) low, round((p + z * z / (2
 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) high
 from (select system, count(*)::double n, count(*) filter (major_error) hits, count(*) filter (major_error)::double / count(*) p, {S.Z95} z
 from ({V.SCORES}) group by system)""")
def wilson_ci(spark, d):
    counts = V.scores(spark, d).groupBy("system").agg(F.count("*").cast("double").alias("n"), F.count_if("major_error").alias("hits"))
    low, high = S.wilson(F.col("hits"), F.col("n"))
    return counts.select("system", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


MEASURES = f"select lang, length(text)::double x, {V.words_sql('text')}::double y from documents"


def measures(spark, d):
    return table(spark, d, "documents").select("lang", F.length("text").cast("double").alias("x"), X.word_count("text").cast("double").alias("y"))


@query(f"select lang, count(*) n, round(corr(x, y), 6) r from ({MEASURES}) group by lang")
def pearson(spark, d):
    return measures(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(S.pearson("x", "y"), 6).alias("r"))


def ranks_sql(rows: str, by: str) -> str:
    r = lambda c: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0"
    return f"select *, {r('x')} rx, {r('y')} ry from ({rows})"


@query(f"select lang, count(*) n, round(corr(rx, ry), 6) rho from ({ranks_sql(MEASURES, 'lang')}) group by lang")
def spearman(spark, d):
    return rounded(S.spearman(measures(spark, d), "x", "y", ["lang"]), "rho")


@query(f"select lang, x, rx as rank, count(*) n from ({ranks_sql(MEASURES, 'lang')}) group by all")
def average_ranks(spark, d):
    from corpusloom.operators.sampling import average_ranks as ranks

    return ranks(measures(spark, d), "x", ["lang"]).groupBy("lang", "x", "rank").agg(F.count("*").alias("n"))


RATED = f"select sample_id, system, faithfulness a, 1 + ('0x' || substr(md5(sample_id || '|' || system || '|rater'), 1, 12))::bigint % 5 b from ({V.SCORES})"


def rated(spark, d):
    """Judge (a) and a second rater (b) of each sample and system."""
    return V.scores(spark, d).select("sample_id", "system", F.col("faithfulness").alias("a"), (V.draw("sample_id", "system", F.lit("rater"), out_of=5) + 1).alias("b"))


def kappa_sql(rows: str, by: str) -> str:
    return f"select {by}, n, round(case when e = 0 then case when dd = 0 then 1.0 end else 1 - dd / e end, 6) kappa from (select {by}, count(*) n, sum((a - b) * (a - b))::double dd, (count(*) * sum(a * a) + count(*) * sum(b * b) - 2 * sum(a) * sum(b)) / count(*)::double e from ({rows}) group by {by})"


@query(kappa_sql(RATED, "system"))
def weighted_kappa(spark, d):
    return rounded(S.weighted_kappa(rated(spark, d), "a", "b", ["system"]), "kappa")


@query("""select n, round(case when e = 1 then 1.0 else (o - e) / (1 - e) end, 6) kappa
 from (select count(*) n, avg((quality = toxic)::int) o, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) e from labels)""")
def binary_kappa(spark, d):
    x, y = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, d, "labels").agg(F.count("*").alias("n"), F.round(S.binary_kappa(x, y), 6).alias("kappa"))


@query(f"""select system, count(*) n, round(avg(abs(a - b)), 6) mae, round(avg((abs(a - b) <= 1)::int), 6) within_one, round(avg((a = b)::int), 6) agreement
 from ({RATED}) group by system""")
def rater_agreement(spark, d):
    gap = F.abs(F.col("a") - F.col("b"))
    return rated(spark, d).groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("mae"), F.round(F.avg((gap <= 1).cast("int")), 6).alias("within_one"), F.round(F.avg((gap == 0).cast("int")), 6).alias("agreement"))


@query(f"select s.sample_id, s.system, s.faithfulness judge, r.b human from ({V.SCORES}) s join ({RATED}) r using (sample_id, system)")
def rater_join(spark, d):
    human = rated(spark, d).select("sample_id", "system", F.col("b").alias("human"))
    return V.scores(spark, d).select("sample_id", "system", F.col("faithfulness").alias("judge")).join(human, ["sample_id", "system"])


REPEATS = f"""select system, sample_id, max(a) filter (not is_repeat) a, max(a) filter (is_repeat) b from (select system, sample_id, faithfulness a, false is_repeat
 from ({V.SCORES}) union all select system, sample_id, least(5, faithfulness + (toxic = 1)::int), true from ({V.SCORES}) where quality = 0)
 group by all having count(*) = 2"""


def repeats(spark, d):
    from corpusloom.operators.study import complete_pairs

    s = V.scores(spark, d)
    again = s.where("quality = 0").select("system", "sample_id", F.least(F.lit(5), F.col("faithfulness") + F.col("toxic")).alias("a"), F.lit(True).alias("is_repeat"))
    return complete_pairs(s.select("system", "sample_id", F.col("faithfulness").alias("a"), F.lit(False).alias("is_repeat")).union(again), ["system", "sample_id"], "a")


@query(REPEATS)
def repeat_pairs(spark, d):
    return repeats(spark, d)


@query(kappa_sql(REPEATS, "system"))
def intra_rater(spark, d):
    return rounded(S.weighted_kappa(repeats(spark, d), "a", "b", ["system"]), "kappa")


JUDGED = f"select x.system, f x, faithfulness::double y from ({rouge_l_sql(SCORED)}) x join ({V.SCORES}) j on j.sample_id = x.doc_id and j.system = x.system"


@query(f"""with j as materialized ({JUDGED}), scoped as (select system scope, x, y from j union all select 'all', x, y from j)
 select scope, count(*) n, round(corr(rx, ry), 6) rho from ({ranks_sql('select * from scoped', 'scope')}) group by scope""")
def rouge_score_corr(spark, d):
    """Spearman of lead ROUGE-L and the judge's faithfulness, by system and over all systems."""
    rows = scored(spark, d).select("doc_id", "system", M.rouge_l("p", "r")["f1"].alias("x"))
    judged = V.scores(spark, d).select(F.col("sample_id").alias("doc_id"), "system", F.col("faithfulness").alias("y"))
    return rounded(S.spearman_sets(rows.join(judged, ["doc_id", "system"]), "x", "y", "system"), "rho")


@query(f"""select round(abs(f - b / 5.0), 6) gap, sample_id, system from (select doc_id sample_id, system, f from ({rouge_l_sql(SCORED)})) join (select sample_id, system, b from ({RATED}))
 using (sample_id, system) order by gap desc, sample_id desc, system desc limit 1""")
def disagreement_case(spark, d):
    """The sample and system whose ROUGE-L and human score lie farthest apart; ties to the larger id, then system."""
    rows = scored(spark, d).select(F.col("doc_id").alias("sample_id"), "system", M.rouge_l("p", "r")["f1"].alias("x")).join(rated(spark, d), ["sample_id", "system"])
    gap = F.round(F.abs(F.col("x") - F.col("b") / 5), 6)
    return rows.agg(F.max(F.struct(gap.alias("gap"), "sample_id", "system")).alias("m")).select("m.*")


@query(f"""select b as batch, x, round(avg(x) over (partition by b), 6) mean_of_batch
 from (select (row_number() over (order by doc_id) - 1) // 64 as b, doc_id, n as x from ({LENGTHS}))""")
def batch_ids(spark, d):
    from corpusloom.operators.sampling import place

    placed = place(lengths(spark, d), [F.col("doc_id")])
    rows = placed.select(F.floor(F.col("place") / 64).alias("batch"), F.col("n").alias("x"))
    return rows.withColumn("mean_of_batch", F.round(F.avg("x").over(Window.partitionBy("batch")), 6))
