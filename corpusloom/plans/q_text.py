"""Queries over texts: normalisation, tokens, sentences, leads, validation of rows and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.sentences import lead, split_sentences
from corpusloom.plans import views as V
from corpusloom.plans.registry import query
from corpusloom.runtime import dealt_table as table
from corpusloom.runtime import stored


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"""select lang, count(*) n_docs, round(avg(case when s > 0 then p::double / s else 0 end), 6) mean_ratio
from (select lang, {V.words_sql('text')} s, {V.words_sql(V.lead_sql('text', 3))} p from documents) group by lang""")
def lead_compression(spark, d):
    rows = docs(spark, d).select("lang", X.word_count("text").alias("s"), X.word_count(lead("text", 3)).alias("p"))
    ratio = F.when(F.col("s") > 0, F.col("p") / F.col("s")).otherwise(0.0)
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg(ratio), 6).alias("mean_ratio"))


@query("select doc_id, nfc_normalize(replace(text, chr(8), '')) as cleaned from documents")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", X.clean_text("text").alias("cleaned"))


@query("select lang, count(*) n_docs, count(*) filter (nfc_normalize(text) <> text) n_non_nfc from documents group by lang")
def non_nfc_count(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(~X.is_nfc("text")).alias("n_non_nfc"))


@query(f"select doc_id, coalesce(trim(regexp_replace(lower(nfc_normalize(text)), '{V.UWS}+', ' ', 'g')), '') as normalized from documents")
def normalize_metric_text(spark, d):
    return docs(spark, d).select("doc_id", X.normalize_metric("text").alias("normalized"))


@query(rf"select page_id, coalesce(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(html), '[\r\n\t]+', ' ', 'g'), '(?:https?://|www\.)[^\s\x0b]+', ' ', 'g'), '{V.UWS}+', ' ', 'g')), '') as normalized from (select page_id, url || chr(10) || html as html from pages)")
def normalize_corpus_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalize_corpus(F.concat("url", F.lit("\n"), "html")).alias("normalized"))


@query(f"select doc_id, {V.words_sql('text')} n_words, length(text)::bigint as n_code_points from documents")
def word_counts(spark, d):
    return docs(spark, d).select("doc_id", X.word_count("text").alias("n_words"), F.length("text").cast("long").alias("n_code_points"))


@query(f"""select doc_id, len(t)::bigint n_tokens, len(list_distinct(t))::bigint n_distinct, md5(array_to_string(t, ' ')) as digest
 from (select doc_id, {V.tokens_sql('text')} t from documents)""")
def regex_tokens(spark, d):
    rows = docs(spark, d).select("doc_id", X.tokens("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(r"select doc_id, regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') has_control, contains(text, chr(65533)) has_replacement from documents")
def control_char_rows(spark, d):
    return docs(spark, d).select("doc_id", X.has_control("text").alias("has_control"), X.has_replacement("text").alias("has_replacement"))


@query(rf"select id, regexp_full_match(id, 'test_\d{{6}}') valid, regexp_full_match(id, 'validation_\d{{6}}') other_split from ({V.MANIFEST})")
def id_format(spark, d):
    return V.manifest(spark, d).select("id", X.full_match("id", r"test_\d{6}").alias("valid"), X.full_match("id", r"validation_\d{6}").alias("other_split"))


@query("select doc_id, ('0x' || substr(sha256('7|' || doc_id || '|' || source), 1, 16))::ubigint::decimal(20,0) seed from documents")
def stable_seed(spark, d):
    return docs(spark, d).select("doc_id", X.stable_seed(F.lit(7), "doc_id", "source").alias("seed"))


@query("select conv_id, turn, concat('candidate|', conv_id, '|', role, '|v1|', coalesce(md5(text), ''), '|main') as key from conversations")
def record_key(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", X.record_key(F.lit("candidate"), "conv_id", "role", F.lit("v1"), F.md5("text"), F.lit(None).cast("string")).alias("key"))


@query(r"""select page_id, case when h <> '' then 'host-' || substr(sha256(lower(h)), 1, 12) else 'host-unknown' end redacted
from (select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) h from pages)""")
def redact_url(spark, d):
    return table(spark, d, "pages").select("page_id", X.redact_url("url").alias("redacted"))


@query(f"select conv_id, turn, {V.pstrip_sql('text')} as stripped, {V.words_sql('text')} <= 60 within_limit from conversations")
def word_limit(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", X.pstrip("text").alias("stripped"), X.within_words("text").alias("within_limit"))


@query(f"""select event_id, translate(lower({V.pstrip_sql('v')}), '- ', '__') canonical
 from (select event_id, ' ' || upper(event_type) || '-Type Of ' || chr(160) as v from events)""")
def enum_canonical(spark, d):
    raw = F.concat(F.lit(" "), F.upper("event_type"), F.lit("-Type Of  "))
    return table(spark, d, "events").select("event_id", X.enum_canonical(raw).alias("canonical"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k, props as body from events")
def fenced_json(spark, d):
    body = X.without_fence(F.concat(F.lit("```json\n"), "props", F.lit("\n```\n")))
    return table(spark, d, "events").select("event_id", F.get_json_object(body, "$.k").try_cast("long").alias("k"), body.alias("body"))


@query("""select conv_id, turn, 'Judge the answer.' || chr(10) || '---' || chr(10) || to_json({'sample_id': conv_id, 'turn': turn, 'role': role}) as prompt from conversations""")
def task_payload(spark, d):
    payload = F.to_json(F.struct(F.col("conv_id").alias("sample_id"), "turn", "role"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Judge the answer.\n---\n"), payload).alias("prompt"))


@query("""select role task, count(*) n_tasks, sum(length(text) + 20)::bigint sum_chars, max(length(text) + 20)::bigint max_chars, ceil(sum(length(text) + 20) /
 3.0)::bigint est_tokens from conversations group by role""")
def prompt_estimate(spark, d):
    n = (F.length("text") + 20).cast("long")
    return table(spark, d, "conversations").groupBy(F.col("role").alias("task")).agg(F.count("*").alias("n_tasks"), F.sum(n).alias("sum_chars"), F.max(n).alias("max_chars"), F.ceil(F.sum(n) / 3.0).cast("long").alias("est_tokens"))


@query(f"""select doc_id, coalesce(nullif({V.pstrip_sql('a')}, ''), nullif({V.pstrip_sql('lang')}, ''), nullif({V.pstrip_sql('text')}, '')) as filled
 from (select doc_id, case when doc_id % 3 = 0 then '  ' when doc_id % 3 = 1 then source end a, case when doc_id % 2 = 0 then '' else lang end lang,
 text from documents)""")
def coalesce_source(spark, d):
    a = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("  ")).when(F.pmod("doc_id", F.lit(3)) == 1, F.col("source"))
    b = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("")).otherwise(F.col("lang"))
    return docs(spark, d).select("doc_id", X.first_filled(a, b, "text").alias("filled"))


@query(f"select doc_id, len(s)::bigint n_sentences, md5(array_to_string(s, chr(10))) digest from (select doc_id, {V.sentences_sql('text')} s from documents)")
def sentence_split(spark, d):
    rows = docs(spark, d).select("doc_id", split_sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query(f"select doc_id, {V.lead_sql('text', 1)} prediction from documents")
def lead1(spark, d):
    return docs(spark, d).select("doc_id", lead("text", 1).alias("prediction"))


@query(f"select doc_id, {V.lead_sql('text', 3)} prediction from documents")
def lead3(spark, d):
    return docs(spark, d).select("doc_id", lead("text", 3).alias("prediction"))


@query(f"select id, system, config_id, prediction, status, error from ({V.PREDICTIONS})")
def lead_predictions(spark, d):
    return V.predictions(spark, d).drop("doc_id")


@query(f"select doc_id, coalesce({V.pstrip_sql(V.nfc_sql('text'))}, '') text from documents")
def nfc_stripped(spark, d):
    return table(spark, d, "documents").select("doc_id", X.nfc_stripped("text").alias("text"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') stamp from events")
def utc_stamp(spark, d):
    return table(spark, d, "events").select("event_id", X.utc_stamp(F.col("ts")).alias("stamp"))


@query()
def word_segments(spark, d):
    """Documents cut into words of a dictionary of compounds that is counted from all of them, and the share of compounds."""
    from corpusloom.operators import segmentation as G

    rows = stored(table(spark, d, "documents").select("doc_id", X.token_text("text").alias("segmented")), "tokens")
    lexicon = stored(G.compounds(rows.where("segmented is not null"), "segmented", 20_000), "lexicon")
    cut = G.segment_text(rows, "segmented", lexicon)
    size = lambda n: F.coalesce(n, F.size(F.lit(None).cast("array<string>")))
    share = F.round(F.col("n_compounds") / F.nullif(F.col("n_segments"), F.lit(0)), 6)
    return cut.select("doc_id", size("n_tokens").alias("n_tokens"), size("n_segments").alias("n_segments"), share.alias("compound_share"), "segmented")
