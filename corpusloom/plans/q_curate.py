"""Queries of curation, validation, duplicates and set comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import curate as C
from corpusloom.operators import dedup as D
from corpusloom.operators import validate as V2
from corpusloom.plans import views as V
from corpusloom.plans.registry import query
from corpusloom.runtime import dealt_table as table

STRIPPED = f"""select conv_id, turn, conv_id * 1000 + turn as ordinal, {V.pstrip_sql('source')} source, {V.pstrip_sql('target')} target from ({V.TURNS})
 where source is not null and target is not null"""
CLEANED = f"select *, {V.words_sql('source')} n_source, {V.words_sql('target')} n_target from ({STRIPPED}) where source <> '' and target <> ''"
UNIQUE = f"select * from ({CLEANED}) qualify row_number() over (partition by source, target order by ordinal) = 1"
BAND = "n_source between 5 and 1200 and n_target between 5 and 400"
RATIO = "n_target::double / n_source between 0.05 and 20"
BANDS = {"source": (5, 1200), "target": (5, 400)}
RATIOS = (0.05, 20.0)


def normal_sql(e: str) -> str:
    return rf"coalesce(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({e}), '[\r\n\t]+', ' ', 'g'), '(?:https?://|www\.)[^\s\x0b]+', ' ', 'g'), '{V.UWS}+', ' ', 'g')), '')"


def pairs(spark, d):
    return V.turns(spark, d).withColumn("ordinal", F.col("conv_id") * 1000 + F.col("turn"))


@query(f"""select conv_id, turn, {normal_sql('source')} source, {normal_sql('target')} target from (select * from ({UNIQUE}) where {BAND} and {RATIO}
 qualify row_number() over (partition by source order by ordinal) = 1)""")
def curate(spark, d):
    return C.curate(pairs(spark, d), "ordinal", bands=BANDS, ratios=RATIOS).select("conv_id", "turn", "source", "target")


@query(f"select conv_id, turn, n_source, n_target from ({CLEANED}) where n_source between 100 and 1200 and n_target between 10 and 150")
def length_band_filter(spark, d):
    rows = C.cleaned(pairs(spark, d))
    return rows.where(C.in_length_band(F.col("n_source"), F.col("n_target"))).select("conv_id", "turn", "n_source", "n_target")


@query(f"select conv_id, turn, round(n_target::double / n_source, 6) ratio from ({CLEANED}) where n_target::double / n_source between 0.02 and 0.5")
def ratio_filter(spark, d):
    rows = C.cleaned(pairs(spark, d)).where(C.in_ratio_band(F.col("n_source"), F.col("n_target")))
    return rows.select("conv_id", "turn", F.round(F.col("n_target") / F.col("n_source"), 6).alias("ratio"))


EMBED_PAIRS = "select a.vec_id, a.embedding a, b.embedding b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"
DUCK_COSINE = """list_sum(list_transform(list_zip(a, b), lambda x: x[1]::double * x[2]::double)) / ((sqrt(list_sum(list_transform(a, lambda x: x::double * x::double)))
 + 1e-9) * (sqrt(list_sum(list_transform(b, lambda x: x::double * x::double))) + 1e-9))"""


def vector_pairs(spark, d):
    t = table(spark, d, "embeddings")
    return t.select("vec_id", F.col("embedding").alias("a")).join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query(f"select vec_id, round(c, 6) cosine from (select vec_id, {DUCK_COSINE} c from ({EMBED_PAIRS})) where c >= 0.05")
def cosine_filter(spark, d):
    return vector_pairs(spark, d).withColumn("c", C.cosine("a", "b")).where("c >= 0.05").select("vec_id", F.round("c", 6).alias("cosine"))


@query(f"select vec_id, round({DUCK_COSINE}, 6) cosine from ({EMBED_PAIRS})")
def row_cosine(spark, d):
    return vector_pairs(spark, d).select("vec_id", F.round(C.cosine("a", "b"), 6).alias("cosine"))


FUNNEL = f"""select count(*) n_raw, count(*) filter (filled) n_filled, count(*) filter (filled and {BAND}) n_band, count(*) filter (filled and {BAND} and {RATIO}) n_ratio,
 round(100.0 * count(*) filter (filled and {BAND} and {RATIO}) / count(*), 6) kept_percent
 from (select *, coalesce(source <> '' and target <> '', false) filled, {V.words_sql('source')} n_source, nullif({V.words_sql('target')}, 0) n_target from ({STRIPPED}))"""


@query(FUNNEL.replace("n_target::double / n_source", "n_target::double / nullif(n_source, 0)"))
def curation_funnel(spark, d):
    rows = pairs(spark, d).select(X.pstrip("source").alias("source"), X.pstrip("target").alias("target"))
    rows = rows.withColumn("filled", F.coalesce((F.col("source") != "") & (F.col("target") != ""), F.lit(False))).withColumn("s", X.word_count("source")).withColumn("t", X.word_count("target"))
    band = F.col("filled") & C.in_length_band(F.col("s"), F.col("t"), **BANDS)
    ratio = band & C.in_ratio_band(F.col("s"), F.col("t"), *RATIOS)
    n = F.count("*")
    return rows.agg(n.alias("n_raw"), F.count_if("filled").alias("n_filled"), F.count_if(band).alias("n_band"), F.count_if(ratio).alias("n_ratio"), F.round(100.0 * F.count_if(ratio) / n, 6).alias("kept_percent"))


@query("""select event_id, list_filter(['k', 'v'], lambda x: not list_contains(json_keys(props), x)) missing, list_filter(json_keys(props), lambda x: not list_contains(['k', 'v'], x)) extra,
 json_type(props, '$.k') in ('UBIGINT', 'BIGINT') k_is_number from events""")
def schema_issues(spark, d):
    missing, extra = V2.json_keys("props", ["k", "v"])
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant"))
    return table(spark, d, "events").select("event_id", missing.alias("missing"), extra.alias("extra"), (kind == "BIGINT").alias("k_is_number"))


@query("""select user_id, event_id as line, first_line from (select user_id, event_id, min(event_id) over (partition by user_id) first_line from events)
 where event_id > first_line""")
def duplicate_ids(spark, d):
    return V2.repeated_ids(table(spark, d, "events").select("user_id", F.col("event_id").alias("line")), "user_id", "line")


def flags_sql(f: str) -> list[str]:
    t = [f"{V.pstrip_sql(f)} = ''", f"regexp_matches({f}, '\\A{V.UWS}|{V.UWS}\\z')", f"nfc_normalize({f}) <> {f}", f"contains({f}, chr(65533))", rf"regexp_matches({f}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')"]
    return [f"case when {c} then '{code}' end" for c, code in zip(t, V2.TEXT_CODES, strict=True)]


PAIR_SQL = [f"case when {c} then '{code}' end" for c, code in zip(["s between 1 and 19", "r between 1 and 2", "r > s", "source = reference and s > 0"], V2.PAIR_CODES, strict=True)]
COUNTED = f"select *, {V.words_sql('source')} s, {V.words_sql('reference')} r from ({V.MANIFEST})"
FLAG_SQL = f"select doc_id, unnest(list_filter([{', '.join(flags_sql('source') + flags_sql('reference') + PAIR_SQL)}], lambda x: x is not null)) code from ({COUNTED})"


def counted(spark, d):
    return V.manifest(spark, d).withColumn("s", X.word_count("source")).withColumn("r", X.word_count("reference"))


def flags():
    return [*V2.text_flags("source"), *V2.text_flags("reference"), *V2.pair_flags("source", "reference", "s", "r")]


@query(FLAG_SQL)
def quality_flags(spark, d):
    return counted(spark, d).select("doc_id", F.explode(V2.codes(flags())).alias("code"))


@query(f"""select doc_id, list_distinct(list_filter([{', '.join(flags_sql('source') + flags_sql('reference') + PAIR_SQL)}], lambda x: x is not null)).list_sort()
 warnings from ({COUNTED})""")
def row_warnings(spark, d):
    return counted(spark, d).select("doc_id", F.sort_array(F.array_distinct(V2.codes(flags()))).alias("warnings"))


@query("select lang, count(*) n_rows, count(*) = 2000 as as_expected from documents group by lang")
def row_count_check(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_rows"), (F.count("*") == 2000).alias("as_expected"))


@query(f"select code, count(*) n, list_sort(list(doc_id))[1:5] examples from ({FLAG_SQL}) group by code")
def issue_report(spark, d):
    return V2.issue_report(quality_flags(spark, d).withColumnRenamed("doc_id", "line"))


@query(f"""with p as ({V.PREDICTIONS}), e as (select id, system from ({V.MANIFEST}), (select distinct system from p)), c as (select id, system, count(*) n, count(*) filter ({V.pstrip_sql('prediction')} = '') n_empty,
 count(*) filter (status <> 'ok') n_failed from p group by all)
 select system, sum(coalesce(n, 0))::bigint n_rows, count(*) filter (n is null) n_missing, sum(coalesce(n_empty, 0))::bigint n_empty, sum(coalesce(n_failed, 0))::bigint n_failed from e left join c using (id, system) group by system""")
def prediction_audit(spark, d):
    return V2.audit_predictions(V.manifest(spark, d), V.predictions(spark, d)).select("system", "n_rows", "n_missing", "n_empty", "n_failed")


@query(f"""with p as ({V.PREDICTIONS}), m as ({V.MANIFEST}) select p.system, count(*) n_rows, (count(*) - count(distinct p.id)) n_repeated, count(*) filter (m.id is null) n_unknown,
 count(*) filter (status = 'ok' and error is not null) n_ok_with_error, count(*) filter (status <> 'ok' and error is null) n_silent, count(distinct config_id) n_configs from p left join m using (id) group by p.system""")
def handoff_report(spark, d):
    return V2.audit_predictions(V.manifest(spark, d), V.predictions(spark, d)).select("system", "n_rows", "n_repeated", "n_unknown", "n_ok_with_error", "n_silent", "n_configs")


@query("select conv_id, turn, regexp_matches(lower(to_json({'conv_id': conv_id, 'turn': turn, 'role': role})), 'assistant|system') leaks from conversations")
def identity_leak(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", V2.identity_leak(t, ["conv_id", "turn", "role"], ["assistant", "system"]).alias("leaks"))


@query(f"""with p as ({V.PREDICTIONS}) select id, system, 'missing' problem from (select id, unnest(['lead1', 'lead3']) as system from ({V.MANIFEST})) e anti
 join p using (id, system)""")
def completeness(spark, d):
    expected = V.manifest(spark, d).select("id", F.explode(F.array(F.lit("lead1"), F.lit("lead3"))).alias("system"))
    return V2.incomplete(expected, V.predictions(spark, d), ["id", "system"])


@query(f"select conv_id, turn, source, target from ({UNIQUE})")
def exact_dedup(spark, d):
    return D.keep_first(C.cleaned(pairs(spark, d)), ["source", "target"], "ordinal").select("conv_id", "turn", "source", "target")


@query("select source, count(text) - count(distinct text) n_text, count(lang) - count(distinct lang) n_lang from documents group by source")
def duplicate_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(D.surplus("text").alias("n_text"), D.surplus("lang").alias("n_lang"))


@query("select doc_id, lang, source from documents qualify row_number() over (partition by text order by doc_id) = 1")
def source_dedup(spark, d):
    return D.keep_first(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "lang", "source")


@query("select sha256(text) digest, count(*) n, list_sort(list(doc_id))[1:10] ids from documents where text is not null group by text having count(*) > 1")
def duplicate_sources(spark, d):
    return D.shared_texts(table(spark, d, "documents").where("text is not null"), "text", "doc_id")


@query("select doc_id from documents intersect select doc_id from labels")
def id_overlap(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("""select 'unlabelled' problem, count(*) n from documents anti join labels using (doc_id) union all select 'unknown label', count(*) from labels anti
 join documents using (doc_id)""")
def subset_check(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    gone = lambda x, y, name: x.join(y, "doc_id", "left_anti").agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    return gone(a, b, "unlabelled").union(gone(b, a, "unknown label"))


LINES = f"""select distinct 'document' side, doc_id id, line from (select doc_id, {V.pstrip_sql('l')} line
 from (select doc_id, unnest(string_split(text, chr(10))) l from documents)) where line <> '' union all
 select distinct 'benchmark', item_id, {V.pstrip_sql('text')} from benchmark where {V.pstrip_sql('text')} <> ''"""


@query(f"""select sha256(line) digest, side, count(*) n, list_sort(list(id))[1:5] ids from ({LINES}) where line in (select line from ({LINES})
 group by line having count(distinct side) > 1) group by line, side""")
def exact_leakage(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select(F.lit("document").alias("side"), F.col("doc_id").alias("id"), X.pstrip("l").alias("line"))
    items = table(spark, d, "benchmark").select(F.lit("benchmark").alias("side"), F.col("item_id").alias("id"), X.pstrip("text").alias("line"))
    return D.shared_texts(lines.union(items).where("line <> ''"), "line", "id", "side", 5)


PARTS = "select doc_id, text, if(('0x' || substr(md5('split|' || doc_id), 1, 12))::bigint % 5 = 0, 'test', 'train') part from documents"


@query(f"""select sha256(text) digest, part as side, count(*) n, list_sort(list(doc_id))[1:5] ids from ({PARTS}) where text in (select text from ({PARTS}) where {V.pstrip_sql('text')} <> ''
 group by text having count(distinct part) > 1) group by text, part""")
def split_leakage(spark, d):
    """Whole texts of documents that lie in both parts of a split by a hash of the id, with the first ids of each part."""
    part = F.when(F.pmod(X.unit_hash(F.lit("split"), "doc_id"), F.lit(5)) == 0, "test").otherwise("train")
    rows = table(spark, d, "documents").select("doc_id", "text", part.alias("side")).where(X.pstrip("text") != "")
    return D.shared_texts(rows, "text", "doc_id", "side", 5)


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def union_last_wins(spark, d):
    parts = table(spark, d, "events").select("user_id", "event_id", "value")
    return D.last_wins(parts, "user_id", "event_id").select("user_id", "event_id", "value")


@query("""select conv_id sample_id, 'reference' task, null::varchar anon_id, turn from conversations union all
 select conv_id, 'candidate', chr((65 + turn % 4)::int), turn from conversations""")
def task_union(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), "turn")
    candidate = t.withColumn("task", F.lit("candidate")).withColumn("anon_id", F.char(65 + F.pmod("turn", F.lit(4))))
    return t.withColumn("task", F.lit("reference")).unionByName(candidate, allowMissingColumns=True)


RULED = [("quality", "n_chars > 500"), ("toxic", "n_chars % 10 = 0")]


@query(
    "select doc_id, field from (select doc_id, unnest(["
    + ", ".join(f"case when l.{f} is distinct from ({rule})::int then '{f}' end" for f, rule in RULED)
    + "]) field from labels l join documents using (doc_id)) where field is not null"
)
def content_mismatch(spark, d):
    """Fields in which the labels differ from those that rules on the text's length would give."""
    ruled = table(spark, d, "documents").select("doc_id", *[F.expr(rule).cast("int").alias(f) for f, rule in RULED])
    return V2.mismatches(table(spark, d, "labels"), ruled, "doc_id", [f for f, _ in RULED])


@query("""select id, sha256(text) expected, case when f.digest is null then 'missing' when f.digest = sha256(text) then 'ok' else 'mismatch' end status
 from (select doc_id id, text from documents) left join (select doc_id id, sha256(case when quality = 0 then text || '!' else text end) digest from labels join documents using (doc_id)) f using (id)""")
def checksum_verify(spark, d):
    from corpusloom.sources.checksums import verify

    t, labelled = table(spark, d, "documents"), table(spark, d, "labels")
    expected = t.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("expected"))
    changed = F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return verify(expected, labelled.join(t, "doc_id").select(F.col("doc_id").alias("id"), F.sha2(changed, 256).alias("digest")), "id")


@query("select doc_id, sha256(text) sha256 from documents")
def content_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(f"""with l as (select doc_id, i, {V.pstrip_sql('lines[i]')} line from (select doc_id, string_split(text, chr(10)) lines, unnest(generate_series(1, len(string_split(text, chr(10))))) i from documents)),
 n as (select doc_id, line, row_number() over (partition by doc_id order by i) - 1 rn from l where line <> '')
 select a.doc_id, a.rn // 2 as pair, a.line source, b.line target from n a join n b on a.doc_id = b.doc_id and b.rn = a.rn + 1 where a.rn % 2 = 0""")
def paired_lines(spark, d):
    from corpusloom.sources.lines import pair_lines

    return pair_lines(table(spark, d, "documents"), "doc_id", "text")


@query("select ordinal, line from (select a.conv_id * 2000 + a.turn * 2 ordinal, source line from (%s) a union all select a.conv_id * 2000 + a.turn * 2 + 1, target from (%s) a)" % (V.TURNS, V.TURNS))
def interleaved_corpus(spark, d):
    t = V.turns(spark, d)
    return t.select((F.col("conv_id") * 2000 + F.col("turn") * 2).alias("base"), F.posexplode(F.array("source", "target"))).select((F.col("base") + F.col("pos")).alias("ordinal"), F.col("col").alias("line"))
