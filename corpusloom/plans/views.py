"""How the driver's tables stand in for manifests, predictions, verdicts and logs, once for Spark and once for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.sentences import first_sentences
from corpusloom.runtime import dealt_table as table

SEED = "corpusloom"
SYSTEMS = ("lead1", "lead3", "neural", "pretrained")
FIELDS = ("faithfulness", "informativeness", "fluency", "conciseness")

#: The white space of str.split() for RE2, and the token pattern.
UWS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_UWS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """documents as a manifest: id, split, source, reference (the first line), doc_id, lang, origin."""
    t = table(spark, d, "documents")
    return t.select(F.concat(F.lit("test_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("id"), F.lit("test").alias("split"), F.col("text").alias("source"), F.substring_index("text", "\n", 1).alias("reference"), "doc_id", "lang", F.col("source").alias("origin"))


MANIFEST = """select 'test_' || lpad(doc_id::varchar, 6, '0') id, 'test' split, text source, split_part(text, chr(10), 1) reference, doc_id, lang, source origin
 from documents"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of turns of a conversation: conv_id, turn, source (a turn) and target (the next)."""
    t = table(spark, d, "conversations")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return t.select("conv_id", "turn", "role", F.col("text").alias("source")).join(after, ["conv_id", "turn"])


TURNS = "select a.conv_id, a.turn, a.role, a.text source, b.text target from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1"


def draw(*parts: F.Column | str, out_of: int) -> F.Column:
    """A number from 0 to out_of - 1 from a hash of the parts."""
    return F.pmod(X.unit_hash(*parts), F.lit(out_of))


def draw_sql(parts: str, out_of: int) -> str:
    return f"(('0x' || substr(md5({parts}), 1, 12))::bigint % {out_of})"


def scores(spark: SparkSession, d: str) -> DataFrame:
    """A verdict for each labelled document and system: sample_id, system, four scores 1..5, major_error, ordinal."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), "quality", "toxic").withColumn("system", F.explode(F.array(*map(F.lit, SYSTEMS))))
    out = [(draw(F.col("sample_id"), "system", F.lit(f), out_of=5) + 1).cast("int").alias(f) for f in FIELDS]
    return rows.select("sample_id", "system", *out, (draw(F.col("sample_id"), "system", F.lit("major"), out_of=4) == 0).alias("major_error"), "quality", "toxic")


SCORES = "select sample_id, system, " + ", ".join(f"({draw_sql(f'''sample_id::varchar || '|' || system || '|{f}' ''', 5)} + 1)::int {f}" for f in FIELDS) + f", {draw_sql('''sample_id::varchar || '|' || system || '|major' ''', 4)} = 0 major_error, quality, toxic from (select doc_id sample_id, quality, toxic, unnest(['lead1', 'lead3', 'neural', 'pretrained']) as system from labels)"


def blind(spark: SparkSession, d: str) -> DataFrame:
    """The blind labels: sample_id, system, anon_id A..D."""
    from corpusloom.operators.sampling import blind_labels

    return blind_labels(table(spark, d, "labels").select(F.col("doc_id").alias("sample_id")), SYSTEMS, SEED)


BLIND = f"""select sample_id, system, chr((64 + row_number() over (partition by sample_id
 order by sha256('{SEED}|blind|' || sample_id || '|' || system), system))::int) anon_id
 from (select doc_id sample_id, unnest(['lead1', 'lead3', 'neural', 'pretrained']) as system from labels)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Lead-1 and lead-3 predictions of all documents; under 4 words give an error row, under 2 no lead-3 row."""
    m = manifest(spark, d)
    # The few sentences asked for are found once a document, before the systems, and only where a prediction is asked for;
    # whether there are words enough is told from the first ones.
    rows = m.select("id", "doc_id", "source", X.has_words("source", 4).alias("ok"), X.has_words("source", 2).alias("two"), first_sentences("source", 3).alias("s"))
    rows = rows.withColumn("system", F.explode(F.array(F.lit("lead1"), F.lit("lead3")))).where("two or system = 'lead1'")
    made = F.array_join(F.slice("s", F.lit(1), F.when(F.col("system") == "lead1", 1).otherwise(3)), " ")
    ok, prediction = F.col("ok"), F.coalesce(F.nullif(made, F.lit("")), F.col("source"))
    return rows.select("id", "system", F.lit("default").alias("config_id"), F.when(ok, prediction).otherwise("").alias("prediction"), F.when(ok, "ok").otherwise("error").alias("status"), F.when(~ok, "too short").alias("error"), "doc_id")


ABBREVIATIONS = "BS|TS|GS|PGS|ThS|KS|NSND|NSƯT|TP"


def pstrip_sql(e: str) -> str:
    return f"regexp_replace({e}, '\\A{UWS}+|{UWS}+\\z', '', 'g')"


def sentences_sql(e: str) -> str:
    """DuckDB's list of sentences; RE2 has no look-around, so neighbours are consumed and written back."""
    t = pstrip_sql(e)
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}\p{{N}}_])({ABBREVIATIONS})\.{UWS}+(\p{{Lu}})', '\1\2' || chr(1) || ' \3', 'g')"
    t = rf"regexp_replace({t}, '(\.\.\.|…){UWS}+(\p{{Ll}})', '\1 \2', 'g')"
    t = rf"regexp_replace({t}, '([.!?…][\"”'']?){UWS}+([\p{{Lu}}\p{{Nd}}\"“(])', '\1' || chr(2) || '\2', 'g')"
    t = rf"regexp_replace({t}, '\n+', chr(2), 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(2)), lambda s: replace({pstrip_sql('s')}, chr(1), '.')), lambda s: s <> '')"


def lead_sql(e: str, n: int) -> str:
    return f"coalesce(nullif(array_to_string(({sentences_sql(e)})[1:{n}], ' '), ''), {e})"


def words_sql(e: str) -> str:
    return f"coalesce(len(regexp_extract_all({e}, '{NOT_UWS}+')), 0)::bigint"


def tokens_sql(e: str) -> str:
    return rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_]+')"


def nfc_sql(e: str) -> str:
    return f"nfc_normalize({e})"


PREDICTIONS = f"""select id, system, 'default' config_id, case when n >= 4 then prediction else '' end prediction, case when n >= 4 then 'ok' else 'error' end status,
    case when n < 4 then 'too short' end error, doc_id
    from (select id, doc_id, {words_sql('source')} n, 'lead1' as system, {lead_sql('source', 1)} prediction from ({MANIFEST}) union all
          select id, doc_id, {words_sql('source')} n, 'lead3' as system, {lead_sql('source', 3)} prediction from ({MANIFEST}))
    where n > 1 or system = 'lead1'"""
