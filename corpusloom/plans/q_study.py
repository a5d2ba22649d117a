"""Queries of sampling, splits, blind studies, resumable logs and verdict coercion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import verdicts as W
from corpusloom.operators import resume as R
from corpusloom.operators import sampling as P
from corpusloom.operators import study as T
from corpusloom.operators import validate as V2
from corpusloom.operators.dedup import first_examples
from corpusloom.plans import views as V
from corpusloom.plans.registry import query
from corpusloom.runtime import dealt_table as table
from corpusloom.runtime import stored
from corpusloom.sources import jsonl

RANKED = f"select doc_id, lang, {V.words_sql('text')} n, ntile(4) over (order by {V.words_sql('text')}, doc_id)::int stratum from documents"


def ranked(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", X.word_count("text").alias("n"))
    return P.rank_strata(rows, 4, [F.col("n"), F.col("doc_id")])


@query(f"select doc_id, n, stratum from ({RANKED})")
def rank_strata(spark, d):
    return ranked(spark, d).select("doc_id", "n", "stratum")


@query(f"select stratum, count(*) n_rows, min(n) lowest, max(n) highest from ({RANKED}) group by stratum")
def strata_bounds(spark, d):
    return ranked(spark, d).groupBy("stratum").agg(F.count("*").alias("n_rows"), F.min("n").alias("lowest"), F.max("n").alias("highest"))


@query(f"select stratum, lang, doc_id, row_number() over (partition by stratum, lang order by doc_id) nth from ({RANKED})")
def strata_members(spark, d):
    """The members of each stratum and language in order, one row each: no list grows with its stratum."""
    return P.numbered(ranked(spark, d), ["stratum", "lang"], "doc_id").select("stratum", "lang", "doc_id", "nth")


def drawn_sql(rows: str, k: int, namespace: str) -> str:
    return f"select * from (select *, row_number() over (partition by stratum order by sha256('{V.SEED}|{namespace}|' || doc_id), doc_id)::int draw from ({rows})) where draw <= {k}"


@query(f"select stratum, doc_id, draw from ({drawn_sql(RANKED, 50, 'main')})")
def stratified_sample(spark, d):
    return P.sample_strata(ranked(spark, d), "stratum", "doc_id", 50, V.SEED, "main").select("stratum", "doc_id", "draw")


@query(f"select stratum, doc_id, draw, draw <= 25 in_backup from ({drawn_sql(RANKED, 50, 'main')})")
def nested_sample(spark, d):
    sample = P.sample_strata(ranked(spark, d), "stratum", "doc_id", 50, V.SEED, "main")
    return sample.select("stratum", "doc_id", "draw", (F.col("draw") <= 25).alias("in_backup"))


HUMAN = f"select stratum, doc_id, draw from ({drawn_sql('select stratum, doc_id from (' + drawn_sql(RANKED, 50, 'main') + ')', 10, 'human')})"


def human(spark, d):
    first = P.sample_strata(ranked(spark, d), "stratum", "doc_id", 50, V.SEED, "main").select("stratum", "doc_id")
    return P.sample_strata(first, "stratum", "doc_id", 10, V.SEED, "human")


@query(HUMAN)
def human_sample(spark, d):
    return human(spark, d).select("stratum", "doc_id", "draw")


@query(f"select doc_id sample_id, stratum, 'AR' anon_id, 'pilot-repeat' run_id from ({drawn_sql(f'select stratum, doc_id from ({HUMAN})', 3, 'repeat')})")
def repeat_tasks(spark, d):
    again = P.sample_strata(human(spark, d).drop("draw"), "stratum", "doc_id", 3, V.SEED, "repeat")
    return again.select(F.col("doc_id").alias("sample_id"), "stratum", F.concat(F.lit("A"), F.lit("R")).alias("anon_id"), F.lit("pilot-repeat").alias("run_id"))


@query()
def repeat_spacing(spark, d):
    """Places of the human blocks, each repeat 15 or more after its original: a study of a few dozen rows."""
    chosen = human(spark, d).select("stratum", "doc_id")
    again = P.sample_strata(chosen, "stratum", "doc_id", 2, V.SEED, "repeat")
    ids = lambda df: [str(r[0]) for r in df.select("doc_id").orderBy("doc_id").collect()]
    blocks = T.arrange_blocks(ids(chosen), ids(again), 15)
    return spark.createDataFrame([(k, s, r) for k, (s, r) in enumerate(blocks)], "position int, sample_id string, is_repeat boolean")


@query(f"""with b as (select doc_id, row_number() over (order by sha256('{V.SEED}|block|' || doc_id), doc_id) k from ({HUMAN}))
 select 'H' || lpad(k::varchar, 3, '0') block_id, 'C' || (ascii(anon_id) - 64) candidate_id, doc_id sample_id, system from b
 join (select doc_id, system, chr((64 + row_number() over (partition by doc_id
 order by sha256('{V.SEED}|blind|' || doc_id || '|' || system), system))::int) anon_id
 from (select doc_id, unnest(['lead1', 'lead3', 'neural', 'pretrained']) as system from documents)) using (doc_id)""")
def human_blocks(spark, d):
    placed = P.place(human(spark, d).select("doc_id"), [P.hash_order(F.lit(V.SEED), F.lit("block"), "doc_id"), F.col("doc_id")]).select(F.col("doc_id").alias("sample_id"), "place")
    labels = P.blind_labels(placed, V.SYSTEMS, V.SEED)
    return labels.join(placed, "sample_id").select(F.concat(F.lit("H"), F.lpad((F.col("place") + 1).cast("string"), 3, "0")).alias("block_id"), F.concat(F.lit("C"), (F.ascii("anon_id") - 64).cast("string")).alias("candidate_id"), "sample_id", "system")


@query(V.BLIND)
def blind_mapping(spark, d):
    return V.blind(spark, d)


PLACED = f"select doc_id, row_number() over (order by sha256('{V.SEED}|' || doc_id), doc_id) - 1 p, count(*) over () n from documents"


@query(f"select doc_id, case when p < floor(n * 0.8) then 'train' when p < floor(n * 0.8) + floor(n * 0.1) then 'validation' else 'test' end split from ({PLACED})")
def split_801010(spark, d):
    return P.split_exact(table(spark, d, "documents").select("doc_id"), "doc_id", V.SEED, [("train", 0.8), ("validation", 0.1)], "test")


@query(f"select doc_id, case when p < floor(n * 0.2) then 'tune' when p < floor(n * 0.2) + floor(n * 0.1) then 'check' else 'rest' end slice from ({PLACED})")
def tuning_slices(spark, d):
    return P.split_exact(table(spark, d, "documents").select("doc_id"), "doc_id", V.SEED, [("tune", 0.2), ("check", 0.1)], "rest", "slice")


@query(f"""with x as (select doc_id, n, (n < 20) warned, sha256('{V.SEED}|priority|' || doc_id) h, row_number() over (order by n, doc_id) lo, row_number() over (order by n desc, doc_id desc) hi from ({RANKED})),
 y as (select doc_id, case when warned then 1 when lo = 1 then 2 when hi = 1 then 3 else 4 end priority, h from x) select doc_id, priority::int priority from y order by priority, h, doc_id limit (select greatest(200, count(*) // 5) from documents)""")
def priority_sample(spark, d):
    """Warned rows, the shortest, the longest, then rows in hash order: a fifth of all rows, 200 at least."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return prioritized(docs, max(200, docs.count() // 5))


def prioritized(docs, total):
    """(doc_id, priority): all warned rows, the shortest, the longest, and rows in hash order until there are `total`.

    A row of under 20 words or with a flag of text_flags is warned. More warned rows than `total` are an error, as they are
    in the study; the shortest and the longest row come on top of warned ones where these reach the total.
    """
    n = X.word_count("text")
    warned = F.coalesce((n < 20) | (F.size(V2.codes(V2.text_flags("text"))) > 0), F.lit(False))
    # Flags are dear, so they are found once; the ends, the count and both parts of the sample read numbers alone.
    rows = stored(docs.select("doc_id", n.alias("n"), warned.alias("warned")), "warned")
    own = F.struct("n", "doc_id")
    ends = rows.agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.count_if("warned").alias("n_warned"))
    n_warned = ends.first()["n_warned"]
    if n_warned > total:
        raise ValueError(f"{n_warned} rows are warned, more than the total of {total}")
    priority = F.when(F.col("warned"), 1).when(own == F.col("lo"), 2).when(own == F.col("hi"), 3).otherwise(4)
    ranked_ = rows.crossJoin(ends).select("doc_id", priority.alias("priority"))
    must = ranked_.where("priority < 4")
    fill = ranked_.where("priority = 4").orderBy(P.hash_order(F.lit(V.SEED), F.lit("priority"), "doc_id"), "doc_id").limit(max(0, total - must.count()))
    return must.unionByName(fill)


@query("select event_type, event_id, value from events qualify row_number() over (partition by event_type order by value desc, event_id) <= 20")
def topk_examples(spark, d):
    return first_examples(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")], 20)


@query("select p as rank, count(*) n, sum(doc_id)::bigint ids from (select doc_id, (row_number() over (order by doc_id) - 1) % 8 p from documents) group by p")
def modulo_partition(spark, d):
    placed = P.place(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")])
    return placed.groupBy(F.pmod("place", F.lit(8)).alias("rank")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("select doc_id, (['lead1', 'lead3', 'neural', 'pretrained'])[((row_number() over (order by doc_id) - 1) % 4 + 1)::int] as system from labels")
def round_robin(spark, d):
    placed = P.place(table(spark, d, "labels").select("doc_id"), [F.col("doc_id")])
    return T.round_robin(placed, "place", V.SYSTEMS).select("doc_id", "system")


@query(f"select p.id, p.system, p.status from ({V.PREDICTIONS}) p semi join labels l on p.doc_id = l.doc_id")
def sample_restrict(spark, d):
    return V.predictions(spark, d).join(table(spark, d, "labels"), "doc_id", "left_semi").select("id", "system", "status")


@query(f"""select 'candidate' task, b.sample_id, b.anon_id, p.prediction candidate from ({V.BLIND}) b
 join ({V.PREDICTIONS}) p on p.doc_id = b.sample_id and p.system = b.system""")
def candidate_tasks(spark, d):
    predictions = V.predictions(spark, d).withColumnRenamed("doc_id", "sample_id")
    return T.candidate_tasks(table(spark, d, "labels").select(F.col("doc_id").alias("sample_id")), V.blind(spark, d), predictions)


@query(f"select b.sample_id, b.anon_id, s.system, s.faithfulness from ({V.SCORES}) s join ({V.BLIND}) b using (sample_id, system)")
def unblind(spark, d):
    records = V.scores(spark, d).join(V.blind(spark, d), ["sample_id", "system"]).select("sample_id", "anon_id", "faithfulness")
    return T.unblind(records, V.blind(spark, d)).select("sample_id", "anon_id", "system", "faithfulness")


LOG = f"select sample_id, anon_id, faithfulness, quality from ({V.SCORES}) join ({V.BLIND}) using (sample_id, system)"
LOG = f"""select sample_id, anon_id, faithfulness from ({LOG}) union all select sample_id, anon_id || 'R', least(5, faithfulness + (sample_id % 10 = 0)::int)
 from ({LOG}) where quality = 0"""


def log(spark, d):
    own = V.scores(spark, d).join(V.blind(spark, d), ["sample_id", "system"])
    again = own.where("quality = 0").select("sample_id", F.concat("anon_id", F.lit("R")), F.least(F.lit(5), F.col("faithfulness") + (F.col("sample_id") % 10 == 0).cast("int")))
    return own.select("sample_id", "anon_id", "faithfulness").union(again)


STABLE = f"""select a.sample_id, a.anon_id, a.faithfulness as first, b.faithfulness again from ({LOG}) a
 join ({LOG}) b on a.sample_id = b.sample_id and b.anon_id = a.anon_id || 'R'"""


@query(STABLE)
def pilot_stability(spark, d):
    return T.pilot_stability(log(spark, d), "faithfulness")


FIELDS_SQL = ", ".join(V.FIELDS)
OWN = f"select sample_id, anon_id, quality, {FIELDS_SQL} from ({V.SCORES}) join ({V.BLIND}) using (sample_id, system)"
FULL_LOG = f"""select 'candidate' task, 'pilot' run_id, * exclude (quality) from ({OWN}) union all
 select 'candidate', 'pilot-repeat', sample_id, anon_id || 'R', least(5, faithfulness + (sample_id % 10 = 0)::int), {', '.join(V.FIELDS[1:])}
 from ({OWN}) where quality = 0"""
FULL_LOG = f"select *, case when {V.draw_sql("sample_id::varchar || '|' || anon_id || '|attempts'", 40)} = 0 then 2 else 1 end attempts from ({FULL_LOG})"
GAPS = " union all ".join(f"select abs(a.{f} - b.{f}) gap from ({FULL_LOG}) a join ({FULL_LOG}) b on a.run_id = 'pilot' and b.run_id = 'pilot-repeat' and a.sample_id = b.sample_id and b.anon_id = a.anon_id || 'R'" for f in V.FIELDS)


def full_log(spark, d):
    """The score log of a pilot: every task once, those of bad samples again, with the attempts that each took."""
    own = V.scores(spark, d).join(V.blind(spark, d), ["sample_id", "system"]).withColumn("run_id", F.lit("pilot"))
    changed = F.least(F.lit(5), F.col("faithfulness") + (F.col("sample_id") % 10 == 0).cast("int"))
    again = own.where("quality = 0").withColumn("run_id", F.lit("pilot-repeat")).withColumn("anon_id", F.concat("anon_id", F.lit("R"))).withColumn("faithfulness", changed)
    rows = own.union(again).withColumn("task", F.lit("candidate"))
    attempts = F.when(V.draw("sample_id", "anon_id", F.lit("attempts"), out_of=40) == 0, 2).otherwise(1)
    return rows.select("task", "run_id", "sample_id", "anon_id", *V.FIELDS, attempts.alias("attempts"))


@query(f"""with g as (select count(*) n, avg((gap <= 1)::int) w, max(gap) m from ({GAPS})), l as (select count(*) n, count(*) filter (attempts = 1) f from ({FULL_LOG})),
 e as (select 4 * count(*) + 4 * count(*) filter (quality = 0) n from labels)
 select e.n expected_records, l.n valid_records, round(l.f::double / e.n, 4) first_pass_rate, g.n n_comparisons, round(g.w, 4) within_one, g.m largest,
 case when l.n = e.n and l.f::double / e.n >= 0.95 and g.w >= 0.9 and g.m <= 2 then 'passed' else 'needs_review' end status from g, l, e""")
def pilot_gate(spark, d):
    wanted = table(spark, d, "labels").agg((4 * F.count("*") + 4 * F.count_if(F.col("quality") == 0)).alias("expected_records"))
    return T.assess_pilot(full_log(spark, d), wanted, V.FIELDS)


@query("select doc_id from documents anti join labels using (doc_id)")
def pending_tasks(spark, d):
    return R.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


PARTS = "select user_id id, event_id ordinal, case when event_type = 'click' then 'error' else 'ok' end status, value from events"


@query(f"""select id, ordinal, status from ({PARTS}) qualify row_number() over (partition by id
 order by ordinal desc) = 1 and status = 'ok' and id in (select c_custkey from customer)""")
def resume_state(spark, d):
    e = table(spark, d, "events")
    parts = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "click", "error").otherwise("ok").alias("status"))
    return R.resume_state(parts, table(spark, d, "customer").select(F.col("c_custkey").alias("id"))).select("id", "ordinal", "status")


@query(f"""select m.id, m.doc_id ordinal, coalesce(p.status, 'missing') status, p.prediction from ({V.MANIFEST}) m left join (select * from ({V.PREDICTIONS})
 where system = 'lead3') p using (id)""")
def ordered_merge(spark, d):
    results = V.predictions(spark, d).where("system = 'lead3'").select("id", "status", "prediction")
    return R.ordered_merge(V.manifest(spark, d).select("id", F.col("doc_id").alias("ordinal")), results)


@query("""select conv_id, turn, round(least(60.0, pow(2.0, turn)) * (1 + (('0x' || substr(md5(conv_id || '|' || (turn + 1)), 1, 12))::bigint % 1000) / 10000.0),
 6) wait from conversations""")
def retry_schedule(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.round(R.retry_delay(F.col("turn") + 1, F.col("conv_id")), 6).alias("wait"))


@query(
    "select event_id, props, if(k % 7 = 0, null, (2 * k)::varchar) as value, if(k % 7 = 0, k || ' is a multiple of 7', null) error, if(k % 7 = 0, 2, 1)::int attempts, null::varchar raw"
    " from (select event_id, props, json_extract_string(props, '$.k')::bigint k from events)"
)
def row_errors(spark, d):
    """Each event's k by a function that fails for some: value, error and attempts of every row."""
    from corpusloom.runtime import ship

    ship(spark)
    return R.call_rows(table(spark, d, "events").select("event_id", "props"), twice_k, 2)


def twice_k(row: dict) -> str:
    import json

    k = json.loads(row["props"])["k"]
    if k % 7 == 0:
        raise ValueError(f"{k} is a multiple of 7")
    return str(2 * k)


@query("select user_id, row_number() over (partition by user_id order by event_id) line, json_extract_string(props, '$.k')::bigint k from events")
def jsonl_scan(spark, d):
    """Strict scan of the events' props, the lines of a user in the order of events."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("props").alias("text"))
    return jsonl.scan(P.numbered(rows, "user_id", "event_id", "line"), "k long").select("user_id", "line", "k")


LINES = "select doc_id, unnest(l) as text, generate_subscripts(l, 1) as line from (select doc_id, if(l[-1] = '', l[:-2], l) l from (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) l from documents))"


@query(f"""select doc_id, line, issue from (select doc_id, line, case when trim(text, ' ') = '' then 'BLANK_LINE' when not json_valid(text) then 'INVALID_JSON'
 when json_type(if(json_valid(text), text, 'null')) <> 'OBJECT' then 'NOT_JSON_OBJECT' end issue from ({LINES})) where issue is not null""")
def jsonl_issues(spark, d):
    """Issues of documents read as JSON Lines: invalid, blank or no object."""
    return jsonl.judged(jsonl.lines_of(table(spark, d, "documents"), "doc_id", "text")).where("issue is not null").select("doc_id", "line", "issue")


CASES = [("good_neural", "neural", "not major_error", "total", -1), ("good_pretrained", "pretrained", "not major_error", "total", -1), ("factual_error", "neural", "major_error or faithfulness < 3", "faithfulness", 1), ("omission", "pretrained", "major_error", "informativeness", 1), ("lead_bias", "lead1", "not major_error", "informativeness", -1), ("fluent_error", "neural", "major_error and fluency >= 4", "fluency", -1)]


@query(" union all ".join(f"(select '{c}' as case_name, system, sample_id from (select *, faithfulness + informativeness + fluency + conciseness total from ({V.SCORES})) where system = '{s}' order by case when {p} then 0 else 1 end, {v} {'asc' if o > 0 else 'desc'}, sample_id limit 1)" for c, s, p, v, o in CASES))
def qualitative_cases(spark, d):
    """The first sample of each case by its score, among those that fit if any do; all cases in one aggregation."""
    rows = V.scores(spark, d).withColumn("total", sum(F.col(f) for f in V.FIELDS))
    best = [F.min_by(F.struct(F.lit(c).alias("case_name"), "system", "sample_id"), F.when(F.col("system") == s, F.struct((~F.expr(p)).cast("int"), F.col(v) * o, "sample_id"))).alias(c) for c, s, p, v, o in CASES]
    return rows.agg(*best).select(F.explode(F.array(*[c[0] for c in CASES])).alias("x")).select("x.*")


RAW = """select doc_id, case when doc_id % 5 = 0 then '"' || (quality + 3) || '"' when doc_id % 5 = 1 then 'true' when doc_id % 5 = 2 then '4.5' else (quality * 3 + toxic + 1)::varchar end v, '{"score": ' || v || '}' body from labels"""


def raw(spark, d):
    n = F.pmod("doc_id", F.lit(5))
    v = F.when(n == 0, F.concat(F.lit('"'), (F.col("quality") + 3).cast("string"), F.lit('"'))).when(n == 1, "true").when(n == 2, "4.5").otherwise((F.col("quality") * 3 + F.col("toxic") + 1).cast("string"))
    return table(spark, d, "labels").select("doc_id", F.concat(F.lit('{"score": '), v, F.lit("}")).alias("body"))


@query(f"""select doc_id, case when json_type(body, '$.score') <> 'BOOLEAN' and x = floor(x) and x between 1 and 5 then x::int end score
 from (select doc_id, body, try_cast(json_extract_string(body, '$.score') as double) x from ({RAW}))""")
def ordinal_coerce(spark, d):
    return raw(spark, d).select("doc_id", W.ordinal(F.get_json_object("body", "$.score"), W.kind_of(F.col("body"), "$.score")).alias("score"))


@query("select doc_id, case when doc_id % 3 = 0 then null else quality = 1 end flag from labels")
def boolean_coerce(spark, d):
    written = F.when(F.pmod("doc_id", F.lit(3)) == 0, "maybe").when(F.pmod("doc_id", F.lit(3)) == 1, F.concat(F.lit(" "), F.initcap((F.col("quality") == 1).cast("string")))).otherwise(F.upper((F.col("quality") == 1).cast("string")))
    return table(spark, d, "labels").select("doc_id", W.boolean(written).alias("flag"))


@query("select doc_id, case when quality = 1 then [lang, source, ''] when toxic = 1 then [] else [lang] end listed from labels join documents using (doc_id)")
def list_coerce(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    body = F.when(F.col("quality") == 1, F.to_json(F.struct(F.array(F.concat(F.lit(" "), "lang"), F.col("source"), F.lit("  ")).alias("c")))).when(F.col("toxic") == 1, F.lit('{"c": "  "}')).otherwise(F.to_json(F.struct(F.concat("lang", F.lit(" ")).alias("c"))))
    rows = t.select("doc_id", body.alias("body"))
    return rows.select("doc_id", W.string_list(F.get_json_object("body", "$.c"), W.kind_of(F.col("body"), "$.c")).alias("listed"))


@query("""select event_id, case when event_id % 3 = 0 then 4 when value between 0 and 1 and value <> 1 then least(5, greatest(1, floor(value * 4 + 0.5)::int +
 1)) when value = floor(value) and value between 1 and 5 then value::int end confidence from events""")
def confidence_coerce(spark, d):
    written = F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(" High ")).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", W.confidence(written).alias("confidence"))


PROBLEM = "case sample_id % 9 when 0 then 'schema mismatch' when 1 then 'error_types' when 2 then 'evidence' when 3 then 'fluency' end"


@query(f"""select sample_id, system, problem, {', '.join(f'case when problem is null then {f} end {f}' for f in V.FIELDS)}, case when problem is null then major_error end major_error,
 case when problem is null then case when len(e) = 0 then ['none'] else e end end error_types, case when problem is null then 'seen in line 3' end evidence, case when problem is null then 'short' end reason
 from (select s.*, {PROBLEM} problem, list_filter([case when major_error then 'wrong_entity' end, case when fluency < 2 then 'incoherence' end], lambda x: x is not null) e from ({V.SCORES}) s)""")
def verdict_normalize(spark, d):
    """Verdicts written as loose JSON (strings for numbers, varied spelling, repeats, none beside others) made strict;
    some with an extra field, an unknown error type, 61 words of evidence, or a fraction for a score."""
    case = F.col("sample_id") % 9
    named = F.concat(
        F.array_compact(F.array(F.when(F.col("major_error"), "Wrong Entity"), F.when(F.col("major_error"), "wrong-entity"), F.when(F.col("fluency") < 2, " INCOHERENCE "), F.when(case == 1, "grammar"))),
        F.when(F.col("major_error"), F.array(F.lit("none"))).otherwise(F.array().cast("array<string>")),
    )
    body = F.to_json(F.struct(
        *[F.concat(F.col(f).cast("string"), F.when((case == 3) & (F.lit(f) == "fluency"), ".5").otherwise("")).alias(f) for f in V.FIELDS], F.upper(F.col("major_error").cast("string")).alias("major_error"), named.alias("error_types"),
        F.when(case == 2, F.repeat(F.lit("word "), 61)).otherwise("  seen in line 3 ").alias("evidence"), F.lit("short").alias("reason"), F.when(case == 0, "x").alias("extra"),
    ))
    return V.scores(spark, d).select("sample_id", "system", W.candidate_verdict(body).alias("v")).select("sample_id", "system", "v.*")


#: What a reference's verdict says, by case; the problem that it has, and what it is made strict.
REFERENCE_CASES = """select doc_id sample_id, case when doc_id % 11 = 0 then 'label' when doc_id % 4 = 3 then 'unsupported_claims' when doc_id % 6 = 5 then 'confidence' end problem,
 (['fully_supported', 'partially_supported', 'unsupported', 'mismatched'])[(quality * 2 + toxic + 1)::int] as label, case doc_id % 4 when 0 then [] when 1 then ['one claim'] else ['a', 'b c'] end claims,
 case doc_id % 6 when 0 then 4 when 1 then 4 when 2 then 2 when 3 then 5 else 1 end confidence from labels"""


@query(f"""select sample_id, problem, case when problem is null then label end as label, case when problem is null then claims end unsupported_claims, case when
 problem is null then 'e' end evidence, case when problem is null then confidence end confidence, case when problem is null then 'r' end reason
 from ({REFERENCE_CASES})""")
def reference_verdict(spark, d):
    """References' verdicts from loose JSON: labels, claims as a string or a list, confidence as a word, number or share."""
    t = table(spark, d, "labels").withColumnRenamed("doc_id", "sample_id")
    k = F.col("sample_id")
    of = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    label = F.when(k % 11 == 0, "Supported").otherwise(F.element_at(F.array(*map(F.lit, W.REFERENCE_LABELS)), (F.col("quality") * 2 + F.col("toxic") + 1).cast("int")))
    claims = of(4, '"  "', '" one claim"', '["a", " b c "]', '["1", "2", "3", "4", "5", "6"]')
    sure = of(6, '" High"', "0.75", '"2"', "5.0", "0", "true")
    body = F.concat(F.lit('{"label": "'), label, F.lit('", "unsupported_claims": '), claims, F.lit(', "evidence": " e ", "confidence": '), sure, F.lit(', "reason": "r"}'))
    return t.select("sample_id", W.reference_verdict(body).alias("v")).select("sample_id", "v.*")


def human_table(spark, d):
    """A human study's table as it is typed: strings, some left blank, yes and no in either language."""
    s = V.scores(spark, d)
    blank = (F.col("toxic") == 1) & (F.col("quality") == 0)
    typed = [F.when(F.lit(f == V.FIELDS[0]) & blank, " ").otherwise(F.concat(F.lit(" "), F.col(f).cast("string"))).alias(f) for f in V.FIELDS]
    answer = F.when(F.col("major_error"), "Có ").when(F.col("fluency") > 3, "không").otherwise("No")
    name = F.concat_ws("/", F.lpad(F.col("sample_id").cast("string"), 12, "0"), "system")
    return s.select(name.alias("row"), "sample_id", "system", *typed, answer.alias("major_error"))


@query(f"select sample_id, system, {', '.join(V.FIELDS)}, major_error from ({V.SCORES}) where not (toxic = 1 and quality = 0)")
def human_annotations(spark, d):
    return T.human_annotations(human_table(spark, d), "row", V.FIELDS).select("sample_id", "system", *V.FIELDS, "major_error")


@query(f"""select if(count(*) filter (blank) = 0, 'complete', 'incomplete') status, count(*) filter (not blank) annotated_rows, count(*) filter (blank) missing_rows,
 coalesce((list(name order by name) filter (blank))[1:20], []) missing_examples
 from (select toxic = 1 and quality = 0 blank, lpad(sample_id::varchar, 12, '0') || '/' || system as name from ({V.SCORES}))""")
def annotation_report(spark, d):
    """Whether a human study is complete, and its first blank rows."""
    return T.annotation_report(human_table(spark, d), "row", F.col("row"), V.FIELDS)


@query(f"select doc_id, lang from documents order by sha256('{V.SEED}|peek|' || doc_id), doc_id limit 100")
def random_peek(spark, d):
    """A fixed number of rows in hash order, for a look at a table."""
    return P.peek(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, V.SEED)


@query("select list_sort(list(distinct source)) config_ids, count(distinct source) = 1 uniform from documents")
def config_ids(spark, d):
    """The settings that occur, in order, and whether there is one."""
    return V2.config_ids(table(spark, d, "documents"), "source")


@query(f"""select id, line, list_filter([case when doc_id % 5 = 0 then 'missing field' end, case when doc_id % 7 = 0 then 'extra field' end, case when doc_id % 5 <> 0 and doc_id % 3 = 0 then 'error in ok row' end], lambda x: x is not null) issues
 from (select *, doc_id as line from ({V.MANIFEST})) where doc_id % 5 = 0 or doc_id % 7 = 0 or doc_id % 3 = 0""")
def handoff_issues(spark, d):
    """Prediction lines against their closed schema of six fields: what is wrong with each."""
    k = F.col("doc_id")
    body = F.to_json(F.struct("id", F.lit("lead1").alias("system"), F.lit("default").alias("config_id"), F.lit("x").alias("prediction"), F.when(k % 5 != 0, "ok").alias("status"), F.when((k % 3 == 0) | (k % 5 == 0), "e").alias("error"), F.when(k % 7 == 0, 1).alias("more")), {"ignoreNullFields": "true"})
    body = F.when(body.contains('"error"'), body).otherwise(F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"error":null}')))
    lines = V.manifest(spark, d).select(k.alias("line"), "id", body.alias("text"))
    return V2.handoff_lines(lines, "lead1").where(F.size("issues") > 0).select("id", "line", "issues")


def graded(row: dict) -> str:
    """A stand-in for an external call, told by the text alone: some lengths are rejected, some fail at once."""
    n = len(row["text"])
    if n % 7 == 0:
        raise ValueError("rejected", f"raw {n}")
    if n % 11 == 0:
        raise RuntimeError("gone")
    return f"{row['role']}:{n}"


TASKS = "select conv_id || '|' || turn as key, role, length(text) n, conv_id % 3 part from conversations"


@query(f"""select key, if(n % 7 = 0 or n % 11 = 0, null, role || ':' || n) as value, case when n % 7 = 0 then 'rejected' when n % 11 = 0 then 'RuntimeError: gone' end error,
 case when n % 7 = 0 then 'raw ' || n end raw, case when n % 7 = 0 then 3 else 1 end attempts, case when (n % 7 = 0 or n % 11 = 0) and part = 1 then 2 else 1 end::bigint logged, part = 1 again from ({TASKS})""")
def incremental_run(spark, d):
    """Every turn of conversations as a task, in two arrivals that share a third; the stream is restarted between them."""
    from corpusloom.runtime import scratch
    from corpusloom.streaming import incremental as I

    out = scratch(spark, "incremental")
    t = V.table(spark, d, "conversations")
    tasks = t.select(F.concat_ws("|", "conv_id", "turn").alias("key"), "role", "text", F.pmod("conv_id", F.lit(3)).alias("part"))
    for k in (2, 0):
        tasks.where(F.col("part") != k).write.mode("append").parquet(f"{out}/tasks")
        counts = I.run_tasks(spark, spark.readStream.schema(tasks.schema).parquet(f"{out}/tasks"), out, graded)
        assert counts["requested"] == counts["skipped"] + counts["success"] + counts["failed"]
    done, failed, raw = (I.log(spark, out, name) for name in ("scores", "errors", "raw"))
    null = F.lit(None).cast("string")
    both = done.select("key", "value", null.alias("error"), null.alias("raw"), "attempts", "part").union(failed.select("key", null, "error", "raw", "attempts", "part"))
    twice = raw.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")  # none is called again
    rows = both.join(twice, "key", "left_anti")
    return rows.groupBy("key", "value", "error", "raw", "attempts", (F.col("part") == 1).alias("again")).agg(F.count("*").alias("logged"))


@query("select conv_id, turn, role, length(text) n from conversations")
def append_log(spark, d):
    """conversations as a log of JSON Lines whose last line is torn, read as a stream; then the line is ended, and the stream
    goes on. Every line is read once."""
    from corpusloom.runtime import scratch
    from corpusloom.sources import append_log as A

    rows, out = V.table(spark, d, "conversations"), scratch(spark, "append-log")
    lines = rows.select(jsonl.written(rows))
    last = lines.agg(F.max("value").alias("value"))
    torn = last.first()[0] or "{}"  # one line
    jsonl.write_lines(lines.join(last, "value", "left_anti"), f"{out}/log")
    for upto in (len(torn) // 2, len(torn)):
        jsonl.put_file(spark, f"{out}/log/torn.jsonl", torn[:upto] + "\n" * (upto == len(torn)), replace=True)
        stream = A.stream_log(spark, f"{out}/log").writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
        stream.trigger(availableNow=True).start(f"{out}/read").awaitTermination()
    read = spark.read.schema(A.LINES).parquet(f"{out}/read").withColumnRenamed("offset", "line")
    found = jsonl.scan(read, rows.schema)
    return found.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
