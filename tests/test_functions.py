import json
import random
import re
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import draws as D
from corpusloom.functions import metrics as M
from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.functions import verdicts as W
from corpusloom.functions.sentences import first_sentences, lead, split_sentences

ODD = ["", " ", "a", " a b ", "x y　z", "\x1c q\x85r", "é é", "a​b", "don't stop", "½ x_1 ١٢", "\t\n", None, "www.a.b/c d http://x/y z", "A" * 5000]


def texts(spark, values=ODD):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")


def test_words_and_strip_as_python(spark):
    rows = texts(spark).select("t", X.word_count("t").alias("n"), X.pstrip("t").alias("s"), X.tokens("t").alias("w"), X.normalize_metric("t").alias("m")).collect()
    for r in rows:
        t = r.t
        assert r.n == len((t or "").split())
        assert r.s == (t if t is None else t.strip())
        if t is not None:
            assert r.w == re.findall(r"\w+", t.lower())
            assert r.m == " ".join(unicodedata.normalize("NFC", t).lower().split())


def test_nfc_predicate(spark):
    r = texts(spark, ["é", "é", "e", None]).select(X.is_nfc("t").alias("c"), X.clean_text(F.concat("t", F.lit("\b"))).alias("x")).collect()
    assert [x.c for x in r] == [False, True, True, None]
    assert r[0].x == "é"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("TS. Nguyen came. He left.", ["TS. Nguyen came.", "He left."]),
        ("See a.com now. Cost 1.5 on 1.10.2019. Ok", ["See a.com now.", "Cost 1.5 on 1.10.2019.", "Ok"]),
        ("Well... no. Well... Yes", ["Well... no.", "Well...", "Yes"]),
        ("Wait...\nno", ["Wait... no"]),
        ("He said “go.” Then left", ["He said “go.”", "Then left"]),
        ("one\n\ntwo", ["one", "two"]),
        ("No mark", ["No mark"]),
        ("   ", []),
        (None, []),
        ("A.B stays. (Then)", ["A.B stays.", "(Then)"]),
        ("Fin. Ça va", ["Fin.", "Ça va"]),
    ],
)
def test_sentences(spark, text, expected):
    assert texts(spark, [text]).select(split_sentences("t").alias("s")).first().s == expected


def test_first_sentences_are_those_of_the_whole_text(spark):
    """Wherever a head ends, the sentences it is asked for are those that the whole text has."""
    rng = random.Random(5)
    parts = ["Ab", "cd", "TP.", "TS. ", "... ", "\u2026", ". ", ".\u2003", "! ", '."', " ", "   ", "\n", "\n\n", "\t", "\u00c0", "7", "(", "\u201c", "\x1c", "\u0001", "\u0002", "\U0001f600", "."]
    given = ["", " ", " \n ", None, *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(600))]
    rows = texts(spark, given)
    got = rows.select("t", *[first_sentences("t", n, head).alias(f"s{n}_{head}") for n in (1, 3) for head in (3, 9, 25)], F.slice(split_sentences("t"), 1, 1).alias("w1"), F.slice(split_sentences("t"), 1, 3).alias("w3")).collect()
    assert len(got) == len(given) and all(r[f"s{n}_{head}"] == r[f"w{n}"] for r in got for n in (1, 3) for head in (3, 9, 25))


def test_has_words_and_strip_know_all_white_space(spark):
    given = [None, "", " ", "a", " a\u2003b", "a\x1cb\x85c \u3000d", "a b c d e", "\ufeffa", "\u180ea b", *(chr(k) + "x" + chr(k) + "y" for k in range(0x3002) if not 0xD800 <= k < 0xE000)]
    got = texts(spark, given).select("t", X.has_words("t", 2).alias("two"), X.has_words("t", 4).alias("four"), X.word_count("t").alias("n"), X.pstrip("t").alias("p")).collect()
    for r in got:
        n = len((r.t or "").split())
        assert (r.two, r.four, r.n) == (n >= 2, n >= 4, n) and r.p == (None if r.t is None else r.t.strip())


def test_rouge_counts_grams_within_the_row(spark):
    """Clipped overlap of any multisets, without a shuffle; rows that share their keys are still told apart."""
    from collections import Counter

    rng = random.Random(3)
    words = lambda: rng.choice([None, [], [rng.choice("abcd") for _ in range(rng.randint(0, 14))]] + [[rng.choice("ab") for _ in range(rng.randint(0, 9))]] * 3)
    given = [(k // 2, words(), words()) for k in range(300)]
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(given)], "at int, k int, p array<string>, r array<string>").coalesce(1)
    found = M.rouge_ns(rows, ["at", "k"], "p", "r", [1, 2, 3])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    for x in found.collect():
        _, p, r = given[x.at]
        for n in (1, 2, 3):
            of = lambda t: Counter(zip(*((t or [])[k:] for k in range(n)), strict=False))  # noqa: B023, E731
            o, a, b = sum((of(p) & of(r)).values()), sum(of(p).values()), sum(of(r).values())
            assert (x[f"precision_{n}"], x[f"recall_{n}"]) == (o / a if a else 0, o / b if b else 0)
            assert x[f"f1_{n}"] == pytest.approx(2 * o / (a + b) if a + b else 0)


def test_spearman_sets_find_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x * x % 17.0

    given = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.udf(counted, "double")(F.col("id").cast("double")).alias("x"), (F.col("id") % 7).alias("y"))
    assert sorted((r.scope, r.n) for r in S.spearman_sets(given, "x", "y", "g").collect()) == [("a", 20), ("all", 40), ("b", 20)]
    assert seen.value == 40



def test_lead_of_blank_is_the_text(spark):
    assert [r[0] for r in texts(spark, ["  ", "A b. C d. E."]).orderBy("k").select(lead("t", 2)).collect()] == ["  ", "A b. C d."]


def test_lcs_forms_agree(spark):
    rng = random.Random(3)
    some = lambda letters, most: [rng.choice(letters) for _ in range(rng.randint(0, most))]
    rows = [(some("abcd", 12), some("abcd", 12)) for _ in range(60)] + [(some("abcdefg", 300), some("abcdefgh", 300)) for _ in range(60)]
    rows += [([rng.choice("ab") for _ in range(m)], [rng.choice("ab") for _ in range(n)]) for m in (61, 62, 63, 124, 125, 186) for n in (62, 63, 190)]
    rows += [(["x", *x], x) for x in (["a"] * 70, ["a", "b"] * 40)] + [(["a"] * 700 + ["b"], ["c"] + ["a"] * 650 + ["d"])]

    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", M.lcs_length("a", "b").alias("n")).collect():
        assert r.n == table(r.a, r.b)
    odd = spark.createDataFrame([(None, ["a"]), (["a"], None), (None, None), ([], [])], df.schema)
    assert [r[0] for r in odd.select(M.lcs_length("a", "b")).collect()] == [0] * 4
    plan = df.select(M.lcs_length("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_rouge_of_short_and_empty_sides(spark):
    df = spark.createDataFrame([(1, ["a"], ["a"]), (2, [], ["a"]), (3, ["a", "b", "a", "b"], ["a", "b"])], "k int, p array<string>, r array<string>")
    got = {r.k: (r.precision, r.recall) for r in M.rouge_n(df, ["k"], "p", "r", 2).collect()}
    assert got == {1: (0.0, 0.0), 2: (0.0, 0.0), 3: (pytest.approx(1 / 3), 1.0)}


def test_banned(spark):
    df = spark.createDataFrame([([2, 5, 6, 7, 5, 6],), ([2],), ([],)], "h array<int>")
    assert [r[0] for r in df.select(M.banned_next("h", 3)).collect()] == [[7], [], []]
    assert df.select(M.banned_next("h", 0)).first()[0] == []


def test_closed_forms(spark):
    same = spark.createDataFrame([(k, k) for k in range(1, 6)], "a int, b int")
    assert S.weighted_kappa(same, "a", "b").first().kappa == 1.0
    one = spark.createDataFrame([(2, 2), (2, 2)], "a int, b int")
    assert S.weighted_kappa(one, "a", "b").first().kappa == 1.0
    assert one.agg(S.pearson("a", "b")).first()[0] is None
    assert S.spearman(one, "a", "b").first().rho is None
    low, high = spark.range(1).select(*S.wilson(F.lit(25.0), F.lit(100.0))).first()
    assert low < 0.25 < high
    assert spark.range(1).select(*S.wilson(F.lit(0.0), F.lit(0.0))).first()[0] is None
    gaps = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "d double")
    r = S.paired_bootstrap(gaps, "d", [], 200, "x").first()
    assert (r.difference, r.low, r.high, r.p_greater) == (1.0, 1.0, 1.0, 1.0)


def test_verdict_coercion(spark):
    df = spark.createDataFrame([(1, '{"s": "4", "m": "false", "e": "none"}'), (2, '{"s": true, "m": 3, "e": ["x"]}'), (3, '{"s": 6, "e": ["Wrong Entity","wrong-entity","none"]}')], "k int, j string")
    get = lambda p: F.get_json_object("j", f"$.{p}")
    r = {x.k: x for x in df.select("k", W.ordinal(get("s"), W.kind_of(F.col("j"), "$.s")).alias("s"), W.boolean(get("m")).alias("m"), W.error_list(W.string_list(get("e"), W.kind_of(F.col("j"), "$.e")), F.lit(True)).alias("e")).collect()}
    assert (r[1].s, r[1].m, r[1].e) == (4, False, ["none"])
    assert (r[2].s, r[2].m, r[2].e) == (None, None, None)
    assert (r[3].s, r[3].e) == (None, ["wrong_entity"])
    words = spark.createDataFrame([("5",), ("0.9",), ("high",), ("1",), ("0",), ("7",)], "c string")
    assert [x[0] for x in words.select(W.confidence(F.col("c"))).collect()] == [5, 5, 4, 1, 1, None]


def test_strip_is_linear(spark):
    import time

    text = "x" + " " * (1 << 20) + "y" + " " * (1 << 20)
    began = time.perf_counter()
    assert spark.createDataFrame([(text,)], "t string").select(F.length(X.pstrip("t")).alias("n")).first().n == 2 + (1 << 20)
    assert time.perf_counter() - began < 5


def test_binomial_draws(spark):
    from math import comb

    for n, p in ((7, 0.3), (60, 0.02), (300, 0.7), (5000, 0.4)):
        chance = lambda t, salt: D.uniform("id", t, F.lit(salt))
        seen = [r.k for r in spark.range(20_000).select(D.binomial(F.lit(n), F.lit(p), chance).alias("k")).collect()]
        cells = [(seen.count(k), 20_000 * q) for k in range(n + 1) if 20_000 * (q := comb(n, k) * p**k * (1 - p) ** (n - k) if n < 1000 else statistics.NormalDist(n * p, (n * p * (1 - p)) ** 0.5).cdf(k + 0.5) - statistics.NormalDist(n * p, (n * p * (1 - p)) ** 0.5).cdf(k - 0.5)) > 8]
        assert min(seen) >= 0 and max(seen) <= n
        assert sum((o - e) ** 2 / e for o, e in cells) < len(cells) + 5 * (2 * len(cells)) ** 0.5 + (len(cells) * 0.2 if n == 5000 else 0)


def test_bootstrap_is_the_plain_one(spark):
    """Means, intervals and shares of multinomial resamples against drawing rows with replacement."""
    rng = random.Random(4)
    rows = [("a", rng.choice([-1.0, 0.0, 0.5, 2.0])) for _ in range(400)] + [("b", rng.gauss(1, 3)) for _ in range(90)] + [("c", 3.0)] * 5 + [("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for cell in (256, 16):  # many distinct values lie in cells
        means = S.bootstrap_means(df, "x", ["g"], 2000, "s", cell)
        by = {r.g: (r.low, r.high) for r in S.interval(means, ["g"]).collect()}
        assert set(by) == {"a", "b", "c"} and by["c"] == (3.0, 3.0) and means.count() == 6000
        for g in "ab":
            own = [x for k, x in rows if k == g]
            drawn = sorted(statistics.fmean(rng.choices(own, k=len(own))) for _ in range(2000))
            wide = drawn[1949] - drawn[49]
            assert abs(by[g][0] - drawn[49]) < 0.1 * wide and abs(by[g][1] - drawn[1949]) < 0.1 * wide
            got = [r.mean for r in means.where(F.col("g") == g).collect()]
            assert abs(statistics.stdev(got) / statistics.stdev(drawn) - 1) < 0.08 and abs(statistics.fmean(got) - statistics.fmean(own)) < 0.05 * wide
    again = {(r.g, r.b, r.mean) for r in S.bootstrap_means(df.repartition(5), "x", ["g"], 50, "s").collect()}
    assert again == {(r.g, r.b, r.mean) for r in S.bootstrap_means(df, "x", ["g"], 50, "s").collect()}
    out = S.paired_bootstrap(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double"), "x", [], 200, "p").first()
    assert (out.n, out.difference, out.low, out.high, out.p_greater) == (3, 1.0, 1.0, 1.0, 1.0)


CANDIDATE = {"faithfulness": "4", "informativeness": 3, "fluency": 5.0, "conciseness": 2, "major_error": "false", "error_types": "none", "evidence": " e ", "reason": "r"}
REFERENCE = {"label": "unsupported", "unsupported_claims": "", "evidence": "e", "confidence": "5", "reason": "r"}


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, {"faithfulness": 4, "fluency": 5, "major_error": False, "error_types": ["none"], "evidence": "e"}),
        ({"error_types": ["Wrong Entity", "wrong-entity", "none"], "major_error": True}, {"error_types": ["wrong_entity"]}),
        ({"error_types": []}, {"error_types": ["none"]}),
        ({"error_types": [" "], "major_error": True}, {"error_types": ["other"]}),
        ({"error_types": ["wrong number date", "incoherence", "verbosity"]}, {"error_types": ["wrong_number_date", "incoherence", "verbosity"]}),
        ({"error_types": ["grammar"]}, "error_types"),
        ({"error_types": ["omission", 3]}, "error_types"),
        ({"error_types": 3}, "error_types"),
        ({"faithfulness": 6}, "faithfulness"),
        ({"fluency": True}, "fluency"),
        ({"conciseness": "2.5"}, "conciseness"),
        ({"major_error": 1}, "major_error"),
        ({"evidence": "w " * 61}, "evidence"),
        ({"reason": None}, "reason"),
        ({"more": 1}, "schema mismatch"),
    ],
)
def test_candidate_verdicts(spark, change, expected):
    got = spark.createDataFrame([(json.dumps(CANDIDATE | change),)], "b string").select(W.candidate_verdict(F.col("b")).alias("v")).first().v.asDict()
    if isinstance(expected, str):
        assert got["problem"] == expected and {v for k, v in got.items() if k != "problem"} == {None}
    else:
        assert got["problem"] is None and got | expected == got


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, {"label": "unsupported", "unsupported_claims": [], "confidence": 5}),
        ({"confidence": 0.9, "unsupported_claims": [" a", "b "]}, {"confidence": 5, "unsupported_claims": ["a", "b"]}),
        ({"confidence": " Very High"}, {"confidence": 5}),
        ({"confidence": "high"}, {"confidence": 4}),
        ({"confidence": 1}, {"confidence": 1}),
        ({"confidence": "very_high"}, "confidence"),
        ({"confidence": True}, "confidence"),
        ({"confidence": 7}, "confidence"),
        ({"label": "Unsupported"}, "label"),
        ({"unsupported_claims": list("abcdef")}, "unsupported_claims"),
        ({"reason": "w " * 61}, "reason"),
        ({"extra": 1}, "schema mismatch"),
    ],
)
def test_reference_verdicts(spark, change, expected):
    got = spark.createDataFrame([(json.dumps(REFERENCE | change),)], "b string").select(W.reference_verdict(F.col("b")).alias("v")).first().v.asDict()
    if isinstance(expected, str):
        assert got["problem"] == expected and got["label"] is None
    else:
        assert got["problem"] is None and got | expected == got


def test_verdicts_of_no_object(spark):
    for body in ("[1]", "no json", None):
        assert spark.createDataFrame([(body,)], "b string").select(W.reference_verdict(F.col("b")).alias("v")).first().v.problem == "not an object"


def test_small_text_functions(spark):
    rows = texts(spark).select("t", X.nfc_stripped("t").alias("s"), X.segmented("t").alias("a"), X.segmented("t", lambda c: F.split(c, " ")).alias("b")).collect()
    for r in rows:
        assert r.s == unicodedata.normalize("NFC", r.t or "").strip()
        if r.t is not None:
            assert r.a == re.findall(r"\w+", r.t.lower()) and r.b == [w for w in r.t.lower().split(" ") if re.search(r"[^\W]", w)]
    moment = spark.range(1).select(X.utc_stamp(F.lit("2026-01-31 12:00:00.5+02:00").cast("timestamp")).alias("s"), X.utc_stamp().alias("n")).first()
    assert moment.s == "2026-01-31T10:00:00.500000Z" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z", moment.n)
    settings = spark.createDataFrame([(1, 1.0, 3), (4, 1.1, 3), (4, 0.8, 0)], "b int, p double, n int").select(X.config_id("b", "p", "n").alias("c"))
    assert [r.c for r in settings.collect()] == ["greedy", "beam4_lp1.1_nr3", "beam4_lp0.8_nr0"]
    assert spark.range(1).select(X.without_prefixes(F.lit("module._orig_mod.module.w"))).first()[0] == "w"
    ids = spark.createDataFrame([("k", "test", 1), ("", "test", 2), (None, "dev", 3)], "id string, split string, line int")
    assert [r[0] for r in ids.select(X.sample_id("id", "split", "line")).collect()] == ["k", "test_2", "dev_3"]


def test_ngrams_find_their_tokens_once(spark):
    """A text is cut into tokens once, and no gram copies the array it comes from."""
    from corpusloom.plans import q_stats

    plan = q_stats.ngram_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "slice(" not in plan
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, []), (4, None)], "k int, t array<string>")
    got = {r.k: (r.g, r.j) for r in rows.select("k", M.ngrams("t", 2).alias("g"), M.joined_ngrams("t", 2).alias("j")).collect()}
    assert got == {1: ([["a", "b"], ["b", "a"]], ["a\x01b", "b\x01a"]), 2: ([], []), 3: ([], []), 4: ([], [])}


def test_nfc_goes_to_python_in_bounded_batches(spark):
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 28)}
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        X.clean_text("text")
        assert [spark.conf.get(n) for n in names] == ["500", str(8 << 20)]
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
