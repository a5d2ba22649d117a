import bisect
import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import curate, decoding, dedup, ranges, resume, sampling, segmentation, sequences, study, validate
from corpusloom.plans import q_stats, q_study
from corpusloom.sources import append_log, checksums, jsonl, lines, tables
from corpusloom.streaming import incremental


def test_place_is_a_permutation_for_any_partitioning(spark):
    rows = spark.range(100).withColumn("v", F.pmod(F.col("id") * 37, F.lit(10)))
    got = [{r.id: r.place for r in sampling.place(rows.repartition(n), [F.col("v"), F.col("id")]).collect()} for n in (1, 7)]
    assert got[0] == got[1] and sorted(got[0].values()) == list(range(100))
    assert sampling.place(spark.range(0), [F.col("id")]).count() == 0


def test_numbers_in_groups(spark):
    rows = [(k, None if k % 7 == 0 else "hot" if k % 3 else f"g{k % 5}", k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, h int").repartition(5)
    got = {r.id: r.nth for r in sampling.numbered(df, ["g", "h"], "id").collect()}
    groups: dict = {}
    for k, *group in rows:
        groups.setdefault(tuple(group), []).append(k)
    assert got == {k: n for ids in groups.values() for n, k in enumerate(sorted(ids), 1)}
    assert sampling.numbered(df.limit(0), "g", "id").isEmpty()


def test_scan_of_lines_by_user(spark):
    sf = "/root/testdata/sf0.001"
    events: dict = {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "props").collect()):
        events.setdefault(r.user_id, []).append(json.loads(r.props)["k"])
    wanted = sorted((u, n, k) for u, ks in events.items() for n, k in enumerate(ks, 1))
    assert sorted(map(tuple, q_study.jsonl_scan(spark, sf).collect())) == wanted


def test_strata_and_nested_samples(spark):
    s = sampling.rank_strata(spark.range(40), 4, [F.col("id")])
    assert {r.stratum: r["count"] for r in s.groupBy("stratum").count().collect()} == {1: 10, 2: 10, 3: 10, 4: 10}
    small, large = ({r.id for r in sampling.sample_strata(s, "stratum", "id", k, "s", "n").collect()} for k in (3, 6))
    assert len(small) == 12 and small < large


def test_blind_labels_are_bijective(spark):
    got = sampling.blind_labels(spark.range(9).select(F.col("id").alias("sample_id")), ["p", "q", "r", "s"], "x").collect()
    for k in range(9):
        assert sorted(r.anon_id for r in got if r.sample_id == k) == list("ABCD")


def test_blocks_keep_their_distance():
    blocks = study.arrange_blocks([str(k) for k in range(50)], [str(k) for k in range(0, 50, 5)], 15)
    assert len(blocks) == 60
    for s in {x for x, again in blocks if again}:
        assert blocks.index((s, True)) - blocks.index((s, False)) >= 15
    with pytest.raises(ValueError):
        study.arrange_blocks(["a", "b"], ["a"], 15)


def test_unblind_fails_on_unknown(spark):
    records = spark.createDataFrame([(1, "A"), (2, "Z")], "sample_id int, anon_id string")
    mapping = spark.createDataFrame([(1, "A", "p")], "sample_id int, anon_id string, system string")
    with pytest.raises(Exception, match="no system"):
        study.unblind(records, mapping).collect()


def test_curation_boundaries(spark):
    pair = lambda s, t: (" ".join(["w"] * s), " ".join(["v"] * t))
    rows = [pair(99, 20), pair(100, 10), pair(1200, 150), pair(1201, 100), pair(200, 9), (None, "x"), ("  ", "x")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, source string, target string")
    assert {r.k for r in curate.curate(df, "k").collect()} == {1, 2}


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", "c")], "k int, x string, y string")
    assert {r.k for r in dedup.keep_first(df, ["x", "y"], "k").collect()} == {1, 2}


def test_ranges(spark):
    rows = spark.range(1000)
    cuts = ranges.splits_of(rows, "id", 4)
    got = rows.select("id", ranges.bucket_of("id", cuts).alias("b")).collect()
    assert all(r.b == sum(c <= r.id for c in cuts) for r in got)
    assert spark.sql("select cast(null as bigint) k").select(ranges.bucket_of("k", cuts)).first()[0] == len(cuts)


def test_sequences(spark):
    df = spark.createDataFrame([(1, [5] * 768, [6] * 95), (2, [5], [6] * 96), (3, [], [])], "k int, source array<int>, target array<int>")
    got = {r.k: r for r in sequences.samples(df, ["k"]).collect()}
    assert set(got) == {1, 3} and got[1].was_source_truncated and got[1].source_len == 768 and got[3].labels == [3] and got[3].decoder_input_ids == [2]
    assert spark.sql("select array(2, 5, 1, 0, 3, 9) x").select(sequences.without_specials("x")).first()[0] == [5, 1]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"k": 1}\n\n{"k": 2}\r\n{"k": 3', encoding="utf-8")
    at = str(tmp_path / "a.jsonl")
    assert [r.k for r in jsonl.read_jsonl(spark, at, "k int", torn_tail=True).orderBy("line").collect()] == [1, 2]
    with pytest.raises(Exception, match="line 4"):
        jsonl.read_jsonl(spark, at, "k int").collect()
    assert [(r.line, r.issue) for r in jsonl.read_issues(spark, at).orderBy("line").collect()] == [(2, "BLANK_LINE"), (4, "INVALID_JSON")]
    df = spark.createDataFrame([(1, "x y"), (2, None)], "k int, t string")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert jsonl.verified(df, str(tmp_path / "out")).count() == 0
    jsonl.write_document(df, str(tmp_path / "doc.json"))
    text = (tmp_path / "doc.json").read_text()
    assert json.loads(text) == [{"k": 1, "t": "x\u2028y"}, {"k": 2, "t": None}] and text.endswith("]\n")
    with pytest.raises(Exception, match="exists"):
        jsonl.write_document(df, str(tmp_path / "doc.json"))
    (tmp_path / "none.jsonl").write_text("\n\n")
    assert jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), "k int").isEmpty()
    with pytest.raises(ValueError, match="no rows"):
        jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), "k int", non_empty=True)


def test_tables_and_checksums(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'q"x')], "Contents string, Summary string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).collect() == df.collect()
    assert len(tables.discover(spark, str(tmp_path), "part-*.csv")) == 1
    (tmp_path / "f.txt").write_text("hi")
    found = checksums.file_digests(spark, str(tmp_path / "f.txt"))
    (tmp_path / "sums").write_text(f"{found.first().digest}  f.txt\n{'0' * 64}  g.txt\nnote\n")
    got = {r.name: r.status for r in checksums.verify(checksums.read_manifest(spark, str(tmp_path / "sums")), found).collect()}
    assert got == {"f.txt": "ok", "g.txt": "missing"}
    with pytest.raises(ValueError):
        tables.resolve_options({"beams": 4}, {"beam": 2})
    assert tables.resolve_options({"beams": 4, "alpha": 1.0}, {"beams": None}, {"beams": 2}) == {"beams": 2, "alpha": 1.0}
    pairs = lines.pair_lines(spark.createDataFrame([(1, "a\n\nb\nc")], "k int, t string"), "k", "t").collect()
    assert [(r.pair, r.source, r.target) for r in pairs] == [(0, "a", "b")]


def test_configurations_vocabularies_and_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 1, "study": {"seed": 3}}')
    (tmp_path / "a.yaml").write_text("version: 1\nstudy:\n  seed: 3\n")
    for name in ("a.json", "a.yaml"):
        assert tables.load_config(str(tmp_path / name), 1, ("study",))["study"] == {"seed": 3}
        with pytest.raises(ValueError, match="version 1 is not 2"):
            tables.load_config(str(tmp_path / name), 2)
        with pytest.raises(ValueError, match="no rates"):
            tables.load_config(str(tmp_path / name), 1, ("study", "rates"))
    (tmp_path / "v.tsv").write_text('<unk>\t0\n▁"a\t-1.5\n', encoding="utf-8")
    assert sorted(map(tuple, lines.read_vocabulary(spark, str(tmp_path / "v.tsv")).collect())) == [("<unk>", 0.0), ('▁"a', -1.5)]
    pairs = spark.createDataFrame([(k, f"s{k}\r\nx", f"t{k}") for k in (3, 1, 2)], "k int, source string, target string")
    lines.write_interleaved(pairs, str(tmp_path / "corpus"), "k")
    written = "".join(f.read_text() for f in sorted((tmp_path / "corpus").glob("part-*")))
    assert written == "s1 x\nt1\ns2 x\nt2\ns3 x\nt3\n"
    expected = spark.createDataFrame([("v.tsv",), ("w.tsv",)], "name string")
    got = checksums.manifest(expected, checksums.file_digests(spark, str(tmp_path), "*.tsv")).collect()
    assert {r.name: (r.status, r.digest) for r in got} == {"v.tsv": ("ok", hashlib.sha256((tmp_path / "v.tsv").read_bytes()).hexdigest()), "w.tsv": ("missing", None)}


def test_windowed_counts_of_a_stream(spark, tmp_path):
    at, out = tmp_path / "events", str(tmp_path / "out")
    rows = [("2026-01-01 00:10:00", "a"), ("2026-01-01 00:50:00", "a"), ("2026-01-01 00:59:59", "b"), ("2026-01-01 01:00:00", "a")]
    spark.createDataFrame(rows, "t string, k string").selectExpr("t::timestamp t", "k").write.parquet(str(at))
    counts = incremental.windowed_counts(spark.readStream.schema("t timestamp, k string").parquet(str(at)), "t", "k")
    counts.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    got = spark.sql("select hour(window.start) h, k, n from windowed").collect()
    assert sorted(map(tuple, got)) == [(0, "a", 2), (0, "b", 1), (1, "a", 1)]


def test_keys_of_a_log(spark):
    tasks, log = spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), spark.createDataFrame([("a",), ("x",)], "key string")
    assert sorted(r.key for r in resume.pending(tasks, log, strict=True).collect()) == ["b", "c"]
    for odd, message in (("a", "repeated key in the log: a"), (" ", "empty key"), (None, "empty key")):
        more = log.union(spark.createDataFrame([(odd,)], "key string"))
        assert resume.pending(tasks, more).count() == 2
        with pytest.raises(Exception, match=message):
            resume.pending(tasks, more, strict=True).collect()


def test_mismatches_by_field(spark):
    schema = "id int, t string, n double"
    a = spark.createDataFrame([(1, "x", 1.0), (2, None, None), (3, "y", 2.0), (4, "only here", 0.0)], schema)
    b = spark.createDataFrame([(1, "x", 1.5), (2, None, None), (3, None, 3.0), (5, "only there", 0.0)], schema)
    assert sorted(map(tuple, validate.mismatches(a, b, "id", ["t", "n"]).collect())) == [(1, "n"), (3, "n"), (3, "t")]
    assert validate.mismatches(a.limit(0), b, "id", ["t"]).isEmpty()


def half(row):
    if row["n"] % 2:
        raise ValueError("odd")
    if row["n"] == 4:
        raise RuntimeError("fatal")
    return str(row["n"] // 2)


def test_row_errors_and_resume(spark, tmp_path):
    from corpusloom.runtime import ship

    rows = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "key string, n int")
    got = {r.key: (r.value, r.error, r.attempts) for r in resume.call_rows(rows, half, 3).collect()}
    assert got == {"a": ("1", None, 1), "b": (None, "odd", 3), "c": (None, "RuntimeError: fatal", 1)}
    ship(spark)
    tasks, out = tmp_path / "tasks", str(tmp_path / "out")
    tasks.mkdir()
    stream = lambda: spark.readStream.schema("key string, n int").json(str(tasks))
    put = lambda name, *rows: (tasks / name).write_text("\n".join(json.dumps({"key": k, "n": n}) for k, n in rows))
    put("1.json", ("a", 2), ("a", 2), ("b", 3))
    assert incremental.run_tasks(spark, stream(), out, half) == {"requested": 3, "skipped": 1, "success": 1, "failed": 1}
    assert incremental.run_tasks(spark, stream(), out, half) == {"requested": 0, "skipped": 0, "success": 0, "failed": 0}
    put("2.json", ("a", 2), ("d", 8), ("b", 3), ("b", 6), ("c", 4), (None, 10))
    assert incremental.run_tasks(spark, stream(), out, half) == {"requested": 6, "skipped": 1, "success": 3, "failed": 2}
    held = lambda name, *c: Counter(tuple(r[x] for x in c) for r in incremental.log(spark, out, name).collect())
    assert held("scores", "key", "value") == held("raw", "key", "value") == Counter([("a", "1"), ("d", "4"), ("b", "3"), (None, "5")])
    assert held("errors", "key", "error", "attempts") == Counter({("b", "odd", 3): 2, ("c", "RuntimeError: fatal", 1): 1})
    assert "raw" in incremental.log(spark, out, "raw").columns and "raw" not in incremental.log(spark, out, "scores").columns


def test_a_batch_that_is_run_again_replaces_what_it_wrote(spark, tmp_path):
    """A run that breaks between its logs is taken up without a row lost or twice."""
    tasks, out = tmp_path / "tasks", str(tmp_path / "out")
    spark.createDataFrame([(f"k{i}", 2 * i) for i in range(3, 9)], "key string, n int").write.parquet(str(tasks))
    stream = lambda: spark.readStream.schema("key string, n int").parquet(str(tasks))
    incremental.LOGS["broken/\0"] = "failed"
    try:
        with pytest.raises(Exception):  # noqa: B017, PT011
            incremental.start_tasks(spark, stream(), out, half).awaitTermination()
    finally:
        del incremental.LOGS["broken/\0"]
    assert incremental.run_tasks(spark, stream(), out, half)["success"] in (0, 6)  # the counters of the broken batch are replaced
    assert sorted(r.key for r in incremental.log(spark, out, "scores").collect()) == [f"k{i}" for i in range(3, 9)]
    assert incremental.counters(spark, out) == {"requested": 6, "skipped": 0, "success": 6, "failed": 0}


def cuts(tokens, compounds):
    """Every cut of the tokens, with its worth and its number of pieces."""
    if not tokens:
        yield 0.0, 0, ()
    for k in range(1, len(tokens) + 1):
        if k == 1 or " ".join(tokens[:k]) in compounds:
            for worth, n, rest in cuts(tokens[k:], compounds):
                yield worth + (compounds[" ".join(tokens[:k])] if k > 1 else 0.0), n + 1, ("_".join(tokens[:k]), *rest)


def test_segmentation_is_the_best_of_all_cuts(spark):
    rng = np.random.default_rng(6)
    compounds = {"a b": 2.0, "b c": 3.0, "a b c": 4.5, "c a b d": 4.0, "d d": -1.0, "c d": 0.0, "b d": 2.0}
    own = segmentation.Lexicon([*compounds.items()])
    texts = [[], ["a"], ["z", "a"], *([*rng.choice(list("abcdz"), rng.integers(1, 11))] for _ in range(300))]
    for t in texts:
        t = [str(x) for x in t]
        every = [*cuts(t, compounds)]
        worth, n, _ = max(every, key=lambda c: (c[0], -c[1]))
        got = own.cut(t)
        assert "_".join(got).split("_") == t if t else got == []
        assert any((w, k, c) == (worth, n, tuple(got)) for w, k, c in every)
    assert own.cut("a b c".split()) == ["a_b_c"] and own.cut("d d".split()) == ["d", "d"] and own.cut("c d".split()) == ["c_d"]
    lexicon = spark.createDataFrame([*compounds.items()], "compound string, worth double")
    rows = spark.createDataFrame([(1, ["b", "c", "x"], "e"), (2, None, "e"), (3, [], None)], "k int, t array<string>, segment string")
    assert {r.k: r.segments for r in segmentation.segment(rows, "t", lexicon).collect()} == {1: ["b_c", "x"], 2: None, 3: []}
    with pytest.raises(ValueError, match="3 compounds"):
        segmentation.segment(rows, "t", lexicon, most=3)
    assert segmentation.segment(rows.limit(0), "t", lexicon.limit(0)).count() == 0


def test_compounds_are_what_follows_more_often_than_chance(spark):
    rng = np.random.default_rng(8)
    texts = [[str(x) for x in rng.choice(list("abcdefgh"), 30)] + ["new", "york"] * (k % 3) + ["san", "jose", "city"] * (k % 2) for k in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t array<string>")
    got = {r.compound: (r.n, r.worth) for r in segmentation.compounds(rows, "t", 50, least=5, apart=2.0).collect()}
    runs, total = Counter(), sum(map(len, texts))
    for t in texts:
        runs.update(" ".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))
    want = {}
    for run, n in runs.items():
        parts = run.split(" ")
        if n >= 5 and len(parts) > 1:
            worth = round(float(np.log(n) - sum(np.log(runs[p]) for p in parts) + (len(parts) - 1) * np.log(total)), 6)
            if worth >= 2:
                want[run] = (n, worth)
    assert len(want) <= 50 and got.keys() == want.keys() and all(abs(got[k][1] - want[k][1]) < 1e-5 and got[k][0] == want[k][0] for k in want)
    assert {"new york", "san jose", "jose city", "san jose city"} <= got.keys()
    few = [r.compound for r in segmentation.compounds(rows, "t", 2, least=5, apart=2.0).collect()]
    assert sorted(few) == sorted(sorted(want, key=lambda c: (-want[c][0], c))[:2])


def test_documents_are_cut_by_their_own_compounds(spark):
    from corpusloom.plans import q_text

    rows = q_text.word_segments(spark, "/root/testdata/sf0.001").collect()
    own = {r.doc_id: r.t for r in q_text.docs(spark, "/root/testdata/sf0.001").select("doc_id", X.tokens("text").alias("t")).collect()}
    assert len(rows) == len(own) and sum(r.n_segments < r.n_tokens for r in rows) > 20
    for r in rows:
        assert r.segmented.replace("_", " ").split() == " ".join(own[r.doc_id]).replace("_", " ").split() and r.n_tokens == len(own[r.doc_id])


def test_cuts_of_equal_worth_are_the_same_wherever_they_stand():
    compounds = {"x x": 3.1, "x x x": 4.7, "a b": 0.1, "b a": 0.2, "a b a": 0.3}
    own = segmentation.Lexicon([*compounds.items()])
    for t in [["x"] * n for n in range(40)] + [list("ab" * n) for n in range(20)]:
        # from each end, worth in millionths, pieces and the last piece's length
        best = [(0, 0, 0)]
        for end in range(1, len(t) + 1):
            steps = [k for k in range(1, min(end, 3) + 1) if k == 1 or " ".join(t[end - k : end]) in compounds]
            best.append(max((best[end - k][0] + (round(1e6 * compounds[" ".join(t[end - k : end])]) if k > 1 else 0), best[end - k][1] - 1, k) for k in steps))
        want, end = [], len(t)
        while end:
            want, end = ["_".join(t[end - best[end][2] : end]), *want], end - best[end][2]
        assert own.cut(t) == want


@pytest.mark.parametrize("few", [1, 3, 24, 1 << 30])
def test_many_rows_are_cut_as_one_by_one(few, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(segmentation, "FEW", few)
    rng = np.random.default_rng(few % 97)
    for _ in range(60):
        compounds = {" ".join(rng.choice([*"abcdz", "x_y", "é"], rng.integers(1, 5))): float(rng.integers(-3, 9)) / 10 for _ in range(rng.integers(0, 12))}
        texts = [None if rng.random() < 0.1 else " ".join(rng.choice([*"abcdz", "x_y", "é"], rng.integers(0, 40))) for _ in range(rng.integers(2, 40))]
        one, many = segmentation.Lexicon([*compounds.items()]), segmentation.Cutter([*compounds.items()])
        got = list(zip(*[x.to_pylist() for x in many.cut(pa.array(texts, pa.string()).slice(1))], strict=True))
        for t, row in zip(texts[1:], got, strict=True):
            tokens = (t or "").split()
            cut = one.cut(tokens)
            assert row == ((None,) * 4 if t is None else (" ".join(cut), len(tokens), len(cut), sum("_" in x for x in cut)))


def test_compounds_by_numbers_are_those_by_strings(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = [None, "", "a"] + [" ".join([*rng.choice([*"abcdefghijklmnop"], 40), *["new", "york"] * (k % 3 > 0), *["san", "jose", "city"] * (k % 9 == 0), "é_x", "y"]) for k in range(90)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(3)
    arrays = rows.select(F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", " ")).alias("t"))
    calls, common = [], segmentation._common_runs
    monkeypatch.setattr(segmentation, "_common_runs", lambda given, counts, total, floor, *a: calls.append(floor) or common(given, counts, total, floor, *a))
    monkeypatch.setattr(segmentation, "SUMMED", 400)
    every = lambda r, most, **b: sorted(tuple(x) for x in segmentation.compounds(r, "t", most, apart=2.0, **b).collect())
    lowered = 0
    for most, longest in ((1, 3), (9, 2), (500, 4)):
        calls.clear()
        got = every(rows, most, longest=longest)
        floors = [*calls]
        assert got == every(arrays, most, longest=longest) and len(got) <= most
        want = every(rows.where("t is not null"), most, longest=longest, held=0)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
        assert floors[-1] == 5 or len(got) == most
        lowered += len(floors) > 1
    assert lowered
    assert every(rows, 9, longest=1) == [] == every(rows.limit(0), 9)


def test_token_text_holds_the_tokens(spark):
    texts = ["", " ", "a", "A  b\n--c_d 1½ é\u0301x İ ΑΣ. 漢字 ٣٤ \U0001d400 \u00a0\u2003z", "--", "\tX", None, "\x00a\x00"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.tokens("t").alias("a"), X.token_text("t").alias("b")).collect()
    assert [None if r.a is None else " ".join(r.a) for r in rows] == [r.b for r in rows]


LOG = b'\xef\xbb\xbf{"k":1}\r\n{"k":2}\n\n{"k":"\xc3\xa9"}\n{"k":4'


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_logs_by_ranges_of_bytes(spark, tmp_path, size):
    (tmp_path / "a.jsonl").write_bytes(LOG)
    (tmp_path / "_b").write_bytes(b"hidden\n")
    (tmp_path / "c").write_bytes(b"")
    whole = [(0, '{"k":1}'), (12, '{"k":2}'), (20, ""), (21, '{"k":"é"}')]
    read = lambda torn: sorted((r.offset, r.text) for r in append_log.read_log(spark, str(tmp_path), torn, size).collect())
    assert read("drop") == whole and read("keep") == [*whole, (32, '{"k":4')]
    assert append_log.read_log(spark, str(tmp_path / "nowhere")).count() == 0
    parts = append_log.ranges(str(tmp_path / "a.jsonl"), 0, len(LOG), size)
    assert [x for p in parts for x in append_log.lines_in(str(tmp_path), p, step=5)] == [*append_log.lines_in(str(tmp_path), append_log.Range(parts[0].file, 0, len(LOG), len(LOG)))]


def test_a_stream_holds_back_a_torn_tail(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a").write_bytes(LOG)

    def run():
        stream = append_log.stream_log(spark, str(log), 5).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        stream.trigger(availableNow=True).start(str(tmp_path / "t")).awaitTermination()
        return sorted((r.file[-1], r.offset, r.text) for r in spark.read.schema(append_log.LINES).parquet(str(tmp_path / "t")).collect())

    first = [("a", 0, '{"k":1}'), ("a", 12, '{"k":2}'), ("a", 20, ""), ("a", 21, '{"k":"é"}')]
    assert run() == run() == first
    with (log / "a").open("ab") as f:
        f.write(b"}\n{")
    (log / "b").write_bytes(b'{"k":5}\n{"k"')
    assert run() == [*first, ("a", 32, '{"k":4}'), ("b", 0, '{"k":5}')]


def test_digests_of_files_of_any_size(spark, tmp_path):
    with (tmp_path / "large.bin").open("wb") as f:
        f.truncate((1 << 31) + 5)  # sparse, and beyond what one row of bytes can hold
    (tmp_path / "empty.bin").write_bytes(b"")
    want = hashlib.sha256()
    for _ in range(1 << 11):
        want.update(bytes(1 << 20))
    want.update(bytes(5))
    got = {r.name: r.digest for r in checksums.file_digests(spark, str(tmp_path), "*.bin").collect()}
    assert got == {"large.bin": want.hexdigest(), "empty.bin": hashlib.sha256().hexdigest()}
    expected = spark.createDataFrame([("large.bin", "0" * 64), ("empty.bin", got["empty.bin"]), ("gone.bin", "1" * 64)], "name string, expected string")
    found = checksums.file_digests(spark, str(tmp_path), "*.bin")
    assert {r.name: r.status for r in checksums.verify(expected, found).collect()} == {"large.bin": "mismatch", "empty.bin": "ok", "gone.bin": "missing"}


def test_bootstrap_queries(spark, monkeypatch):
    """2,000 resamples of registered queries against drawing rows with replacement."""
    values = {"lead1": [1, 3, 5, 2, 4] * 8, "neural": [2, 2, 5, 1, 3, 3, 3, 1] * 5}
    rows = [(i, s, v, 0, 0, 0, False) for s, xs in values.items() for i, v in enumerate(xs)]
    scores = spark.createDataFrame(rows, "sample_id long, system string, faithfulness int, informativeness int, fluency int, conciseness int, major_error boolean")
    monkeypatch.setattr(q_stats.V, "scores", lambda spark, d: scores)
    rng = np.random.default_rng(3)
    drawn = lambda x: rng.choice(np.array(x, float), (20_000, len(x))).mean(axis=1)
    for r in q_stats.bootstrap_ci(spark, "").collect():
        low, high = np.quantile(drawn(values[r.system]), [0.025, 0.975])
        assert abs(r.low - low) < 0.08 * (high - low) and abs(r.high - high) < 0.08 * (high - low)
    gaps = [a - b for a, b in zip(*values.values(), strict=True)]
    means = drawn(gaps)
    low, high = np.quantile(means, [0.025, 0.975])
    (got,) = q_stats.paired_systems(spark, "").where("field = 'faithfulness'").collect()
    own = q_stats.paired_bootstrap(spark, "").first()
    for r in (got, own):
        assert (r.n, r.difference) == (40, np.mean(gaps)) and abs(r.low - low) < 0.08 * (high - low) and abs(r.high - high) < 0.08 * (high - low)
        assert abs(r.p_greater - (means > 0).mean() - 0.5 * (means == 0).mean()) < 0.04
    assert got.pair == "lead1>neural" and got.better == "lead1"


def test_keys_share_the_state_of_their_bucket(spark, tmp_path):
    """State and calls into Python grow with buckets, not with keys, and every key is still told apart."""
    tasks, out = tmp_path / "tasks", str(tmp_path / "out")
    stream = lambda: spark.readStream.schema("key string, n int").parquet(str(tasks))
    rows = lambda upto: spark.range(upto).selectExpr("cast(id as string) as key", "cast(id as int) as n").union(spark.createDataFrame([(None, 3), ("", 2), ("=", 2)], "key string, n int"))
    for upto, want in ((1500, (1503, 0, 751, 752)), (1600, (1603, 751, 50, 802))):
        rows(upto).write.mode("append").parquet(str(tasks))
        before = incremental.counters(spark, out)
        query = incremental.start_tasks(spark, stream(), out, half)
        query.awaitTermination()
        after = incremental.counters(spark, out)
        assert tuple(after[c] - before[c] for c in incremental.COUNTERS) == want
        assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1024
    done = Counter(r.key for r in incremental.log(spark, out, "scores").collect())
    assert done == Counter([*(str(k) for k in range(0, 1600, 2) if k != 4), "", "="])


def test_priority_sample_keeps_all_warned(spark):
    long = " ".join(["word"] * 30)
    rows = [(k, "short text") for k in range(7)] + [(10, " " + long), (11, long + "\ufffd"), (12, "e\u0301 " + long)] + [(20 + k, long + " more" * k) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    warned = {*range(7), 10, 11, 12}
    got = {r.doc_id: r.priority for r in q_study.prioritized(df, 15).collect()}
    assert len(got) == 15 and {i for i, p in got.items() if p == 1} == warned and got[39] == 3
    assert {r.doc_id for r in q_study.prioritized(df, 10).collect()} == warned | {39}
    with pytest.raises(ValueError, match="10 rows are warned"):
        q_study.prioritized(df, 5)


def test_priority_sample_looks_at_a_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(t):
        seen.add(1)
        return t

    given = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" x ")), 15).alias("t"))
    texts = given.select("doc_id", F.concat(F.udf(counted, "string")("t"), F.lit("x")).alias("text"))
    assert q_study.prioritized(texts, 30).count() == 30
    assert seen.value == 60


def test_lines_of_many_splits(spark, tmp_path):
    rng = np.random.default_rng(1)
    bodies = {"a.jsonl": "".join(json.dumps({"k": int(k), "t": "x" * int(rng.integers(0, 60))}) + "\n" for k in range(3000)), "b.jsonl": "", "c.jsonl": '{"k": 1}\r\n{"k": 2}'}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = jsonl.numbered_lines(spark, str(tmp_path / "*.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, body in bodies.items():
        own = sorted((r.line, r.text, r.last, r.ended) for r in got if r.file.endswith(name))
        want = body.replace("\r\n", "\n").split("\n")
        ended, want = want[-1] == "", want[:-1] if want[-1] == "" else want
        assert own == [(k + 1, x, k + 1 == len(want), ended) for k, x in enumerate(want)]
    jsonl.rewrite(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "changed"), "k int", lambda df: df.withColumn("k", F.col("k") * 2))
    assert sorted(r.k for r in spark.read.schema("k int").json(str(tmp_path / "changed")).collect()) == [2, 4]
    with pytest.raises(ValueError):
        jsonl.rewrite(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "c.jsonl"), "k int", lambda df: df)


def test_manifest_assertions(spark):
    good = spark.createDataFrame([("a", "t", "x", "y"), ("b", "t", "x", "y")], "id string, split string, source string, reference string")
    assert validate.assert_manifest(good, 2).count() == 2 and validate.load_manifest(good, "id", 1).first().id == "a"
    for bad, said in ((good.union(good), "repeated ids: .'a', 'b'."), (good.withColumn("source", F.lit(" ")), "2 rows with empty source"), (good.drop("split"), "fields missing"), (good.withColumn("id", F.lit(None).cast("string")), "without id"), (good.limit(1), "1 rows, 2 expected")):
        with pytest.raises(ValueError, match=said):
            validate.assert_manifest(bad, 2)


def test_prediction_assertions(spark):
    shape = "id string, system string, prediction string, status string"
    wanted = spark.createDataFrame([("a",), ("b",)], "id string")
    good = spark.createDataFrame([("a", "s", "x", "ok"), ("b", "s2", "x", "ok")], shape)
    assert validate.assert_predictions(good, wanted, "s", ["s2"]).count() == 2
    for rows, said in (([("a", "s", "x", "ok")], "missing: ..b"), ([("a", "s", "", "ok"), ("b", "s", "x", "ok")], "errors: ..a"), ([("a", "s", "x", "ok")] * 2 + [("b", "s", "x", "ok"), ("c", "s", "x", "ok")], "repeated: ..a.., unknown: ..c")):
        with pytest.raises(ValueError, match=said):
            validate.assert_predictions(spark.createDataFrame(rows, shape), wanted, "s")
    with pytest.raises(ValueError, match="vocab_size"):
        validate.assert_ids({"pad": 0, "vocab_size": 2}, {"pad": 0, "vocab_size": 3})
    with pytest.raises(ValueError, match="prompt_version"):
        validate.assert_frozen({"model": "m", "prompt_version": 2}, {"model": "m", "prompt_version": 1})
    validate.assert_frozen({"model": "m"}, {"model": "m"})


def test_a_line_is_one_value_and_nothing_else(spark):
    """What follows a first value makes a line invalid, as in DuckDB's json_valid."""
    from tests.compare import duck

    texts = ["4537960215852590 The on", "1 2", "1, 2", "1] , [2", "1]", "1}", '1,"b":2', '{"a":1} x', '{"a":1}{"b":2}', '[1],"x":[2]', '"a" "b"', "{} }", "[1] ]", "{}\t", " {}", "null", "true", "01", '""', "{'a':1}"]
    texts += ['{"a":1,"a":2}', "NaN", '{"a":NaN}', r'"\ud800"', r'"\\ud800"', r'"\ud83d\ude00"', r'"\udc00"', "[[]]", " ", "", "1e400", "-0"]
    got = {r.line: r.issue for r in jsonl.judged(spark.createDataFrame(list(enumerate(texts)), "line int, text string")).collect()}
    con = duck("/root/testdata/sf0.001")
    sql = "select case when trim(x, ' ') = '' then 'BLANK_LINE' when not json_valid(x) then 'INVALID_JSON' when json_type(if(json_valid(x), x, 'null')) <> 'OBJECT' then 'NOT_JSON_OBJECT' end from (select ? as x)"
    for k, t in enumerate(texts):
        assert got[k] == con.execute(sql, [t]).fetchall()[0][0], t
    with pytest.raises(Exception, match="INVALID_JSON in line 1"):
        jsonl.scan(spark.createDataFrame([("f", 1, '{"k": 1} junk')], "file string, line long, text string"), "k long").collect()


def test_handoff(spark):
    row = lambda k, **more: json.dumps({"id": k, "system": "s", "config_id": "c", "prediction": "x", "status": "ok", "error": None} | more)
    manifest = spark.createDataFrame([("a",), ("b",)], "id string")
    judged = lambda *lines: validate.handoff(manifest, spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "line int, text string"), "s")
    assert judged(row("a"), row("b"))["valid_for_handoff"]
    bad = judged(row("a", status="error", error="e"), row("a", error="e", more=1), row("x", prediction=" ", config_id="d"), "[1]", row("b", status="odd", system="t"))
    assert (bad["output"], bad["success"], bad["failed"], bad["missing"], bad["extra"], bad["duplicate"]) == (5, 2, 1, 0, 2, 1) and not bad["valid_for_handoff"]
    assert bad["config_ids"] == ["c", "d"] and bad["issues"] == ["line 1: error in ok row", "line 1: extra field", "line 2: empty prediction", "line 3: empty config_id", "line 3: empty id", "line 3: no object", "line 3: wrong system", "line 4: unknown status", "line 4: wrong system"]


def test_strict_samples_and_merges(spark):
    with pytest.raises(ValueError, match="2 rows are over"):
        sampling.equal_strata(spark.range(42), 4, [F.col("id")])
    s = sampling.equal_strata(spark.range(40), 4, [F.col("id")])
    got = sampling.sample_exactly(s, "stratum", "id", {1: 3, 2: 0, 4: 10}, "s", "n").groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in got} == {1: 3, 4: 10}
    with pytest.raises(ValueError, match="smaller"):
        sampling.sample_exactly(s, "stratum", "id", {1: 11}, "s", "n")
    assert sampling.peek(spark.range(50).repartition(7), "id", 5, "s").collect() == sampling.peek(spark.range(50), "id", 5, "s").collect()
    parts = spark.createDataFrame([("a", 1, "error"), ("a", 2, "ok"), ("z", 1, "ok")], "id string, ordinal int, status string")
    manifest = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r.id for r in resume.resume_state(parts, manifest).collect()] == ["a"]
    with pytest.raises(Exception, match="unknown id in the log: z"):
        resume.resume_state(parts, manifest, strict=True).collect()
    with pytest.raises(Exception, match="no result for b"):
        resume.ordered_merge(manifest, parts.where("ordinal = 2").select("id", "status"), strict=True).collect()


def test_calls_in_batches_with_waits_and_raw_output(spark):
    tasks = spark.createDataFrame([(k,) for k in range(6)], "k int").coalesce(1)

    def call(row):
        if row["k"] == 3:
            raise ValueError("bad", f"raw {row['k']}")
        return str(row["k"])

    def batch(rows):
        if any(r["k"] == 3 for r in rows):
            raise RuntimeError("whole batch")
        return [f"b{r['k']}" for r in rows]

    got = {r.k: (r.value, r.error, r.attempts, r.raw) for r in resume.call_rows(tasks, call, 2, lambda k: 0.01 * k, batch).collect()}
    assert got == {k: (str(k), None, 1, None) for k in (0, 1, 2, 4, 5)} | {3: (None, "bad", 2, "raw 3")}
    assert {r.value for r in resume.call_rows(tasks.where("k < 3"), call, call_batch=batch).collect()} == {"b0", "b1", "b2"}


def test_pilot_gate(spark):
    fields = ["f", "g"]
    rows = [("candidate", "pilot", k, "A", 4, 4, 1) for k in range(20)] + [("candidate", "pilot-repeat", k, "AR", 4, 5, 1) for k in range(10)] + [("reference", "pilot", k, "", None, None, 1) for k in range(20)]
    log = spark.createDataFrame(rows, "task string, run_id string, sample_id int, anon_id string, f int, g int, attempts int")
    judged = lambda df, n=50: study.assess_pilot(df, spark.range(1).select(F.lit(n).alias("expected_records")), fields).first()
    assert (judged(log).status, judged(log).n_comparisons, judged(log).within_one) == ("passed", 20, 1.0)
    assert judged(log.withColumn("attempts", F.when(F.col("sample_id") < 2, 2).otherwise(1))).status == "needs_review"  # first-pass rate
    assert judged(log, 51).status == "needs_review" and judged(log.withColumn("g", F.when(F.col("anon_id") == "AR", 1).otherwise(F.col("g")))).largest == 3
    assert judged(log.limit(0)).status == "needs_review"


def test_human_tables(spark):
    schema = "row int, block string, f string, g string, major_error string"
    rows = [(2, "a", " 4", "+5", "Có"), (3, "b", "", "2", "no"), (4, "c", "1", "2", "KHÔNG "), (5, "d", "3", None, "yes"), (6, "e", "9", "1", " ")]
    df = spark.createDataFrame(rows, schema)
    got = study.human_annotations(df, "row", ["f", "g"]).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(2, "a", 4, 5, True), (4, "c", 1, 2, False)]
    report = study.annotation_report(df, "row", F.concat_ws("/", "block", "row"), ["f", "g"], most=2).first()
    assert tuple(report) == ("incomplete", 2, 3, ["b/3", "d/5"])
    assert tuple(study.annotation_report(df.limit(0), "row", F.col("block"), ["f", "g"]).first()) == ("complete", 0, 0, [])
    for bad, message in ((("6", "1", "no"), "bad f in row 7"), (("4.0", "1", "no"), "bad f in row 7"), (("1", "x", "no"), "bad g in row 7"), (("1", "1", "y"), "bad major_error in row 7")):
        with pytest.raises(Exception, match=message):
            study.human_annotations(df.union(spark.createDataFrame([(7, "z", *bad)], schema)), "row", ["f", "g"]).collect()


def test_greedy_decoding():
    mock = lambda sources, tokens: np.eye(9)[[4 if len(t) == 1 else 3 for t in tokens]]
    assert decoding.greedy(mock, [[1], [2, 3]], 5) == [[2, 4, 3], [2, 4, 3]]
    assert decoding.banned([2, 5, 6, 7, 5, 6], 3) == {7} and decoding.banned([2, 5], 3) == decoding.banned([2, 5, 5], 0) == set()
    assert [len(x) for x in decoding.greedy(lambda s, t: np.eye(9)[[3] * len(t)], [[1]], 6, least=3)] == [5]  # the end mark waits
    same = lambda s, t: np.tile([0, 0, 0, 0, 5, 4, 3, 2, 1.0], (len(t), 1))
    (out,) = decoding.greedy(same, [[1]], 7, least=7, ngram=2)
    assert len({*zip(out, out[1:], strict=False)}) == len(out) - 1 and not {0, 2, 3} & set(out[1:])


def by_hash(sources, tokens):
    """Scores of six tokens, drawn anew for every source and hypothesis."""
    return np.stack([np.random.default_rng([len(s), *s, *t]).normal(size=6) * 2 for s, t in zip(sources, tokens, strict=True)])


@pytest.mark.parametrize("least, ngram, alpha", [(0, 0, 1.0), (2, 0, 0.8), (0, 2, 1.1), (3, 1, 0.0)])
def test_wide_beams_find_the_best_of_all(least, ngram, alpha):
    most, sources = 4, [[1], [2, 3], []]

    def every(source, tokens=(2,), log=0.0):
        """(worth, tokens) of every closed or full hypothesis."""
        if tokens[-1] == 3 or len(tokens) == most + 1:
            yield log / ((5 + len(tokens) - 1) / 6) ** alpha, [*tokens]
            return
        fit = by_hash([source], [tokens])[0]
        seen = {tokens[k : k + ngram] for k in range(len(tokens) - ngram + 1)} if ngram else set()
        barred = {0, 2} | ({3} if len(tokens) - 1 < least else set()) | {x for x in range(6) if ngram and len(tokens) >= ngram and (*tokens[len(tokens) - ngram + 1 :], x) in seen}
        total = np.log(sum(np.exp(fit[x]) for x in range(6) if x not in barred))
        for x in set(range(6)) - barred:
            yield from every(source, (*tokens, x), log + fit[x] - total)

    found = decoding.beam(by_hash, sources, 6**most, most, least, ngram, alpha)
    for source, out in zip(sources, found, strict=True):
        assert out == max(every(source))[1]
    narrow = decoding.beam(by_hash, sources, 2, most, least, ngram, alpha)
    assert [decoding.beam(by_hash, [s], 2, most, least, ngram, alpha)[0] for s in sources] == narrow  # a source alone and among others
    assert decoding.beam(by_hash, [], 2, most) == [] and decoding.beam(lambda s, t: np.full((len(t), 6), -np.inf), [[1]], 2, most) == [[2, 3]]


def test_a_batch_of_beams_is_searched_as_arrays(monkeypatch):
    """Hypotheses of a step are grown together, not one by one; wide scores a block at a time."""
    from corpusloom.plans import q_sequences

    whole, seen = decoding.allowed, []
    monkeypatch.setattr(decoding, "allowed", lambda scores, *more: seen.append(scores.shape) or whole(scores, *more))
    decoding.beam(q_sequences.next_scores, [[k, 2 * k, 3 * k + 1][: k % 4] for k in range(400)], 4, 12, 2, 3, 1.1)
    assert len(seen) == 12 and seen[0] == (400, 64) and seen[5][0] > 400
    wide = lambda s, t: np.tile(np.arange(100_000.0) % 977, (len(t), 1))
    seen.clear()
    found = decoding.beam(wide, [[1]] * 9, 2, 3), decoding.greedy(wide, [[1]] * 9, 3)
    assert max(rows * cells for rows, cells in seen) <= decoding.CELLS
    assert found == (decoding.beam(wide, [[1]], 2, 3) * 9, decoding.greedy(wide, [[1]], 3) * 9)


def test_best_paths_over_pieces(spark):
    from itertools import product

    rng = np.random.default_rng(2)
    scores = [("<pad>", 0.0), ("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0)] + [(p, -float(rng.uniform(1, 6))) for p in ["▁", "a", "b", "ab", "ba", "aa", "▁a", "▁ab", "bab", "▁ba"]]
    own = decoding.Pieces(scores)
    for size in range(1, 7):
        for t in map("".join, product("ab", repeat=size)):
            whole, best = "▁" + t, -1e9
            for cuts in product((0, 1), repeat=size):
                parts, at = [], 0
                for k, c in enumerate(cuts, 1):
                    if c:
                        parts, at = [*parts, whole[at:k]], k
                parts.append(whole[at:])
                if all(p in own.at for p in parts):
                    best = max(best, sum(own.at[p][1] for p in parts))
            ids = own.encode(t)
            assert sum(scores[i][1] for i in ids) == pytest.approx(best) and own.decode(ids) == t
    assert own.encode("a zz b").count(1) == 1 and own.encode(None) == own.encode("  ") == [] and own.decode(own.encode("b z a")) == "b ⁇ a"
    vocabulary = spark.createDataFrame([(k, *r) for k, r in enumerate(scores)], "id int, piece string, score double")
    texts = spark.createDataFrame([(1, "ab ba"), (2, None), (3, "")], "k int, t string")
    assert {r.k: r.ids for r in decoding.encode_pieces(texts, "t", vocabulary).collect()} == {1: own.encode("ab ba"), 2: [], 3: []}
    with pytest.raises(ValueError):
        decoding.encode_pieces(texts, "t", vocabulary.where("id <> 2"))


def test_decoding_queries(spark):
    from corpusloom.plans import q_sequences

    sf = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = q_sequences.unigram_pieces(spark, sf).collect()
    assert len(got) == len(turns) and all((r.ids == []) == (not (turns[r.conv_id, r.turn] or "").split()) for r in got)
    orders = q_sequences.greedy_decode(spark, sf).collect()
    assert orders and all(3 <= len(r.decoded) <= 13 and r.decoded[0] == 2 for r in orders)
    parts = {r.l_orderkey: r.ids for r in q_sequences.ordered_parts(spark, sf).collect()}
    beams = {r.l_orderkey: r.decoded for r in q_sequences.beam_decode(spark, sf).collect()}
    some = sorted(parts)[:40]
    assert beams.keys() == parts.keys() and [beams[k] for k in some] == decoding.beam(q_sequences.next_scores, [parts[k] for k in some], 4, 12, 2, 3, 1.1)


def test_runs_are_counted_as_strings(spark):
    """Runs of a long text are taken by place, not by slices of it, and are shuffled as one string each."""
    rows = spark.createDataFrame([(k, [f"w{k % 3}", "x", "y"] * 4) for k in range(9)], "k int, tokens array<string>")
    taken = []
    real = segmentation.stored
    try:
        segmentation.stored = lambda df, name: taken.append(df) or real(df, name)
        found = {r.compound: r.n for r in segmentation.compounds(rows, "tokens", 99, least=2, apart=0.1).collect()}
    finally:
        segmentation.stored = real
    assert "slice(" not in taken[0]._jdf.queryExecution().optimizedPlan().toString() and "array" not in taken[0].schema.simpleString()
    want = Counter(" ".join(r.tokens[k : k + n]) for r in rows.collect() for n in (2, 3) for k in range(len(r.tokens) - n + 1))
    assert found and all(want[c] == n for c, n in found.items())


def matched(a, b):
    """Length of a longest common subsequence, as a longest ascending run of matching places."""
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    tails: list = []
    for x in a:
        for j in reversed(places.get(x, [])):
            k = bisect.bisect_left(tails, j)
            tails[k:] = [j, *tails[k + 1 :]]
    return len(tails)


def f_one(o, p, r):
    return 2 * (o / p) * (o / r) / (o / p + o / r) if o else 0.0


def plain_ranks(xs):
    order = sorted(xs)
    return [order.index(x) + (order.count(x) + 1) / 2 for x in xs]


def correlation(xs, ys):
    x, y = np.array(plain_ranks(xs)), np.array(plain_ranks(ys))
    return round(float(np.corrcoef(x, y)[0, 1]), 6) if len({*xs}) > 1 and len({*ys}) > 1 else None


def test_overlap_queries_are_the_plain_ones(spark):
    """lcs_length, rouge_l, eval_summary, rouge_score_corr and disagreement_case by hand."""
    sf = "/root/testdata/sf0.001"
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    turns = {(r.conv_id, r.turn): (words(r.target), words(r.source)) for r in q_stats.V.turns(spark, sf).collect()}
    want = {k: matched(p, s) for k, (p, s) in turns.items()}
    assert {(r.conv_id, r.turn): r.lcs for r in q_stats.lcs_length(spark, sf).collect()} == want
    got = {(r.conv_id, r.turn): r.f1 for r in q_stats.rouge_l(spark, sf).collect()}
    assert all(abs(got[k] - f_one(want[k], len(p), len(s))) < 1e-6 for k, (p, s) in turns.items())
    manifest = {r.id: r for r in q_stats.V.manifest(spark, sf).collect()}
    rows = [(r.id, r.system, words(r.prediction)) for r in q_stats.V.predictions(spark, sf).where("status = 'ok'").collect()]
    by, longest = {}, {}
    for i, system, p in rows:
        r, s = words(manifest[i].reference), words(manifest[i].source)
        grams = lambda t, n: Counter(zip(*(t[k:] for k in range(n)), strict=False))
        fs = [f_one(sum((grams(p, n) & grams(r, n)).values()), max(0, len(p) - n + 1), max(0, len(r) - n + 1)) for n in (1, 2)]
        longest[manifest[i].doc_id, system] = f_one(matched(p, r), len(p), len(r))
        by.setdefault(system, []).append((*fs, longest[manifest[i].doc_id, system], len(p) / len(s) if s else 0))
    for r in q_stats.eval_summary(spark, sf).collect():
        assert r.n == len(by[r.system]) and np.allclose([r.rouge_1, r.rouge_2, r.rouge_l, r.compression], 100 * np.mean(by[r.system], axis=0), atol=1e-4)
    judged = {(r.sample_id, r.system): r.faithfulness for r in q_stats.V.scores(spark, sf).collect()}
    both = [(s, longest[i, s], y) for (i, s), y in judged.items() if (i, s) in longest]
    scopes = {"all": both} | {s: [x for x in both if x[0] == s] for s in ("lead1", "lead3")}
    assert {r.scope: (r.n, r.rho) for r in q_stats.rouge_score_corr(spark, sf).collect()} == {k: (len(v), correlation([x for _, x, _ in v], [y for _, _, y in v])) for k, v in scopes.items()}
    rated = {(r.sample_id, r.system): r.b for r in q_stats.rated(spark, sf).collect()}
    gap, sample, system = max((round(abs(longest[k] - b / 5), 6), *k) for k, b in rated.items() if k in longest)
    assert tuple(q_stats.disagreement_case(spark, sf).first()) == (gap, sample, system)


def test_eval_summary_scores_rows_where_they_are(spark):
    """Predictions meet what they are scored against in one join and are aggregated once."""
    plan = q_stats.eval_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [" in x for x in plan.splitlines()) == 1 and sum(" Join " in x or x.startswith("Join ") or "- Join " in x for x in plan.splitlines()) == 1


def test_repeat_spacing_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.position: (r.sample_id, r.is_repeat) for r in q_study.repeat_spacing(spark, sf).collect()}
    places = {x: k for k, x in got.items()}
    assert sorted(got) == list(range(len(got))) and len(places) == len(got)
    again = [s for s, r in places if r]
    assert len(again) == 8 and all(places[s, True] - places[s, False] >= 15 for s in again)
