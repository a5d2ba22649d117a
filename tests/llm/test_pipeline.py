"""The pipeline against a brute-force version of each stage."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, langid, secrets
from corpusloom.runtime import stored
from tests.llm.test_llm import DOCS, ROWS, brute_language, brute_model, brute_print, reshared


def test_stages(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "secret scans", "mixing", "BPE"]
    one = stages["language ID"](spark, docs, "")
    assert sorted(str(r.doc_id) for r in one.collect()) == sorted(str(i) for i, t, *_ in ROWS if any(c.isalpha() for c in t or ""))
    two = stages["SimHash near-dedup"](spark, docs, "")
    assert two.columns == docs.columns and sorted(str(r.doc_id) for r in two.collect()) == sorted(["1", "3", "6", "7", "9", "None"])
    assert len({brute_print(r.text) for r in two.collect()}) == 6
    three = {r.doc_id: r.text for r in stages["secret scans"](spark, two, "").collect()}
    assert len(three) == 6 and not any(m for t in three.values() for p, *_ in secrets.BASE.values() for m in p.findall(t or ""))
    four = stages["mixing"](spark, two, "")
    assert four.columns == docs.columns
    last = stages["BPE"](spark, four, "").collect()
    assert last and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_empty_and_unlabelled_tables(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(ROWS, DOCS)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), "").count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = stages["language ID"](spark, unlabelled, "").collect()
    assert Counter(r.text for r in kept) == Counter(t for _, t, *_ in ROWS if any(c.isalpha() for c in t or ""))


def test_run_by_hand(spark):
    """Each stage of a whole run on its own input against plain code."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [[r.asDict() for r in docs.collect()]]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "by-hand")
        rows.append([r.asDict() for r in docs.collect()])
    ids = lambda xs: Counter((r["doc_id"], r["text"]) for r in xs)
    model = brute_model([(r["text"], r["lang"]) for r in rows[0] if r["text"] is not None and r["lang"] is not None and not held(r["doc_id"])])
    assert ids(rows[1]) == ids(r for r in rows[0] if brute_language(r["text"], *model) != langid.UNDETERMINED)
    prints = {id(r): brute_print(r["text"]) for r in rows[1]}
    left, kept = sorted(rows[1], key=lambda r: r["doc_id"]), []
    while left:
        group, rest = [left[0]], left[1:]
        for r in group:  # grows as it is walked
            near = [x for x in rest if (prints[id(x)] ^ prints[id(r)]).bit_count() <= 2]
            group += near
            rest = [x for x in rest if x not in near]
        kept.append(min(group, key=lambda r: r["doc_id"]))
        left = rest
    assert ids(rows[2]) == ids(kept)
    owners: dict = {}
    for r in rows[2]:
        for _, _, _, value in secrets.candidates(r["text"]):
            owners.setdefault(value, set()).add(r["source"])
    clean = lambda r: secrets.masked(r["text"], [(a, b) for k, a, b, v in secrets.candidates(r["text"]) if k < 3 or len(owners[v]) <= 1])
    assert ids(rows[3]) == Counter((r["doc_id"], clean(r)) for r in rows[2])
    texts, size, taken = {r["doc_id"]: r["text"] for r in rows[3]}, Counter(), Counter()
    for r in rows[3]:
        size[r["source"]] += len(mixing_words(r["text"]))
    for r in rows[4]:
        assert texts[r["doc_id"]].startswith(r["text"].rstrip())
        taken[r["source"]] += len(mixing_words(r["text"]))
    assert all(abs(taken[s] - t) <= 1 + 0.001 * t for s, t in reshared(size).items())
    library = Tokenizer.from_file(bpe.vocabulary_path())
    wanted = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in rows[4])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows[5]) == wanted and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows[5])


def held(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def mixing_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and out.where("round_trip").count() == out.count() > 0
