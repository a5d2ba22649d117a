"""Packing, importance resampling and ball k-means against brute-force versions and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ballkmeans, bpe, packing, resampling
from tests.llm.test_sql import twin

DOCS = "doc_id long, text string, offset string, rank string, cluster string, length string, words string"
EXTRA = ("x",) * 5
TEXTS = [
    (1, "The cat sat on the mat " * 20), (2, "The cat sat on the mat " * 20), (2, "The cat sat on the mat " * 20), (3, None), (4, ""), (5, " \n\t "), (6, "le chat dort " * 4000),
    (7, "x" * 200_000), (None, "no id here " * 9), (None, None), (8, "Élan <|endoftext|> 日本語 ÀÉ É\x00Ab\x7fC"), (9, "a b"), (10, "word"), (11, "İK ſt ꭰ " * 30),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*t, *EXTRA) for t in TEXTS], DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def bins_of(sizes, capacity):
    own = packing.Bins(sizes, capacity)
    own.best_fit()
    return own


def whole(own, sizes):
    assert sorted(i for rows in own.items.values() for i in rows) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in rows) == own.fill[b] <= own.capacity for b, rows in own.items.items())


@pytest.mark.parametrize("seed", range(30))
def test_swaps_raise_the_squared_fill_and_lose_nothing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 300])
    sizes = [rng.randint(1, rng.choice([capacity - 1, capacity // 2, capacity // 3 + 1])) for _ in range(rng.randint(1, 200))]
    own = bins_of(sizes, capacity)
    count, squares, step = len(own.items), own.squared_fill(), own._step

    def watched(taker, donors):
        before, moved = own.squared_fill(), step(taker, donors)
        assert own.squared_fill() > before if moved else own.squared_fill() == before
        return moved

    own._step = watched
    made = own.improve()
    whole(own, sizes)
    assert len(own.items) <= count and (own.squared_fill() > squares) == (made > 0)


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    best = [len(sizes)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                put(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
        put(k + 1, [*bins, sizes[k]])

    put(0, [])
    return best[0]


def test_small_packings_are_near_the_best():
    rng, over = random.Random(3), 0
    for _ in range(150):
        sizes = sorted((rng.randint(2, 14) for _ in range(9)), reverse=True)
        own = bins_of(sizes, 20)
        own.improve()
        whole(own, sizes)
        over += len(own.items) - fewest(sizes, 20)
    assert over <= 3


def test_swaps_mend_what_best_fit_misses():
    sizes = [4, 4, 4, 6, 6, 6]  # best fit: 6+4, 6+4, 6+4; here from a bad start
    own = packing.Bins(sizes, 10)
    for b, items in enumerate([[0, 1], [2], [3], [4], [5]]):
        own.put(b, items)
    own.improve()
    whole(own, sizes)
    assert len(own.items) == 3
    own = packing.Bins([5, 3, 2, 5, 4, 1], 10)  # 5 against 3 + 2
    for b, items in enumerate([[0, 4], [1, 2], [3, 5]]):
        own.put(b, items)
    own.improve()
    assert len(own.items) == 2


@pytest.mark.parametrize("group_items", [1 << 14, 4])
def test_packing(spark, docs, none, group_items):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    rows = packing.pack(docs, group_items=group_items).collect()
    want = []
    for i, t in TEXTS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = -(-len(ids) // 2048)
        ends = [len(ids) - 2048 * (pieces - 1 - p) for p in range(pieces)]
        want += [(i, p, a, tuple(ids[a:b])) for p, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    got = [(r.doc_id, r.piece, r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in rows]
    assert Counter(got) == Counter(want) and all(r.length == len(r.ids) // 4 <= 2048 for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= sum(r.length for r in rows) / 2048 + (2 if group_items > 4 else 6)
    made = packing.sequences(packing.pack(docs)).collect()
    assert sum(len(r.ids) for r in made) == 4 * sum(r.length for r in rows) and all(len(r.ids) == 4 * sum(r.lengths) for r in made)
    assert packing.pack(none).count() == 0


def test_underfull_bins_of_groups_meet(spark):
    rng = random.Random(5)
    sizes = [(k, rng.randint(300, 900)) for k in range(3000)]
    pieces = spark.createDataFrame(sizes, "key int, length long")
    alone = packing.place_pieces(pieces, group_items=64, donors=16)
    rows = alone.collect()
    assert sorted((r.key, r.length) for r in rows) == sorted(sizes)
    bins = Counter()
    for r in rows:
        bins[r.sequence_id] += r.length
    single = packing.Bins([s for _, s in sizes], 2048)
    single.best_fit()
    assert max(bins.values()) <= 2048 and len(bins) <= len(single.items)


def brute_features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, least=20):
    own = [Counter(crc32(f.encode()) % 10000 for f in brute_features(t)[1]) for _, t in docs]
    pool, aim = sum(own, Counter()), sum((Counter(crc32(f.encode()) % 10000 for f in brute_features(t)[1]) for t in target), Counter())
    s_all, t_all = sum(pool.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10000) / ((pool[b] + 1) * (t_all + 10000))))
    rows = []
    for (i, t), c in zip(docs, own, strict=True):
        weight = sum(gain(b) * n for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(brute_features(t)[0]) >= least])
    some = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = some[: len(some) * 5 // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in [*some[len(drawn) :], *(r for r in rows if not r[4])]])


@pytest.mark.parametrize("window", [4 << 20, 300])
def test_resampling(spark, docs, none, window):
    target = spark.createDataFrame([(1, "the cat sat on the mat and slept", "q"), (2, None, "q"), (3, "日本語 élan", "q")], "item_id long, text string, gains string")
    rng = random.Random(2)
    more = [(100 + k, " ".join(rng.choices(["cat", "mat", "Élan", "the", "x" * 70, "dog", "2b"], k=rng.randint(15, 60)))) for k in range(80)]
    both = docs.union(spark.createDataFrame([(*t, *EXTRA) for t in more], DOCS))
    got = Counter(tuple(r) for r in resampling.resample(both, target, window=window).collect())
    assert got == brute_resample([*TEXTS, *more], ["the cat sat on the mat and slept", None, "日本語 élan"])
    assert resampling.resample(none, target).count() == 0
    got = Counter(tuple(r) for r in resampling.resample(docs, target.limit(0)).collect())
    assert got == brute_resample(TEXTS, [])


def test_crc_of_two_strings():
    rng = random.Random(4)
    both = [(rng.randbytes(rng.randint(0, 90)), rng.randbytes(n)) for n in [*range(70), 127, 128, 129, 5000, 70_001]]
    got = resampling.joined_crc(*(np.array(x, d) for x, d in (([crc32(a) for a, _ in both], np.uint32), ([crc32(b) for _, b in both], np.uint32), ([len(b) for _, b in both], np.int64))))
    assert got.tolist() == [crc32(a + b) for a, b in both]


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"


@pytest.mark.parametrize("rows", [0, 1])
def test_clusters_against_plain_sql(spark, tmp_path, rows):
    rng = np.random.default_rng(1)
    vectors = [(k, (rng.normal(size=64) + 3 * (k % 5)).tolist(), "a", "b") for k in range(400)]
    vectors += [(k % 7, [1.0] * 64, "a", "b") for k in range(200)] + [(None, [0.5] * 64, "a", "b"), (None, None, "a", "b"), (900, [1.0] * 63, "a", "b"), (901, [], "a", "b")]
    vectors += [(902, [float("nan")] * 64, "a", "b"), (903, [None] + [1.0] * 63, "a", "b"), (904, [float("inf")] * 64, "a", "b"), (905, [-0.3] * 64, "a", "b")]
    assert twin(spark, tmp_path, "op13_ballkmeans", "embeddings", vectors * rows, VECTORS) == ""


def test_fewer_vectors_than_clusters(spark):
    few = spark.createDataFrame([(k, [float(k)] * 64) for k in (1, 2, 2)], "vec_id long, embedding array<double>")
    rows = ballkmeans.ball_kmeans(few).collect()
    assert len(rows) == 3 and {r.distance for r in rows} == {0} and len({r.cluster for r in rows}) == 2
    huge = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no long holds"):
        ballkmeans.ball_kmeans(huge).collect()


def test_balls_compare_only_neighbours():
    rng = np.random.default_rng(7)
    centres = rng.integers(-1000, 1000, (40, 64)) * 8
    vectors = np.repeat(centres, 50, axis=0) + rng.integers(-300, 300, (2000, 64))
    plain = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    clusters = plain.argmin(axis=1)
    moved = centres + rng.integers(-40, 40, centres.shape)
    radii = [ballkmeans.root_up(int(plain[clusters == i, i].max())) + ballkmeans.root_up(int(((moved[i] - centres[i]) ** 2).sum())) for i in range(40)]
    best, distance, found = ballkmeans.Balls(moved, radii).nearest(vectors, clusters)
    plain = ((vectors[:, None] - moved[None]) ** 2).sum(axis=2)
    assert (best == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all() and found < plain.size / 10
    ties = np.zeros((4, 64), np.int64)
    ties[1:3, 0], ties[3, 0] = 10, 20
    at = np.zeros((3, 64), np.int64)
    at[:, 0] = 5, 10, 15
    for start in range(4):
        best, _, _ = ballkmeans.Balls(ties, [100] * 4).nearest(at, np.full(3, start))
        assert best.tolist() == [0, 1, 1]


def test_the_registered_packing_has_all_of_every_document(spark):
    from corpusloom.llm.queries import QUERIES

    rows = QUERIES["op11_packing"](spark, "/root/testdata/sf0.001").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in rows) <= 2048 and len(rows) <= -(-sum(r.n for r in rows) // 2048) + 1
