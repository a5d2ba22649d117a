"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import map_texts, white
from corpusloom.llm.pieces import Memory, as_binary, flat, windows
from corpusloom.runtime import ship, stored

BUCKETS, SHAPES, FACTS = 2048, 8, 11
SOURCES, LANGS = 48, 16


def _place(word: str) -> int:
    """Bucket of a word's bytes, and its shape: letters, capitals, marks at its end."""
    bare = word.strip(".,;:!?\"'()")
    shape = (not bare.isalpha()) + 2 * (bare.isupper() and len(bare) > 1) + 4 * (len(word) - len(bare) > 1)
    return crc32(bare.lower().encode()) % BUCKETS + BUCKETS * shape


@cache
def _places() -> Memory:
    """A worker's memory of words' places."""
    return Memory(lambda words: pa.array([_place(w.decode()) for w in words.to_pylist()], pa.int32()))


def word_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, count) of the places of each text's words between white space, in order."""
    found = []
    for part, at, first in windows(*flat(texts)):
        is_white, _ = white(part)
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        edge[1:-1] |= is_white[1:] != is_white[:-1]
        starts = np.flatnonzero(edge[:-1])
        kept = ~is_white[starts]
        words = as_binary(part, starts).filter(pa.array(kept)).dictionary_encode()
        places = _places().of(words.dictionary).to_numpy()[words.indices.to_numpy()]
        text = first + np.searchsorted(at, starts[kept], side="right") - 1
        found.append(np.unique(text * (BUCKETS * SHAPES) + places, return_counts=True))
    keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
    counts = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
    keys, where = np.unique(keys, return_inverse=True)  # a text may lie in several windows
    return keys // (BUCKETS * SHAPES), keys % (BUCKETS * SHAPES), np.bincount(where, counts, len(keys)).astype(np.int64)


@cache
def _upper_case() -> np.ndarray:
    """For every code point whether it is upper-case."""
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def capitals(text: str) -> int:
    """Number of upper-case characters in the whole text."""
    if text.isascii():
        return int(np.count_nonzero(np.frombuffer(text.encode(), np.uint8) - np.uint8(65) < 26))
    parts = (text[at : at + (1 << 20)] for at in range(0, len(text), 1 << 20))
    return sum(int(np.count_nonzero(_upper_case()[np.frombuffer(p.encode("utf-32-le"), np.uint32)])) for p in parts)


@dataclass
class View:
    """Logistic regression over one view, with the line that calibrates its log odds."""

    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def settled(self, z: np.ndarray) -> np.ndarray:
        return np.clip(z, -30, 30) * self.slope + self.shift

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.settled(x @ self.weights[:-1] + self.weights[-1])


def fit_view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 300) -> View:
    """Weighted ridge logistic regression by accelerated gradient steps."""
    x1 = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    scale = 0.25 * (weight[:, None] * x1**2).sum() + ridge
    w = last = np.zeros(x1.shape[1])
    for k in range(steps):
        v = w + k / (k + 3) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(x1 @ v, -30, 30)))
        gradient = x1.T @ (weight * (p - y)) + ridge * np.append(v[:-1], 0)
        last, w = w, v - gradient / scale * 4
    return View(w)


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """Platt's line on held-out rows; a view that these can't tell apart is left as it is."""
    if 0 < y.sum() < len(y):
        line = fit_view(view.odds(x)[:, None] / 10, y, np.ones(len(y)), 0.01, 500).weights
        if line[0] > 0:
            return View(view.weights, line[0] / 10, line[1])
    return view


def facts(text: str | None) -> list[float]:
    """Length, lines, repeated lines and characters by class of a page."""
    t = text or ""
    lines = t.split("\n")
    n = max(1, len(t))
    plain = len(t.encode("ascii", "ignore"))
    marks = sum(t.count(c) for c in "|#$%&*<>{}[]=_!")
    return [np.log1p(len(t)) / 10, np.log1p(len(lines)) / 5, len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 8, plain / n, marks / n * 10, t.count(",") / n * 20, t.count(".") / n * 20, t.count(" ") / n * 5, capitals(t) / n * 3, float(not t)]


@dataclass
class Features:
    """Both views of some documents. Text: share of each word shape, variety, and hashed words by their counts; metadata:
    facts, and the hashed source and language."""

    dense: np.ndarray
    size: np.ndarray
    bucket: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(texts: pa.Array, sources: list, langs: list) -> Features:
        n = len(texts)
        text, place, count = word_counts(texts)
        words = np.maximum(np.bincount(text, count, n), 1)
        shapes = np.bincount(text * SHAPES + place // BUCKETS, count, n * SHAPES).reshape(n, SHAPES) / words[:, None]
        variety = np.bincount(text, minlength=n) / words
        keys, where = np.unique(text * BUCKETS + place % BUCKETS, return_inverse=True)
        hashed = [[crc32(f"s{s}".encode()) % SOURCES, crc32(f"l{x}".encode()) % LANGS] for s, x in zip(sources, langs, strict=True)]
        dense = np.concatenate((shapes, variety[:, None], np.array([facts(t) for t in texts.to_pylist()]).reshape(n, FACTS), np.array(hashed).reshape(n, 2)), axis=1)
        return Features(dense.astype(np.float32), np.bincount(keys // BUCKETS, minlength=n), keys % BUCKETS, np.bincount(where, count, len(keys)).astype(np.int64))

    def packed(self) -> dict[str, pa.Array]:
        """As columns of bytes; counts take as many bytes as the batch's largest needs."""
        ends = np.append(0, np.cumsum(self.size)).tolist()
        cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
        return {"dense": pa.array([r.tobytes() for r in self.dense], pa.binary()), "buckets": cut(self.bucket.astype("<u2")), "counts": cut(self.count.astype("<u4"))}

    @staticmethod
    def unpacked(dense: pa.Array, buckets: pa.Array, counts: pa.Array) -> Features:
        data, at = flat(buckets)
        return Features(flat(dense)[0].copy().view("<f4").reshape(len(dense), SHAPES + 1 + FACTS + 2), np.diff(at) // 2, data.copy().view("<u2").astype(np.int64), flat(counts)[0].copy().view("<u4").astype(np.int64))

    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, weight) of each hashed word: log counts, scaled to length 1."""
        owner, logs = np.repeat(np.arange(len(self.size)), self.size), np.log1p(self.count)
        return owner, logs / np.sqrt(np.bincount(owner, logs**2, len(self.size)))[owner]

    def view(self, which: int) -> np.ndarray:
        """One view as a matrix, for a bounded number of documents."""
        n, d = len(self.size), self.dense.astype(np.float64)
        if which == 0:
            out = np.zeros((n, SHAPES + BUCKETS + 1))
            owner, weight = self._words()
            out[:, :SHAPES], out[:, -1] = d[:, :SHAPES], d[:, SHAPES]
            out[owner, SHAPES + self.bucket] = weight
            return out
        hashed = np.zeros((n, SOURCES + LANGS))
        hashed[np.arange(n), d[:, -2].astype(int)] = 0.3
        hashed[np.arange(n), SOURCES + d[:, -1].astype(int)] = 0.3
        return np.concatenate((d[:, SHAPES + 1 : -2], hashed), axis=1)

    def odds(self, views: list[View]) -> list[np.ndarray]:
        """Log odds of every document by both views, without their matrices."""
        d, (text, meta) = self.dense.astype(np.float64), (v.weights for v in views)
        owner, weight = self._words()
        a = d[:, :SHAPES] @ text[:SHAPES] + np.bincount(owner, weight * text[SHAPES + self.bucket], len(d)) + d[:, SHAPES] * text[-2] + text[-1]
        b = d[:, SHAPES + 1 : -2] @ meta[:FACTS] + 0.3 * (meta[FACTS + d[:, -2].astype(int)] + meta[FACTS + SOURCES + d[:, -1].astype(int)]) + meta[-1]
        return [v.settled(z) for v, z in zip(views, (a, b), strict=True)]


@dataclass
class Judge:
    """Both views and the weight of each in the combined log odds."""

    views: list[View]
    share: float

    def scores(self, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, by text, by metadata), each from 0 to 1."""
        a, b = features.odds(self.views)
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        return sigmoid(self.share * a + (1 - self.share) * b), sigmoid(a), sigmoid(b)


#: (odds by a view, its key, both views' rows) of pool documents; odds are of the sign asked for, the surest first.
Sure = Callable[[list[View], int, float, int], list[tuple[float, int]]]


def co_train(x: tuple[np.ndarray, np.ndarray], y: np.ndarray, sure: Sure, rows: Callable[[list[int]], tuple[np.ndarray, np.ndarray]], rounds: int = 5, each: int = 40) -> Judge:
    """Views teach each other: a round adds each view's most confident pool rows, by class share, to the other's rows.

    sure(views, view, sign, n) gives (odds, key) of the n surest pool rows of a sign, of which equal odds count once;
    rows(keys) gives their features in both views. A fifth of the labelled rows calibrates the views and weighs them.
    With one class only, both views are constant.
    """
    if not 0 < y.sum() < len(y):
        constant = lambda v: View(np.append(np.zeros(v.shape[1]), 30.0 * (2 * y.mean() - 1) if len(y) else 0.0))
        return Judge([constant(x[0]), constant(x[1])], 0.5)
    test = np.arange(len(y)) % 5 == 0
    if not 0 < y[test].sum() < test.sum() or not 0 < y[~test].sum() < (~test).sum():
        test = np.zeros(len(y), bool)
    up = max(1, round(each * y.mean()))
    taught: list[tuple[list, list]] = [([], []), ([], [])]
    used: set[int] = set()

    def fitted(v: int) -> View:
        xs, labels = [x[v][~test], *taught[v][0]], np.array(taught[v][1])
        weight = np.where(y[~test] > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        return fit_view(np.concatenate(xs), np.append(y[~test], labels), np.append(weight, np.where(labels > 0, 0.25 / y.mean(), 0.25 / (1 - y.mean()))))

    views = [fitted(0), fitted(1)]
    for _ in range(rounds):
        found = {(v, sign): sure(views, v, sign, 2 * rounds * each) for v in (0, 1) for sign in (1.0, -1.0)}
        chosen: list[tuple[int, float, list[int]]] = []
        for (v, sign), ranked in found.items():
            own = [key for odds, key in ranked if sign * odds > 1 and key not in used][: up if sign > 0 else max(1, each - up)]
            used.update(own)
            chosen.append((v, sign, own))
        got = rows([k for _, _, own in chosen for k in own])
        at = 0
        for v, sign, own in chosen:
            if own:
                taught[1 - v][0].append(got[1 - v][at : at + len(own)])
                taught[1 - v][1].extend([float(sign > 0)] * len(own))
                at += len(own)
        views = [fitted(0), fitted(1)]
    checked = test if test.any() else np.ones(len(y), bool)
    views = [calibrate(view, x[v][checked], y[checked]) for v, view in enumerate(views)]
    loss = [np.log1p(np.exp(np.where(y[checked] > 0, -1, 1) * view.odds(x[v][checked]))).mean() for v, view in enumerate(views)]
    return Judge(views, share=float((1 / loss[0]) / (1 / loss[0] + 1 / loss[1])))


PACKED = ["dense", "buckets", "counts"]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(key, doc_id, dense, buckets, counts) of every row: both views of the whole text, packed; keys are unique."""
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.struct(text, F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang")).alias("page"))

    def kernel(pages: pa.Array) -> dict[str, pa.Array]:
        texts, sources, langs = pages.flatten()
        return Features.of(texts, sources.to_pylist(), langs.to_pylist()).packed()

    return map_texts(rows, "page", "dense binary, buckets binary, counts binary", kernel, keep=False)


def train(featured: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", sample: int = 3000, rounds: int = 5, each: int = 40) -> Judge:
    """Fit on about `sample` labelled documents, chosen by a hash of the id: the only bound. All others are the pool.

    In each round every pool document is scored by both views; a task hands on its surest ones, of which equal ones
    (copies) count once, and the features of those chosen are fetched. Several labels of one document count as their mean
    (0.5 or more is good); null labels and ids teach nothing; labels without document are ignored. Repeated rows of a
    labelled id all teach.
    """
    spark = featured.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    rate = int(min(1.0, sample / max(1, known.count())) * (1 << 30))
    wanted = stored(known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < rate), "quality-labels")
    fit = stored(featured.join(wanted, "doc_id"), "quality-fit")
    got = fit.select("doc_id", "label", *PACKED).toArrow().sort_by([(c, "ascending") for c in ("doc_id", "dense", "buckets", "counts")]).combine_chunks()
    unpack = lambda t: Features.unpacked(*(t.column(c).combine_chunks() for c in PACKED)) if len(t) else Features.of(pa.array([], pa.string()), [], [])
    x = tuple(unpack(got).view(v) for v in (0, 1))
    taken = {r[0] for r in fit.select("key").collect()}
    most, cache_ = 2 * rounds * each, {}

    def sure(views: list[View], v: int, sign: float, n: int) -> list[tuple[float, int]]:
        mark = tuple(w.weights.tobytes() for w in views)
        if mark not in cache_:
            cache_.clear()
            cache_[mark] = _surest(featured, views, taken, most)
        return cache_[mark].get((v, sign > 0), [])[:n]

    def rows(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros((0, 0)), np.zeros((0, 0))
        found = featured.where(F.col("key").isin(keys)).select("key", *PACKED).toArrow().combine_chunks()
        at = {k: i for i, k in enumerate(found.column("key").to_pylist())}
        own = unpack(found.take([at[k] for k in keys]))
        return own.view(0), own.view(1)

    ship(spark)
    return co_train(x, np.array(got.column("label").to_pylist(), np.float64), sure, rows, rounds, each)


def _surest(featured: DataFrame, views: list[View], taken: set[int], n: int) -> dict[tuple[int, bool], list[tuple[float, int]]]:
    """By (view, good): (odds, key) of the n surest documents outside `taken`, the surest first; equal odds count once."""
    sent = featured.sparkSession.sparkContext.broadcast((views, np.array(sorted(taken), np.int64)))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gone = sent.value
        best = {(v, good): (np.zeros(0), np.zeros(0, np.int64)) for v in (0, 1) for good in (True, False)}
        for b in batches:
            keys = b.column(0).to_numpy()
            free = ~np.isin(keys, gone)
            for v, odds in enumerate(Features.unpacked(*b.columns[1:]).odds(own)) if len(keys) else ():
                for good in (True, False):
                    kept = free & (odds > 1 if good else odds < -1)
                    z, k = (np.concatenate(x) for x in zip(best[v, good], (odds[kept], keys[kept]), strict=True))
                    order = np.lexsort((k, -z if good else z))
                    z, k = z[order], k[order]
                    first = np.append(True, z[1:] != z[:-1])[: len(z)]
                    best[v, good] = z[first][:n], k[first][:n]
        for (v, good), (z, k) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(z), pa.int32()), pa.array([good] * len(z), pa.bool_()), pa.array(z), pa.array(k)], names=["view", "good", "odds", "key"])

    found = featured.select("key", *PACKED).mapInArrow(of_batches, "view int, good boolean, odds double, key long")
    found = found.groupBy("view", "good", "odds").agg(F.min("key").alias("key"))
    by_odds = Window.partitionBy("view", "good").orderBy(F.desc(F.abs("odds")), "key")
    top = found.withColumn("n", F.row_number().over(by_odds)).where(F.col("n") <= n).collect()  # 4 n at most
    out: dict = {}
    for r in sorted(top, key=lambda r: r["n"]):
        out.setdefault((r["view"], r["good"]), []).append((r["odds"], r["key"]))
    return out


def score(featured: DataFrame, judge: Judge) -> DataFrame:
    """(doc_id, quality_score, text_score, meta_score) of every row; null texts are scored by their metadata."""
    sent = featured.sparkSession.sparkContext.broadcast(judge)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = sent.value.scores(Features.unpacked(*b.columns[1:]))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, made)], names=["doc_id", "quality_score", "text_score", "meta_score"])

    return featured.select("doc_id", *PACKED).mapInArrow(of_batches, "doc_id long, quality_score double, text_score double, meta_score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, quality_score, text_score, meta_score) of every row of docs, by a judge trained on the labels.

    Null and empty texts are documents without words; an empty table of documents gives an empty table, labels without
    both classes give constant scores, and equal documents equal scores. Whole texts are read once; their features serve
    all rounds and the scores.
    """
    featured = stored(features(docs, id_col, text_col, source_col, lang_col), "quality-features")
    return score(featured, train(featured, labels, id_col=id_col, **options))
