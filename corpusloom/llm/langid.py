"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import free_name, map_texts
from corpusloom.llm.pieces import Memory, as_binary, flat, windows
from corpusloom.runtime import ship, stored

WORDS = re.compile(r"[^\W\d_]+").findall
UNDETERMINED = "und"
#: Bytes of ASCII letters and of all characters beyond ASCII.
LETTER = np.array([c >= 0x80 or chr(c).isalpha() for c in range(256)])
#: A longer run of letters, as in scripts without spaces, is no word: it counts and is scored by its n-grams.
LONG = 64


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters."""
    return [w for w in WORDS(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, order: int) -> list[str]:
    """All n-grams of an edged word, of up to `order` characters."""
    edged = f"^{word}$"
    return [edged[k : k + n] for n in range(1, order + 1) for k in range(len(edged) - n + 1)]


class Model:
    """Per-language log frequencies of words and of n-grams, in columns; a worker makes look-ups of them when asked."""

    def __init__(self, langs: list[str], words: tuple[pa.Array, np.ndarray], parts: tuple[pa.Array, np.ndarray], order: int, smooth: float = 0.5):
        self.langs, self.order = langs, order
        self.words, self.parts = words[0], parts[0]
        self.word_logs, self.part_logs = self._logs(words[1], smooth), self._logs(parts[1], 2 * smooth)

    def _logs(self, table: np.ndarray, smooth: float) -> np.ndarray:
        if not len(table):
            return np.zeros((0, len(self.langs)), np.float32)
        totals = table.sum(axis=0) + 1
        table = table / (totals / totals.max()) + smooth
        return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("at", "part_at", "memory")}

    def ready(self) -> Model:
        """This model with its look-ups made."""
        if not hasattr(self, "memory"):
            self.at = {w: k for k, w in enumerate(self.words.to_pylist())}
            self.part_at = {w: k for k, w in enumerate(self.parts.to_pylist())}
            self.memory = Memory(self._of_pieces)
        return self

    def _covering(self, word: str) -> list[int]:
        """An unseen word's n-grams from the left, the longest known one at each place."""
        edged, get, found = f"^{word}$", self.part_at.get, []
        for k in range(len(edged)):
            for n in range(min(self.order, len(edged) - k), 0, -1):
                if (part := get(edged[k : k + n])) is not None:
                    found.append(part)
                    break
        return found

    def _of_pieces(self, pieces: pa.Array) -> pa.Array:
        """For each piece the sum of its words' log weights by language, then the number of its words.

        An unseen word's weight is the mean over the n-grams that cover it, 0 where none is known.
        """
        width, get = len(self.langs) + 1, self.at.get
        out = np.zeros((len(pieces), width), np.float32)
        known: tuple[list, list] = ([], [])
        covered: tuple[list, list, list] = ([], [], [])
        for k, piece in enumerate(pieces.to_pylist()):
            own = [piece.decode().lower()] if piece.isascii() else words_of(piece.decode())
            out[k, -1] = len(own)
            for w in own:
                if (at := get(w)) is not None:
                    known[0].append(k)
                    known[1].append(at)
                elif found := self._covering(w):
                    covered[0].append(k)
                    covered[1].append(len(found))
                    covered[2].extend(found)
        np.add.at(out[:, :-1], known[0], self.word_logs[known[1]])
        if covered[0]:
            sizes = np.array(covered[1])
            sums = np.add.reduceat(self.part_logs[covered[2]], np.cumsum(sizes) - sizes, axis=0)
            np.add.at(out[:, :-1], covered[0], sums / sizes[:, None])
        return pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), width)

    def scores(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score 0..1) of each text; (und, 0) for null or where no letter stands. Ties go to the smaller name.

        The language is that of the greatest mean weight over all words. The score is its share when that mean counts as
        often as there are words, 50 times at most: only the score's sharpness is bounded, so that it tells long texts apart.
        A run of LONG letters or more is weighed by its n-grams, as it was counted; shorter unseen words are too. Runs of letter bytes are weighed once while they are remembered.
        """
        own = self.ready()
        total = np.zeros((len(texts), len(self.langs) + 1))
        data, borders = flat(texts)
        for part, at, first in windows(data, borders):
            letter = LETTER[part]
            edge = np.zeros(len(part) + 1, bool)
            edge[at] = True
            edge[1:-1] |= letter[1:] != letter[:-1]
            starts = np.flatnonzero(edge[:-1])
            kept = letter[starts]
            runs = as_binary(part, starts).filter(pa.array(kept)).dictionary_encode()
            weights = own.memory.of(runs.dictionary).flatten().to_numpy().reshape(-1, total.shape[1]).astype(np.float64)
            text = first + np.searchsorted(at, starts[kept], side="right") - 1
            if len(text):
                sums = np.stack([np.bincount(text - first, column, len(at) - 1) for column in weights[runs.indices.to_numpy()].T], axis=1)
                total[first : first + len(sums)] += sums
        n = total[:, -1]
        logs = total[:, :-1] / np.maximum(n, 1)[:, None] * np.minimum(n, 50)[:, None]
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = logs.argmax(axis=1)
        share = 1 / np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -700)).sum(axis=1)
        return [self.langs[k] if m else UNDETERMINED for k, m in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, share, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score) of one text."""
        langs, score = self.scores(pa.array([text], pa.string()))
        return langs[0], float(score[0])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 4000, order: int = 4, least: int = 2) -> Model:
    """A model from at most about `sample_docs` labelled rows of each language, chosen by a hash of the id.

    That sample is the model's only bound: all its words and n-grams that occur `least` times are kept, whatever their
    number, and long runs of letters teach their n-grams. Words are counted and n-grams summed in Spark; the driver
    gets the sums in columns. Rows with null text or language teach nothing; without any, the model knows no language
    and predicts `und`. Rows without id are chosen or left together. Ties of counts play no part.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    large = rows.groupBy(F.col(lang_col)).count().where(F.col("count") > sample_docs).collect()  # rows / sample_docs at most
    mark = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    if large:
        share = F.create_map(*[F.lit(x) for lang, n in large for x in (lang, sample_docs / n)])
        rows = rows.where(mark < F.coalesce(F.element_at(share, F.col(lang_col)), F.lit(1.0)))
    sample = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                found.update((lang, False, w) for w in words if len(w) < LONG)
                for w in words:
                    if len(w) >= LONG:
                        found.update((lang, True, g) for g in grams(w, order))
            yield _counted(found)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, gram, key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for g in [key] if gram else grams(key, order):
                    found[lang, True, g] += n
            yield _counted(found)

    shape = "lang string, gram boolean, key string, n long"
    words = stored(sample.mapInArrow(count, shape).groupBy("lang", "gram", "key").agg(F.sum("n").alias("n")), "language-words")
    parts = words.mapInArrow(split, shape).groupBy("lang", "gram", "key").agg(F.sum("n").alias("n"))
    both = stored(words.where("not gram").union(parts), "language-counts")
    langs = sorted(r[0] for r in both.select("lang").distinct().collect())
    return Model(langs, _frequent(both.where("not gram"), langs, least), _frequent(both.where("gram"), langs, least), order)


def _counted(found: Counter) -> pa.RecordBatch:
    langs, gram, keys = zip(*found, strict=True) if found else ((), (), ())
    columns = [pa.array(langs, pa.string()), pa.array(gram, pa.bool_()), pa.array(keys, pa.string()), pa.array(found.values(), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "key", "n"])


def _frequent(counted: DataFrame, langs: list[str], least: int) -> tuple[pa.Array, np.ndarray]:
    """(keys in order, counts by language) of the keys that occur `least` times in all."""
    by = counted.groupBy("key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    got = by.where(F.col("all") >= least).select("key", F.explode("by").alias("b")).select("key", "b.lang", "b.n").toArrow()
    keys = got.column("key").combine_chunks().dictionary_encode()
    table = np.zeros((len(keys.dictionary), len(langs)))
    if len(keys):
        where = pa.compute.index_in(got.column("lang").combine_chunks(), value_set=pa.array(langs, pa.string())).to_numpy()
        np.add.at(table, (keys.indices.to_numpy(), where), got.column("n").to_numpy())
    order = pa.compute.sort_indices(keys.dictionary)
    return keys.dictionary.take(order), table[order.to_numpy()]


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All rows and columns of docs with lang_pred and score; null, empty and letterless texts are (und, 0)."""
    sent, langs = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "lang_pred")
    score = free_name(docs, "score")

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        found, sure = sent.value.scores(texts)
        return {langs: pa.array(found, pa.string()), score: pa.array(sure, pa.float64())}

    return map_texts(docs, text_col, f"`{langs}` string, `{score}` double", kernel, keep_text)


def held_out(id_col: str = "doc_id") -> F.Column:
    """The quarter of rows that training leaves aside; false without id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_text: bool = True, **bounds) -> DataFrame:
    """Train on the rows of docs that are not held out, then predict all rows."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col, **bounds)
    return predict(docs, model, text_col, keep_text)
