"""Importance resampling towards a target text: hashed n-gram features counted by DuckDB, merged and scored by Spark.

In every partition one DuckDB connection unnests the words of the batches and windows them into n-grams; their buckets come
from zlib's CRC-32, registered as a function. Each document's bucket counts go to Parquet in the shared folder; Spark sums
them into the counts of the corpus, turns these into gains, weighs every document by them and draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.pieces import flat, give_back, windows
from corpusloom.operators.sampling import place
from corpusloom.runtime import ship, stored

#: Bytes of words: a-z, 0-9 and whatever is not ASCII.
WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes up to which a table of its own tells what appending them does to a CRC.
NEAR = 64
COUNTS = "array<struct<bucket:int,n:int>>"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What appending zero bytes does to a CRC, as four tables of 256 (one a byte of the CRC): for each number of bytes
    below NEAR, and for each power of two from NEAR on."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    near = np.zeros((NEAR + 1, 4, 256), np.uint32)
    near[0] = np.arange(256, dtype=np.uint32) << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
    for k in range(1, NEAR + 1):
        near[k] = (near[k - 1] >> 8) ^ one[near[k - 1] & 255]
    far = [near[NEAR]]
    while len(far) < 26:
        far.append(appended(far[-1], far[-1]))
    return near[:NEAR].reshape(NEAR, 1024), np.stack(far)


def appended(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


TABLES = _tables()


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of two byte strings one after the other, from theirs and the right one's length."""
    near, far = TABLES
    at, flat_near = (length % NEAR) * 1024, near.reshape(-1)
    out = flat_near[at + (left & 255)] ^ flat_near[at + 256 + (left >> 8 & 255)] ^ flat_near[at + 512 + (left >> 16 & 255)] ^ flat_near[at + 768 + (left >> 24)]
    for k, table in enumerate(far):
        long = np.flatnonzero(length >> 6 + k & 1) if (length >= NEAR << k).any() else ()
        if len(long):
            out[long] = appended(out[long], table)
    return out ^ right


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def connection(memory: str):
    """A DuckDB connection of one thread that knows zlib's CRC-32, of a word and of two strings one after the other."""
    import duckdb
    from duckdb.sqltypes import UBIGINT, UINTEGER, VARCHAR

    con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
    of_words = lambda words: pa.array(np.fromiter(map(crc32, words.cast(pa.binary()).to_pylist()), np.uint32, len(words)))
    of_both = lambda a, b, n: pa.array(joined_crc(_numbers(a).astype(np.uint32), _numbers(b).astype(np.uint32), _numbers(n).astype(np.int64)))
    con.create_function("crc32", of_words, [VARCHAR], UINTEGER, type="arrow")
    con.create_function("crc32_joined", of_both, [UINTEGER, UINTEGER, UBIGINT], UINTEGER, type="arrow")
    return con


#: texts(row, words: a list of places in the vocabulary, carried: how many of them an earlier window has counted).
FEATURES = """
with plain as materialized (select place, crc32(word) c, strlen(word)::ubigint n from words),
spaced as materialized (select place, c, crc32_joined((select crc32(' ')), c, n) s, n + 1 n from plain),
tokens as (select row, carried, unnest(words) w, generate_subscripts(words, 1) i from texts),
grams as (select row, i > carried own, w, lag(w) over before w1, lag(w, 2) over before w2 from tokens window before as (partition by row order by i)),
hashed as (
    select row, z.c one, crc32_joined(y.c, z.s, z.n) two, crc32_joined(crc32_joined(x.c, y.s, y.n), z.s, z.n) three
    from grams join spaced z on z.place = w left join spaced y on y.place = w1 left join spaced x on x.place = w2
    where own
),
counted as (
    select row, bucket, count(*)::int n
    from (select row, unnest([one, two, three]) % {buckets} bucket from hashed) where bucket is not null group by row, bucket
)
select row, list({{'bucket': bucket::int, 'n': n}}) counts from counted group by row
"""


def cut_words(data: np.ndarray, borders: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, how many words lie before each border) of lower-cased texts; no word crosses a border."""
    of_word, edge = WORD[data], np.zeros(len(data) + 1, bool)
    edge[borders] = True
    begins, ends = of_word.copy(), np.append(False, of_word)
    begins[1:] &= ~of_word[:-1] | edge[1:-1]
    ends[1:-1] &= ~of_word[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    at = np.append(0, np.cumsum(last - first)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data[of_word])])
    return words, np.searchsorted(first, borders)


class Counter:
    """Bucket counts of columns of texts, by one DuckDB connection. A long text is counted window by window; the last words
    of a window go with the next one, so that no n-gram is lost or counted twice."""

    def __init__(self, buckets: int, memory: str, window: int):
        self.con, self.sql, self.window = connection(memory), FEATURES.format(buckets=buckets), window

    def counted(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """(number of the text, its words, its bucket counts) of each window's texts; texts of several windows come again."""
        data, borders = flat(pc.ascii_lower(texts.cast(pa.string())))
        tail, tail_of = pa.array([], pa.string()), -1
        for part, at, first in windows(data, borders, self.window):
            words, upto = cut_words(part, at)
            carried = len(tail) if tail_of == first else 0
            if carried:
                words, upto = pa.concat_arrays([tail, words]), np.append(0, upto[1:] + carried)
            coded = words.dictionary_encode()
            rows = np.flatnonzero(np.diff(upto))
            lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), coded.indices).take(pa.array(rows))
            had = np.where(rows == 0, carried, 0)
            self.con.register("texts", pa.table({"row": pa.array(rows, pa.int64()), "words": lists, "carried": pa.array(had, pa.int64())}))
            self.con.register("words", pa.table({"place": pa.array(np.arange(len(coded.dictionary), dtype=np.int32)), "word": coded.dictionary}))
            found = self.con.sql(self.sql).to_arrow_table()
            self.con.unregister("texts")
            self.con.unregister("words")
            of = found.column("row").to_numpy()
            yield first + of, np.diff(upto)[of] - np.where(of == 0, carried, 0), found.column("counts").combine_chunks()
            last = len(at) - 2
            tail_of, tail = first + last, words.slice(max(int(upto[last]), len(words) - 2))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, window: int = 4 << 20, memory: str = "512MB") -> DataFrame:
    """(row, doc_id, words long, counts array<(bucket, n)>), stored: a row for each text, and one more for each further
    window of a long one. `row` tells the rows of docs apart."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, names = None, ["row", "doc_id", "words", "counts"]
        for b in batches:
            give_back()
            counter = counter or Counter(buckets, memory, window)
            seen = np.zeros(len(b), bool)
            for of, words, counts in counter.counted(b.column("text")):
                at = pa.array(of)
                seen[of] = True
                yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("doc_id").take(at), pa.array(words, pa.int64()), counts], names=names)
            at = pa.array(np.flatnonzero(~seen))  # null and wordless texts
            yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("doc_id").take(at), pa.array(np.zeros(len(at)), pa.int64()), pa.array([[]] * len(at), KIND)], names=names)
        if counter:
            counter.con.close()

    return stored(rows.mapInArrow(run, f"row long, doc_id long, words long, counts {COUNTS}"), "bucket-counts")


KIND = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32())]))


def totals(counted: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of features(), summed in every task before the shuffle."""
    return counted.select(F.explode("counts").alias("x")).groupBy("x.bucket").agg(F.sum("x.n").alias("n"))


def gains(pool: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row: gains, an array of what one feature of each bucket adds to a weight. `buckets` bounds it."""
    both = totals(pool).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(totals(target).select("bucket", F.lit(0).cast("long"), "n"))
    seen = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = pool.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(seen, "bucket", "left").fillna(0, ["s", "t"])
    every = stored(every, "bucket-totals")
    sums = every.agg(F.sum("s").cast("double").alias("pool"), F.sum("t").cast("double").alias("target"))
    ratio = ((F.col("t") + F.lit(1.0)) * (F.col("pool") + buckets)) / ((F.col("s") + F.lit(1.0)) * (F.col("target") + buckets))
    told = every.crossJoin(sums).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))  # one row of sums
    return told.agg(F.array_sort(F.collect_list(F.struct("bucket", "gain"))).alias("g")).select(F.col("g.gain").alias("gains"))


def noise(seed: int, id_col: str) -> Column:
    """floor(-1000 ln(-ln(u))) of a number u between 0 and 1 from the SHA-256 of `seed:id`; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_col: str = "text", buckets: int = 10_000, least_words: int = 20, share: tuple[int, int] = (5, 100), seed: int = 42, **layout) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, for every row of docs.

    A-Z are lowered; words are runs of a-z, 0-9 and characters beyond ASCII; features are all runs of one to three words.
    A document weighs the sum of its features' gains, and its score adds noise of its id. Of the N documents with at least
    `least_words` words floor(N * share) of the highest scores are drawn, ties to the smaller doc_id, null last, then to the
    fewer features; rank is their order from 1, null for the others. Null and wordless texts have no features, weigh 0 and
    are never drawn; repeated rows are documents like others; columns besides the two are left behind. Without target texts
    all gains come from the documents' counts; an empty table gives an empty table.

    Texts are read once. Bucket counts are stored with each document, summed in each task before the shuffle, and weighed
    by an array of `buckets` gains that is sent to all tasks; ranks come from ranges of the score, in no single task.
    """
    pool, aim = features(docs, id_col, text_col, buckets, **layout), features(target, target_id, target_col, buckets, **layout)
    made = gains(pool, aim, buckets)
    weigh = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + F.get("gains", x["bucket"]) * x["n"])
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    parts = pool.crossJoin(F.broadcast(made)).select("row", "doc_id", "words", size.alias("n_features"), weigh.alias("weight"))  # one row is sent
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("words").alias("words"), F.sum("n_features").alias("n_features"), F.sum("weight").alias("weight"))
    scored = stored(whole.withColumn("score", F.col("weight") + noise(seed, "doc_id")), "scores")
    enough = F.col("words") >= least_words
    some = scored.where(enough)
    asked = some.count() * share[0] // share[1]
    order = [-F.col("score"), F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), F.col("doc_id").isNull(), F.col("n_features"), F.col("row")]
    placed = place(some, order).select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < asked, F.col("place") + 1).alias("rank"))
    rest = scored.where(~enough).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.union(rest)
