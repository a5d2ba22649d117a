"""Token ids in files of canonical, length-limited Huffman codes, with bit offsets from which blocks are read alone.

The folder holds two tables: `codebook` (symbol, length) and `frames` (shard, frame, shard_start,
n_ids, doc_ids, payload).
A payload is one self-contained frame, little-endian: "HUFB", version, documents, ids, block size, block count; the
id count of each document; the bit offset of each block; then the codes, most significant bit first.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import codec, map_texts, vocabulary_path, vocabulary_size
from corpusloom.operators.ranges import bucket_of, splits_of
from corpusloom.runtime import ship, stored

MAGIC, VERSION, HEAD = b"HUFB", 1, "<4sHIQII"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        half = len(level) // 2
        both = np.concatenate((leaves, level[: 2 * half : 2] + level[1 : 2 * half : 2]))
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        marks.append(rank < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for mark in reversed(marks):
        used = int(mark[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: by length, then symbol."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        self.limit = int(self.lengths[-1]) if len(order) else 1
        spans = np.int64(1) << (self.limit - self.lengths)
        self.codes = (np.cumsum(spans) - spans) >> (self.limit - self.lengths)
        size = int(self.symbols.max()) + 1 if len(order) else 1
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.symbols], self.length_of[self.symbols] = self.codes, self.lengths
        self.lookup = np.zeros(1 << self.limit, np.int64)
        filled = np.repeat(self.symbols << 5 | self.lengths, spans)
        self.lookup[: len(filled)] = filled

    def pack(self, ids: np.ndarray, block: int) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the blocks, and the codes of all ids."""
        length, code = self.length_of[ids], self.code_of[ids]
        ends = np.cumsum(length)
        starts = ends - length
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        if len(ids):
            word, room = starts >> 6, 64 - (starts & 63) - length
            high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] = np.add.reduceat(high, first)
            over = np.flatnonzero(room < 0)
            words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return starts[::block], words.astype(">u8").tobytes()[: (total + 7) // 8]

    def unpack(self, packed: bytes, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
        """Ids of all blocks, read side by side through the table."""
        b = np.frombuffer(packed + b"\0" * 8, np.uint8).astype(np.uint64)
        window = b[:-3] << np.uint64(24) | b[1:-2] << np.uint64(16) | b[2:-1] << np.uint64(8) | b[3:]
        out = np.zeros((len(offsets), block), np.int64)
        at, left = offsets.astype(np.int64), n - np.arange(len(offsets)) * block
        shift, mask = 32 - self.limit, (1 << self.limit) - 1
        for k in range(min(block, n)):
            if left[-1] <= k and len(at) == len(offsets):
                at = at[:-1]
            if not len(at):
                break
            hit = self.lookup[(window[at >> 3].astype(np.int64) >> (shift - (at & 7))) & mask]
            out[: len(at), k] = hit >> 5
            at = at + (hit & 31)
        return out.reshape(-1)[:n]

    def frame(self, docs: list[np.ndarray], block: int = 512) -> bytes:
        """One frame of the ids of several documents."""
        ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        offsets, packed = self.pack(ids, block)
        head = struct.pack(HEAD, MAGIC, VERSION, len(docs), len(ids), block, len(offsets))
        return head + np.array([len(d) for d in docs], "<u8").tobytes() + offsets.astype("<u8").tobytes() + packed

    def unframe(self, payload: bytes) -> list[np.ndarray]:
        """The ids of each document of a frame."""
        magic, version, docs, n, block, blocks = struct.unpack_from(HEAD, payload)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a frame of token ids")
        at = struct.calcsize(HEAD)
        sizes = np.frombuffer(payload, "<u8", docs, at).astype(np.int64)
        offsets = np.frombuffer(payload, "<u8", blocks, at + 8 * docs)
        ids = self.unpack(payload[at + 8 * (docs + blocks) :], offsets, n, block)
        return np.split(ids, np.cumsum(sizes)[:-1]) if docs else []


_codes: dict[bytes, Code] = {}


def code_from(book: bytes) -> Code:
    """The code of a codebook of (symbol, length) pairs, kept by the Python worker."""
    if book not in _codes:
        _codes.clear()
        pairs = np.frombuffer(book, "<i8").reshape(-1, 2)
        _codes[book] = Code(pairs[:, 0], pairs[:, 1])
    return _codes[book]


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = None, width: str = "<u4") -> DataFrame:
    """(doc_id, ids binary): the ids that the tokenizers library gives the whole text, little-endian and unsigned.

    Null is as empty; `end_id`, if given, ends every document. The ids travel as bytes of `width`, 16 bits for a
    vocabulary that fits. The library encodes each piece between white space once while it is remembered.
    """
    path = path or vocabulary_path()
    kind = pa.uint16() if width == "<u2" else pa.uint32()
    end = b"" if end_id is None else np.array([end_id], width).tobytes()

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        ids = codec(path, "library", kind).encode(texts)
        data, at = ids.flatten().to_numpy().astype(width, copy=False), ids.offsets.to_numpy()
        return {"ids": pa.array([data[a:b].tobytes() + end for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, "text", "ids binary", kernel, keep=False)


def count_ids(ids: DataFrame, width: str = "<u4") -> DataFrame:
    """(symbol, n) over all documents, summed in each task before the shuffle."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            found = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        symbols = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int64()), pa.array(total[symbols], pa.int64())], names=["symbol", "n"])

    return ids.select("ids").mapInArrow(of_batches, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def write(ids: DataFrame, path: str, limit: int = 20, frame_ids: int = 1 << 20, shards: int | None = None, width: str = "<u4") -> None:
    """Write (doc_id, ids binary) to `path`, documents in ascending doc_id order (null last, by a hash; ties by their ids).

    Counts over all ids give one code; the vocabulary bounds what the driver sees. Documents are dealt by ranges of
    doc_id, so shard k holds what lies between two split points, and frames of about `frame_ids` ids follow one another
    in it. A frame holds whole documents. An empty table writes no frame.
    """
    spark = ids.sparkSession
    ship(spark)
    counts = np.array([tuple(r) for r in count_ids(ids, width).collect()], np.int64).reshape(-1, 2)
    counts = counts[np.argsort(counts[:, 0])]
    pairs = np.stack((counts[:, 0], code_lengths(counts[:, 1], limit)), axis=1)
    spark.createDataFrame([(int(s), int(n)) for s, n in pairs], "symbol long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(pairs.astype("<i8").tobytes())
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = splits_of(ids, "doc_id", shards)
    #: Null ids come last, in the order of a hash of their ids, in as many shards of their own.
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("ids"))
    last = F.lit(len(splits) + 1) + F.floor((F.col("mark").cast("double") / float(1 << 64) + 0.5) * shards).cast("int")
    shard = F.when(F.col("doc_id").isNull(), last).otherwise(bucket_of("doc_id", splits))
    dealt = ids.withColumn("mark", mark).select(shard.alias("shard"), "doc_id", "ids", "mark").repartition(len(splits) + 1, "shard")
    dealt = dealt.sortWithinPartitions("shard", F.asc_nulls_last("doc_id"), "mark", "ids").drop("mark")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, frame, start, held, names, size = code_from(book.value), -1, 0, 0, [], [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([shard], pa.int32()), pa.array([frame], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([code.frame(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "frame", "shard_start", "n_ids", "doc_ids", "payload"])

        for b in batches:
            for s, doc, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (s != shard or size >= frame_ids):
                    yield out()
                    frame, start, held, names, size = frame + 1, start + size, [], [], 0
                if s != shard:
                    shard, frame, start = s, 0, 0
                held.append(np.frombuffer(raw, width))
                names.append(doc)
                size += len(held[-1])
        if held:
            yield out()

    dealt.mapInArrow(of_batches, "shard int, frame int, shard_start long, n_ids long, doc_ids array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/frames")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>): every document of the files with the number of ids before it."""
    return _read(spark, path, "ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, from its decoded ids."""
    return _read(spark, path, "n_tokens long, ids_crc32 long", lambda ids: pa.array([len(x) for x in ids], pa.int64()), lambda ids: pa.array([crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _read(spark: SparkSession, path: str, extra: str, *columns) -> DataFrame:
    ship(spark)
    pairs = np.array([(r.symbol, r.length) for r in spark.read.parquet(f"{path}/codebook").collect()], "<i8")
    book = spark.sparkContext.broadcast(pairs.tobytes())
    frames = spark.read.parquet(f"{path}/frames")
    totals = {r[0]: r[1] for r in frames.groupBy("shard").agg(F.sum("n_ids")).collect()}  # one number a shard
    before, starts = 0, []
    for shard in range(max(totals, default=-1) + 1):
        starts.append(before)
        before += totals.get(shard, 0)
    sent = spark.sparkContext.broadcast(starts)
    names = ["doc_id", "start", *(x.split()[0] for x in extra.split(", "))]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = code_from(book.value)
        for b in batches:
            for shard, start, docs, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = code.unframe(payload)
                first = sent.value[shard] + start + np.concatenate(([0], np.cumsum([len(x) for x in ids])))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first.astype(np.int64)), *(f(ids) for f in columns)], names=names)

    return frames.select("shard", "shard_start", "doc_ids", "payload").mapInArrow(of_batches, f"doc_id long, start long, {extra}")


def save_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int | None = None, **layout) -> None:
    """Encode whole texts and write them; the ids are stored once and serve both the counts and the files."""
    width = "<u2" if vocabulary_size(vocabulary) <= 1 << 16 else "<u4"
    write(stored(token_ids(docs, id_col, text_col, vocabulary, end_id, width), "token-ids"), path, width=width, **layout)
