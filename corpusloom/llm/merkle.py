"""Document fingerprints: a Merkle tree over passages, paragraphs and sections, written out in one string.

`root/section/section...`: a section is its digest of 16 hex digits, ":" and its paragraphs joined by "."; a paragraph is
its digest of 16 hex digits, then its passages' digests of 8 each. Paragraphs end at a line end, passages at a sentence
end or after 48 characters, sections at a blank line or where a paragraph's digest says so (one in eight), so an edit moves
no border before it and few after it. The root of 32 digits is a digest over the sections' digests, a section's over its
paragraphs', a paragraph's over its passages'; digests are shown cut, but those above are made of whole ones (128 bits,
passages 64). Equal roots mean equal texts; where roots differ, only branches whose digests differ are opened.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import slices
from corpusloom.operators.ranges import bucket_of, splits_of
from corpusloom.runtime import ship

PASSAGES = re.compile(r"[^.!?\n]{0,48}(?:[.!?]+[ \t]*\n*|\n+|)").findall


def fingerprint(text: str | None) -> str:
    """The whole tree of one text; null is as empty. Texts are equal if and only if their roots are."""
    from xxhash import xxh3_64_digest, xxh3_128_digest

    tree: list[str] = []
    digests: list[bytes] = []
    section: list[tuple[bytes, str]] = []
    paragraph: list[bytes] = []

    def close_section() -> None:
        digest = xxh3_128_digest(b"".join([d for d, _ in section]))
        digests.append(digest)
        tree.append(f"{digest[:8].hex()}:{'.'.join([p for _, p in section])}")
        section.clear()

    def close_paragraph(blank: bool) -> None:
        digest = xxh3_128_digest(b"".join(paragraph))
        section.append((digest, digest[:8].hex() + b"".join([p[:4] for p in paragraph]).hex()))
        paragraph.clear()
        if blank or digest[-1] % 8 == 0:
            close_section()

    for passage in PASSAGES(text or ""):
        if passage:
            paragraph.append(xxh3_64_digest(passage.encode("utf-8", "surrogatepass")))
            if passage[-1] == "\n":
                close_paragraph(passage.endswith("\n\n"))
    if paragraph:
        close_paragraph(False)
    if section:
        close_section()
    return "/".join([xxh3_128_digest(b"".join(digests)).hex(), *tree])


def _pairs(left: list[str], right: list[str]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """(pairs of places of equal keys, places left alone on either side); repeated keys pair in order."""
    places: dict[str, list[int]] = {}
    for j in range(len(right) - 1, -1, -1):
        places.setdefault(right[j], []).append(j)
    pairs, alone = [], []
    for i, key in enumerate(left):
        if found := places.get(key):
            pairs.append((i, found.pop()))
        else:
            alone.append(i)
    return pairs, alone, sorted(chain.from_iterable(places.values()))


def _out_of_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs outside a longest run that ascends on both sides."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    kept, k = set(), ends[-1] if ends else -1
    while k >= 0:
        kept.add(k)
        k = back[k]
    return [p for k, p in enumerate(pairs) if k not in kept]


#: The levels below the root: digits of a branch's key, and the branches it opens into.
_OPEN = [(16, lambda s: s[17:].split(".")), (16, lambda p: [p[k : k + 8] for k in range(16, len(p), 8)]), (8, None)]


def _leaves(branch: str, level: int) -> int:
    """Number of passages of a branch."""
    if level == 0:
        return (len(branch) - 17 - branch.count(".") - 16 * (branch.count(".") + 1)) // 8
    return (len(branch) - 16) // 8 if level == 1 else 1


def _descend(a: str, b: str):
    """For each level the branches of both sides that are still open, as (path, branch), and how they pair."""
    (root_a, *left), (root_b, *right) = a.split("/"), b.split("/")
    if root_a == root_b:
        return
    open_ = [[((i,), s) for i, s in enumerate(side)] for side in (left, right)]
    for level, (digits, opened) in enumerate(_OPEN):
        pairs, *alone = _pairs(*([s[:digits] for _, s in side] for side in open_))
        yield level, open_, pairs, alone
        if opened:
            open_ = [[((*path, k), x) for path, s in (side[i] for i in rest) for k, x in enumerate(opened(s))] for side, rest in zip(open_, alone, strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of passages that two fingerprints have in common, 0 to 1: 2 * common / (all of both).

    Equal roots give 1 at once; equal branches count whole, and only differing ones are opened.
    """
    (root_a, *left), (root_b, *right) = a.split("/"), b.split("/")
    if root_a == root_b:
        return 1.0
    total = sum(_leaves(s, 0) for s in (*left, *right))
    common = sum(_leaves(sides[0][i][1], level) for level, sides, pairs, _ in _descend(a, b) for i, _ in pairs)
    return 2 * common / total if total else 0.0


def differing(a: str, b: str) -> list[tuple[str, tuple | None, tuple | None]]:
    """Where two texts differ, as (kind, path in a, path in b), found through the branches that differ.

    A path is (section, paragraph, passage), from 0. "gone" passages are in a alone, "new" ones in b alone; "moved" names
    branches of any level (shorter paths are whole sections or paragraphs) that both have, but in another order. Equal
    texts differ nowhere, and texts that aren't equal differ somewhere.
    """
    out: list[tuple[str, tuple | None, tuple | None]] = []
    for level, (left, right), pairs, (gone, new) in _descend(a, b):
        out += [("moved", left[i][0], right[j][0]) for i, j in _out_of_order(pairs)]
        if level == 2:
            out += [("gone", left[i][0], None) for i in gone] + [("new", None, right[j][0]) for j in new]
            out += [("moved", left[i][0], right[j][0]) for i, j in pairs if not gone and not new and not out]
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """All rows and columns of docs with the text's fingerprint."""
    from corpusloom.llm.bpe import free_name, map_texts

    out_col = free_name(docs, out_col)
    return map_texts(docs, text_col, f"`{out_col}` string", lambda texts: {out_col: pa.array(map(fingerprint, texts.to_pylist()), pa.string())})


def edited_by(text: str, other: str) -> str:
    """The text with its last third replaced by the start of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text, and how like both and the next document's are.

    The next document is that with the next smaller id; after the last comes the first. Rows of null id come last, in
    the order of a hash of their text, so they are dealt like others; equal ids are ordered by text; null texts are
    empty. A single row is its own next. Documents are dealt once by ranges of the id and read in order; the first text
    of each range is also sent to the end of the range before it, so no global window is needed and one text a range is
    doubled.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    splits = splits_of(rows, "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = len(splits) + 1
    #: Range 0 holds the largest ids; n ranges of hashes, for null ids, come after that of the smallest.
    last = F.lit(n) + F.floor((F.col("mark").cast("double") / float(1 << 64) + 0.5) * n).cast("int")
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), last).otherwise(F.lit(n - 1) - bucket_of("doc_id", splits)))
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("doc_id"), F.min("mark").alias("mark"))
    found = sorted(heads.collect(), key=lambda h: h["range"])  # one row a range
    if not found:
        return spark.createDataFrame([], SCHEMA)
    #: The range before each range that has rows; the first range follows the last.
    ahead = {b["range"]: a["range"] for a, b in zip([found[-1], *found[:-1]], found, strict=True)}
    wanted = F.col("doc_id").isin([h["doc_id"] for h in found if h["doc_id"] is not None])
    wanted = F.when(F.col("doc_id").isNull(), F.col("mark").isin([h["mark"] for h in found if h["mark"] is not None])).otherwise(wanted)
    tails = rows.where(wanted).groupBy("range", "doc_id", "mark").agg(F.min("text").alias("text"))
    sent_to = F.element_at(F.create_map(*[F.lit(x) for kv in ahead.items() for x in kv]), F.col("range"))
    tails = tails.select("doc_id", "text", "mark", sent_to.alias("range"), F.lit(1).alias("tail"))
    dealt = rows.select("doc_id", "text", "mark", "range", F.lit(0).alias("tail")).union(tails)
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), "mark", "text").drop("mark")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            start = 0
            ids, ranges, tails = (b.column(k).to_pylist() for k in (0, 2, 3))
            for texts in slices(b.column(1).to_pylist()):
                out = []
                for k, text in enumerate(texts, start):
                    now = (ids[k], text, fingerprint(text), ranges[k])
                    if held is not None and held[3] == now[3]:
                        out.append(_compared(held, now))
                    held = None if tails[k] else now
                start += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, TYPES, strict=True)], names=NAMES)

    return dealt.mapInArrow(of_batches, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def _compared(own: tuple, following: tuple) -> tuple:
    doc_id, text, print_, _ = own
    edited = edited_by(text, following[1])
    edited_print = fingerprint(edited)
    digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, print_, edited_print, likeness(print_, edited_print), likeness(print_, following[2])
