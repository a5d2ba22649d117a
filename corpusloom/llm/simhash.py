"""SimHash fingerprints of word shingles and their near-duplicate groups by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import map_texts
from corpusloom.llm.components import connected_components
from corpusloom.runtime import ship, stored

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one UTF-8 text: A-Z lowered, words split at ASCII white space, shingles joined by a space.

    A text of fewer words than a shingle is one shingle of all of them; null or wordless gives 0.
    """
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        spans = zip(starts[at : min(n, at + (1 << 15))].tolist(), ends[at + width - 1 : at + width - 1 + (1 << 15)].tolist(), strict=False)
        hashed = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, *carried: F.Column) -> DataFrame:
    """(doc_id, carried columns, fp long) for every row, null and empty texts included; other columns are left behind."""

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype="<u8").view("<i8")
        return {"fp": pa.array(fps, pa.int64())}

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *carried, F.encode(F.col(f"`{text_col}`"), "UTF-8").alias("text"))
    return map_texts(rows, "text", "fp long", kernel, keep=False)


def ring(distance: int) -> tuple[list[int], list[int], list[int], int]:
    """(shifts, widths, budgets, exact) of a ring of 2 * distance + 1 segments.

    Two fingerprints within `distance` have a segment from which every chain of l consecutive segments differs in
    at most floor(l * distance / segments) bits; budgets[l - 1] is that bound, and the first `exact` of them are 0.
    """
    m = 2 * distance + 1
    cuts = [round(k * BITS / m) for k in range(m + 1)]
    budgets = [(k + 1) * distance // m for k in range(m)]
    return cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:], strict=False)], budgets, budgets.count(0)


def _segment(col: str, shift: int, width: int) -> F.Column:
    return F.shiftrightunsigned(F.col(col), shift).bitwiseAND(F.lit((1 << width) - 1))


def _star_edges(own: np.ndarray, every: np.ndarray, masks: list[tuple[int, int]], distance: int) -> list[tuple[int, int]]:
    """Spanning links of one bucket; a walk over components, so links of a dense group are never listed."""
    nodes = np.unique(np.concatenate((own, every)))
    can_probe = np.isin(nodes, own)
    left, out = np.arange(len(nodes)), []
    while len(left) > 1:
        root, todo, left = left[0], [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.arange(len(left)) if can_probe[at] else np.flatnonzero(can_probe[left])
            x = nodes[left[near]] ^ nodes[at]
            for mask, budget in masks:
                fits = np.bitwise_count(x & np.uint64(mask)) <= budget
                near, x = near[fits], x[fits]
            near = near[np.bitwise_count(x) <= distance]
            if len(near):
                found = left[near]
                out += [(int(nodes[f]), int(nodes[root])) for f in found]
                todo += found.tolist()
                left = np.delete(left, near)
    return out


def _bucket_links(distance: int):
    shifts, widths, budgets, exact = ring(distance)
    m = len(shifts)
    #: For each first segment, the masks of its chains of 1, 2, ... segments and their budgets.
    chains = [[(sum(((1 << widths[(i + k) % m]) - 1) << shifts[(i + k) % m] for k in range(n)), budgets[n - 1]) for n in range(exact + 1, m)] for i in range(m)]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(keys, fps, own) -> list[tuple[int, int]]:
            out: list[tuple[int, int]] = []
            cut = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            bounds = np.concatenate(([0], cut, [len(keys)]))
            for k in np.flatnonzero(np.diff(bounds) > 1):
                a, b = bounds[k], bounds[k + 1]
                out += _star_edges(fps[a:b][own[a:b]], fps[a:b], chains[int(keys[a, 0])], distance)
            return out

        def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(links, dtype="<u8").reshape(-1, 2).view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            held.append((keys, b.column(2).to_numpy().view("<u8"), b.column(3).to_numpy(zero_copy_only=False).astype(bool)))
            if np.array_equal(held[0][0][0], keys[-1]):
                continue  # still one bucket; those have been split to a bounded size before
            keys, fps, own = (np.concatenate([h[i] for h in held]) for i in range(3))
            last = int(np.flatnonzero(np.any(keys != keys[-1], axis=1))[-1]) + 1
            held = [(keys[last:], fps[last:], own[last:])]
            yield emit(solve(keys[:last], fps[:last], own[:last]))
        if held:
            yield emit(solve(*(np.concatenate([h[i] for h in held]) for i in range(3))))

    return of_batches


def near_links(distinct: DataFrame, distance: int = 2, bucket_rows: int = 4096) -> DataFrame:
    """(u, v): links that join just the fingerprints of `distinct(fp long)` connected by steps of <= `distance` bits.

    A bucket holds the fingerprints that agree in a first chain of segments with budget 0. A bucket of more than
    `bucket_rows`, probes included, is split by the chain's next segment: every fingerprint is kept under its own value, and sent as a
    probe to the values its budget still allows, until buckets are small or all segments are used (then a bucket
    holds one fingerprint and its probes). So a hot bucket is divided without losing a link.
    """
    ship(distinct.sparkSession)
    shifts, widths, budgets, exact = ring(distance)
    m = len(shifts)

    def keyed(i: int) -> F.Column:
        key = F.lit(0).cast("long")
        for k in range(exact):
            key = F.shiftleft(key, widths[(i + k) % m]).bitwiseOR(_segment("fp", shifts[(i + k) % m], widths[(i + k) % m]))
        return F.struct(F.lit(i).alias("i"), key.alias("key"))

    rows = distinct.select("fp", F.explode(F.array(*[keyed(i) for i in range(m)])).alias("k"))
    rows = rows.select(F.col("k.i").cast("long").alias("i"), F.col("k.key").alias("key"), "fp", F.lit(True).alias("own"), F.lit(0).alias("spent"))
    parts = []
    for level in range(exact, m):
        sizes = rows.groupBy("i", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))
        counts = sizes.where((F.col("n") > bucket_rows) & (F.col("own") > 0)).select("i", "key")
        hot = stored(counts, "hot-buckets")
        if hot.isEmpty():
            break
        parts.append(rows.join(hot, ["i", "key"], "left_anti"))
        rows, split = rows.join(hot, ["i", "key"], "left_semi"), None
        for i in range(m):
            at, width = shifts[(i + level) % m], widths[(i + level) % m]
            value = _segment("fp", at, width)
            flips = _flips(width, budgets[level])
            moves = F.filter(F.expr(f"array({flips})"), lambda x: F.col("spent") + F.bit_count(x) <= budgets[level])
            one = rows.where(F.col("i") == i).select("i", "key", "fp", "own", "spent", value.alias("value"), F.explode(moves).alias("flip"))
            one = one.select("i", F.xxhash64("key", F.col("value").bitwiseXOR(F.col("flip"))).alias("key"), "fp", (F.col("own") & (F.col("flip") == 0)).alias("own"), (F.col("spent") + F.bit_count("flip")).alias("spent"))
            split = one if split is None else split.union(one)
        rows = stored(split, "split-buckets")
    for part in parts:
        rows = rows.union(part)
    dealt = rows.select("i", "key", "fp", "own").repartition("i", "key").sortWithinPartitions("i", "key")
    return dealt.mapInArrow(_bucket_links(distance), "u long, v long")


def _flips(width: int, budget: int) -> str:
    """SQL list of the bit patterns of `width` bits with at most `budget` (1 or 2) bits set."""
    one = [1 << a for a in range(width)]
    two = [(1 << a) | (1 << b) for a in range(width) for b in range(a)] if budget > 1 else []
    return ", ".join(f"{x}L" for x in [0, *one, *two])


def _components(classes: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """(fp, first, root) of classes (fp, first): root tells the component, null for a fingerprint without links."""
    roots = stored(connected_components(near_links(classes.select("fp"), distance, bucket_rows)), "roots")
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, fp long, component_id) for every row: the smallest doc_id among all rows that links reach.

    Null, empty and wordless texts share fingerprint 0 and link like any other. Equal fingerprints are one node
    before any link is sought, so a group of copies costs one row. A row without id has its text's component;
    component_id is null only if no row of the component has an id. Repeated rows stay.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    joined = _components(classes, distance, bucket_rows)
    linked = joined.where("root is not null")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", F.col("least").alias("component_id"))
    alone = joined.where("root is null").select("fp", F.col("first").alias("component_id"))
    return marked.join(named.union(alone), "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, bucket_rows: int = 4096) -> DataFrame:
    """One row of docs, with all its columns, for each near-duplicate component.

    It is the row of the smallest id, null ids last, then of the smallest digest of text and other columns; rows that
    agree in all of these are equal, and one of them stays. The choice is made by row and fingerprint, so rows without
    id are deduplicated like others and different texts under one id are kept apart; partitioning plays no part.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    own, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col(own).cast("long").cast("string"), F.lit("-")), F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256), F.xxhash64(*[n for n in names if n != text]).cast("string")), 256)
    marked = stored(fingerprints(rows, own, text, shingle, digest.alias("key")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = stored(marked.groupBy("fp").agg(F.min(order).alias("first")), "fingerprint-classes")
    joined = _components(classes, distance, bucket_rows)
    least = joined.groupBy("root", F.when(F.col("root").isNull(), F.col("fp")).alias("alone")).agg(F.min("first").alias("first"))
    kept = least.select(F.col("first.key").alias("key")).distinct()
    return rows.withColumn("key", digest).join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*names).toDF(*docs.columns)


def hex_fingerprint(col: str) -> F.Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
