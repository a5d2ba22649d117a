"""Packing documents into sequences: best fit, then a local search that swaps documents between underfull bins.

Documents are dealt to groups of bounded size. A group is packed by best fit, largest first; then documents are exchanged
one for one, two for one, or moved between its underfull bins as long as the sum of squared fills grows, which fills the
fuller ones to the brim and drains the others until they are empty. Bins that are still underfull meet those of other
groups in further rounds, which see ever fewer bins.
"""

from __future__ import annotations

from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.huffman import token_ids
from corpusloom.runtime import ship, stored


class Bins:
    """Bins of one group: items are numbers of the group's rows, with their sizes."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}
        #: Of the underfull bins: which hold an item of a size, and, as bits, the sizes that any of them holds.
        self.holders: dict[int, dict[int, int]] = {}
        self.present = 0
        #: The two emptiest holders of a size, as far as known.
        self.emptiest: dict[int, list[tuple[int, int]]] = {}

    def best_fit(self) -> None:
        """Put every item, largest first, into the bin that it leaves least room in, or a new one."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0
        for i in sorted(range(len(self.sizes)), key=lambda i: -self.sizes[i]):
            size = self.sizes[i]
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, b = self.capacity, len(self.items)
                self.items[b], self.fill[b] = [], 0
            self.items[b].append(i)
            self.fill[b] += size
            if room > size:
                by_room[room - size].append(b)
                rooms |= 1 << room - size

    def put(self, b: int, items: list[int]) -> None:
        """A bin as it was filled before."""
        self.items[b], self.fill[b] = list(items), sum(self.sizes[i] for i in items)

    def squared_fill(self) -> int:
        return sum(x * x for x in self.fill.values())

    def _hold(self, b: int, size: int, by: int) -> None:
        held = self.holders.setdefault(size, {})
        held[b] = held.get(b, 0) + by
        if not held[b]:
            del held[b]
        self.emptiest.pop(size, None)
        self.present = self.present | 1 << size if held else self.present & ~(1 << size)

    def _transfer(self, giver: int, taker: int, given: list[int], returned: list[int]) -> None:
        for a, b, items in ((giver, taker, given), (taker, giver, returned)):
            for i in items:
                size = self.sizes[i]
                self.items[a].remove(i)
                self.items[b].append(i)
                self.fill[a] -= size
                self.fill[b] += size
                self._hold(a, size, -1)
                self._hold(b, size, 1)
        for i in (*self.items[giver], *self.items[taker]):
            self.emptiest.pop(self.sizes[i], None)

    def _close(self, b: int) -> None:
        """A bin that is full or empty takes no further part."""
        for i in self.items[b]:
            self._hold(b, self.sizes[i], -1)
        if not self.items[b]:
            del self.items[b], self.fill[b]

    def _donor(self, size: int, taker: int, net: int) -> int | None:
        """The emptiest other bin with an item of this size for which a net transfer of `net` raises the squared fill."""
        if (known := self.emptiest.get(size)) is None:
            known = self.emptiest[size] = nsmallest(2, [(self.fill[a], a) for a in self.holders[size]])
        fill, a = known[0] if known[0][1] != taker else known[-1]
        return a if a != taker and fill < self.fill[taker] + net else None

    def _sized(self, b: int, size: int, without: int | None = None) -> int:
        return next(i for i in self.items[b] if self.sizes[i] == size and i != without)

    def _single(self, taker: int, room: int, returned: list[int], least: int) -> tuple[int, int, list[int], list[int]] | None:
        """The largest net transfer over `least` by one item of another bin against `returned` of the taker's."""
        back = sum(self.sizes[i] for i in returned)
        sizes = self.present & (1 << back + room + 1) - 1
        while sizes and (size := sizes.bit_length() - 1) > back + least:
            donor = self._donor(size, taker, size - back)
            if donor is not None:
                return size - back, donor, [self._sized(donor, size)], returned
            sizes ^= 1 << size
        return None

    def _double(self, taker: int, room: int, returned: int, givers: list[int], least: int) -> tuple[int, int, list[int], list[int]] | None:
        """The largest net transfer over `least` by two items of one of the givers against one of the taker's."""
        back, best = self.sizes[returned], None
        for a in givers:
            if a == taker or a not in self.open or len(self.items[a]) < 2:
                continue
            row = sorted(self.items[a], key=lambda i: self.sizes[i])
            low, high = 0, len(row) - 1
            while low < high:
                net = self.sizes[row[low]] + self.sizes[row[high]] - back
                if net > room:
                    high -= 1
                    continue
                if net > least and self.fill[a] < self.fill[taker] + net:
                    least, best = net, (net, a, [row[low], row[high]], [returned])
                low += 1
            if least == room:
                break
        return best

    def _step(self, taker: int, donors: int) -> bool:
        """The exchange that fills a bin most: a move, one for one, one for two, two for one; stops at one that fills it."""
        room = self.capacity - self.fill[taker]
        one_of = list({self.sizes[i]: i for i in self.items[taker]}.values())
        best = self._single(taker, room, [], 0)
        for i in one_of:
            if best and best[0] == room:
                break
            best = self._single(taker, room, [i], best[0] if best else 0) or best
        sums = {}
        if not best or best[0] < room:
            sums = {self.sizes[i] + self.sizes[j]: [i, j] for n, i in enumerate(self.items[taker]) for j in self.items[taker][:n]}
        for pair in sums.values():
            if best and best[0] == room:
                break
            best = self._single(taker, room, pair, best[0] if best else 0) or best
        if not best or best[0] < room:
            if 2 * sum(a in self.open for a in self.givers) < min(donors, len(self.open)):
                self.givers = nsmallest(donors, self.open, key=lambda a: (self.fill[a], a))
            for i in one_of:
                best = self._double(taker, room, i, self.givers, best[0] if best else 0) or best
                if best and best[0] == room:
                    break
        if best is None:
            return False
        _, giver, given, returned = best
        self._transfer(giver, taker, given, returned)
        for b in (giver, taker):
            if self.fill[b] in (0, self.capacity):
                self._close(b)
                self.open.discard(b)
        return True

    def improve(self, donors: int = 64) -> int:
        """Exchange until no bin gains by any exchange looked at, or no bin can be spared any more; returns how often.

        Each exchange raises the squared fill. Takers go from the fullest bin to the emptiest. Two-for-one exchanges are
        sought in about the `donors` emptiest bins.
        """
        least = -(-sum(self.sizes) // self.capacity)
        self.holders, self.present, self.emptiest = {}, 0, {}
        self.givers: list[int] = []
        self.open = {b for b, x in self.fill.items() if x < self.capacity}
        for b in self.open:
            for i in self.items[b]:
                self._hold(b, self.sizes[i], 1)
        made, before = 0, -1
        while made > before:
            before = made
            for b in sorted(self.open, key=lambda b: (-self.fill[b], b)):
                while len(self.items) > least and b in self.open and self._step(b, donors):
                    made += 1
        return made


def _group(table: pa.Table, capacity: int, donors: int) -> pa.Table:
    """The bins of one group's rows (item, length, bin): bin null before the first round."""
    table = table.sort_by("item")
    items, bins = table.column("item").to_pylist(), table.column("bin").to_pylist()
    own = Bins(table.column("length").to_pylist(), capacity)
    if bins[0] is None:
        own.best_fit()
    else:
        held: dict[int, list[int]] = {}
        for i, b in enumerate(bins):
            held.setdefault(b, []).append(i)
        for b, rows in held.items():
            own.put(b, rows)
    own.improve(donors)
    out = []
    for rows in own.items.values():
        offset, fill, name = 0, sum(own.sizes[i] for i in rows), min(items[i] for i in rows)
        for i in sorted(rows):
            out.append((items[i], own.sizes[i], name, offset, fill))
            offset += own.sizes[i]
    columns = list(zip(*out, strict=True))
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["item", "length", "bin", "offset", "fill"])


def place_pieces(pieces: DataFrame, capacity: int = 2048, group_items: int = 1 << 14, donors: int = 64) -> DataFrame:
    """All columns of pieces, then sequence_id and offset of each, both long; `length` (1 to capacity) is a piece's size.

    No sequence holds more than `capacity`, and its pieces follow one another from 0 without a gap. A sequence is named by
    the smallest number of a row in it. Rounds end when all underfull bins meet in one group, or when a round empties or
    fills less than one in fifty of them. A column of pieces that is named like a new one is an error.
    """
    spark = pieces.sparkSession
    ship(spark)
    rows = stored(pieces.withColumn("__item", F.monotonically_increasing_id()), "pieces")
    some = rows.where(F.col("length") < capacity).select(F.col("__item").alias("item"), F.col("length").cast("int").alias("length"), F.lit(None).cast("long").alias("bin"))
    done = rows.where(F.col("length") >= capacity).select(F.col("__item").alias("item"), F.col("__item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n, turn, bins = some.count(), 0, None
    while n:
        groups = -(-n // group_items)
        key = F.xxhash64(F.lit(turn), F.coalesce("bin", "item"))
        dealt = some.withColumn("grp", F.pmod(key, F.lit(groups)))
        packed = dealt.groupBy("grp").applyInArrow(lambda t: _group(t, capacity, donors), "item long, length int, bin long, offset long, fill int")
        packed = stored(packed, "bins")
        is_open = F.col("fill") < capacity
        left = packed.where(is_open).agg(F.count("*").alias("n"), F.count_distinct("bin").alias("bins")).first()
        closed = packed.where(~is_open)
        if groups == 1 or bins is not None and left["bins"] > 0.98 * bins:
            closed, n = packed, 0
        else:
            n, bins, turn = left["n"], left["bins"], turn + 1
            some = packed.where(is_open).select("item", "length", "bin")
        done = done.union(closed.select("item", F.col("bin").alias("sequence_id"), "offset"))
    return rows.join(done, F.col("__item") == F.col("item")).drop("__item", "item")


def cut_pieces(encoded: DataFrame, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids binary) from (doc_id, ids binary of 32-bit numbers).

    Only documents of more than `capacity` ids are cut, and only their first piece may be shorter than that.
    """
    n = F.floor(F.octet_length("ids") / 4).cast("int")
    more = F.floor((F.col("n") - 1) / capacity).cast("int")
    first = F.col("n") - more * capacity

    def piece(p: F.Column) -> F.Column:
        start = F.when(p == 0, 0).otherwise(first + (p - 1) * capacity)
        length = F.when(p == 0, first).otherwise(F.lit(capacity))
        return F.struct(p.alias("piece"), start.cast("long").alias("start"), length.cast("long").alias("length"), F.substring("ids", start * 4 + 1, length * 4).alias("ids"))

    rows = encoded.withColumn("n", n).where("n > 0")
    return rows.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), more), piece)).alias("p")).select("doc_id", "p.*")


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """cut_pieces() of whole texts' ids by the tokenizers library, `end_id` after each document; null is as empty."""
    return cut_pieces(token_ids(docs, id_col, text_col, vocabulary, end_id), capacity)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = 2048, **search) -> DataFrame:
    """(doc_id, piece, start, length, ids binary, sequence_id, offset): every document's pieces in their sequences.

    Null and empty texts are one piece of `end_id` alone. Null ids, repeated ids and repeated rows are documents like
    others. Columns besides the two are left behind; an empty table gives an empty table.
    """
    return place_pieces(pieces_of(docs, id_col, text_col, vocabulary, end_id, capacity), capacity, **search)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, doc_ids, lengths) from pack(): the rows of a training run, each at most a sequence long."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(held.alias("p"))
    joined = F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
