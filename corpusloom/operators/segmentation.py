"""Word segmentation by a dictionary: compounds of several tokens are joined where the best path over a text says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import metrics as M
from corpusloom.operators.sampling import place
from corpusloom.runtime import ship, stored

SPACE, UNDERSCORE = b" _"
#: Runs and their numbers, as bytes of longs.
SHARES = "share int, keys binary, n binary"
#: Tokens or runs that a task sums at a time; stretches under which they are cut one by one; no compound; bits for pieces.
SUMMED, FEW, NONE, PIECES = 1 << 20, 24, -(1 << 62), 40


class Lexicon:
    """Compounds as an automaton over tokens: a state is a prefix of some compound, and tells what it is worth, if it is one.

    Worths count to six places, as whole numbers: sums are exact, so cuts of equal worth are equal wherever they stand.
    """

    def __init__(self, compounds: Sequence[tuple[str, float]]):
        self.next: list[dict[str, int]] = [{}]
        self.worth: list[int | None] = [None]
        for compound, worth in compounds:
            state = 0
            for token in compound.split(" "):
                if token not in self.next[state]:
                    self.next[state][token] = len(self.next)
                    self.next.append({})
                    self.worth.append(None)
                state = self.next[state][token]
            worth = round(worth * 1_000_000)
            self.worth[state] = worth if self.worth[state] is None else max(worth, self.worth[state])

    def cut(self, tokens: Sequence[str]) -> list[str]:
        """The tokens with compounds joined by "_": the cut whose compounds are worth most together.

        A token alone is worth nothing. Of equal cuts the one of fewer pieces wins, then that of the longer last piece.
        """
        best: list[tuple[int, int, int] | None] = [(0, 0, 0)] + [None] * len(tokens)  # worth, less pieces, less the last one's start
        for at in range(len(tokens)):
            worth, pieces, _ = best[at]
            found = [(at + 1, 0)]
            state, end = self.next[0].get(tokens[at], -1), at + 1
            while state >= 0 and end < len(tokens):
                state, end = self.next[state].get(tokens[end], -1), end + 1
                if state >= 0 and self.worth[state] is not None:
                    found.append((end, self.worth[state]))
            for end, gain in found:
                path = (worth + gain, pieces - 1, -at)
                if best[end] is None or path > best[end]:
                    best[end] = path
        out, end = [], len(tokens)
        while end:
            start = -best[end][2]
            out.append("_".join(tokens[start:end]))
            end = start
        return out[::-1]


def compounds(rows: DataFrame, tokens: str, most: int, least: int = 5, longest: int = 3, apart: float = 3.0, held: int = 1 << 20) -> DataFrame:
    """(compound, n, worth): what follows one another more often than chance, the `most` commonest, ties by the compound.

    The worth of a run of two to `longest` tokens is the log of how many times more often it occurs than its tokens would
    by chance; runs of fewer than `least` occurrences or less than `apart` are no compounds. Tokens are an array, or a string
    with spaces between them (text.token_text); they hold no space, which joins them in a run.

    Rows are read `longest` times. A run is no commoner than its tokens and its parts, so tokens are counted first, then
    runs of two common tokens, then longer ones of two common parts, as numbers that are summed in every task before the
    shuffle. Common is what occurs `floor` times: if `most` compounds do, no rarer one is among them, else the floor is
    lowered, to `least` at last. Where over `held` tokens or runs would be sent to all tasks, strings are counted instead.
    """
    ship(rows.sparkSession)
    given = rows.select(tokens)
    counts = stored(given.mapInArrow(_count_tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    total = counts.agg(F.sum("n")).first()[0] or 0
    floor = max(least, total // (64 * max(most, 1)))
    while True:
        some = _common_runs(given, counts, total, floor, longest, apart, held)
        if some is None:
            some = _all_runs(given, tokens, least, longest, apart)
            break
        if floor <= least or some.count() >= most:
            break
        floor = max(least, floor // 8)
    return place(some, [-F.col("n"), F.col("compound")]).where(F.col("place") < most).drop("place")


def _all_runs(given: DataFrame, tokens: str, least: int, longest: int, apart: float) -> DataFrame:
    """(compound, n, worth) of all compounds, by strings that are shuffled: nothing is held but a task's share."""
    if isinstance(given.schema[tokens].dataType, StringType):
        given = given.select(F.when(F.col(tokens) == "", F.array().cast("array<string>")).otherwise(F.split(tokens, " ")).alias(tokens))
    runs = lambda n: F.transform(M.joined_ngrams(tokens, n, " "), lambda g: F.struct(g.alias("run"), F.lit(n).alias("k")))
    counts = given.select(F.explode(F.concat(*[runs(n) for n in range(1, longest + 1)])).alias("r")).groupBy("r.run", "r.k").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = stored(counts, "runs")
    single = counts.where("k = 1").select(F.col("run").alias("token"), F.ln(F.col("n").cast("double")).alias("log"))
    total = given.agg(F.ln(F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("double")).alias("log_all"))
    each = counts.where("k > 1").select("run", "n", "k", F.explode(F.split("run", " ")).alias("token")).join(single, "token")
    joint = each.groupBy("run", "n", "k").agg(F.sum("log").alias("logs"), F.count("*").alias("found")).where("found = k").crossJoin(total)
    worth = F.round(F.ln(F.col("n").cast("double")) - F.col("logs") + (F.col("k") - 1) * F.col("log_all"), 6)
    return joint.select(F.col("run").alias("compound"), "n", worth.alias("worth")).where(F.col("worth") >= apart)


def _common_runs(given: DataFrame, counts: DataFrame, total: int, floor: int, longest: int, apart: float, held: int) -> DataFrame | None:
    """(compound, n, worth) of the compounds that occur `floor` times, stored; None if too many tokens or runs are as common."""
    spark = given.sparkSession
    common = counts.where(F.col("token").isNotNull() & (F.col("n") >= floor)).limit(held + 1).toArrow()
    if len(common) > held:
        return None
    words, times = pc.cast(common["token"].combine_chunks(), pa.string()), common["n"].to_numpy()
    sent, levels, found = spark.sparkContext.broadcast((words, times)), [], []
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SUMMED)
    for k in range(2, longest + 1):
        above = spark.sparkContext.broadcast(levels)
        runs = given.mapInArrow(_run_counter(sent, above, k, shares), SHARES).repartition(shares, "share").mapInArrow(_run_adder(floor), "key long, n long")
        runs = stored(runs, "runs")
        found.append(runs.mapInArrow(_run_speller(sent, above, k), "compound string, n long, times array<bigint>"))
        if k < longest:
            keys = runs.select("key").limit(held + 1).toArrow()["key"].to_numpy()
            if len(keys) > held:
                return None
            levels = [*levels, Level(keys)]
    logs = F.aggregate("times", F.lit(0.0), lambda s, n: s + F.ln(n.cast("double")))
    worth = F.round(F.ln(F.col("n").cast("double")) - logs + (F.size("times") - 1) * F.ln(F.lit(float(max(total, 1)))), 6)
    every = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "compound string, n long, times array<bigint>")
    return stored(every.select("compound", "n", worth.alias("worth")).where(F.col("worth") >= apart), "compounds")


class Tokens(NamedTuple):
    """The tokens of a batch one after the other; ends has the place after the last one of each row."""

    flat: pa.Array
    ends: np.ndarray

    @classmethod
    def of(cls, given: pa.Array) -> Tokens:
        """From arrays of tokens, or from strings with one space between tokens and none around them; null has none."""
        if pa.types.is_list(given.type) or pa.types.is_large_list(given.type):
            rows, filled = given, pc.is_valid(given)
        else:
            filled = pc.fill_null(pc.not_equal(given, ""), False)
            rows = pc.split_pattern(given.filter(filled), " ")
        n = np.zeros(len(given), np.int64)
        n[filled.to_numpy(zero_copy_only=False)] = pc.drop_null(pc.list_value_length(rows)).to_numpy()
        return cls(rows.flatten(), np.cumsum(n))

    def numbered(self, words: pa.Array) -> np.ndarray:
        """The place of each token among the words, -1 for others."""
        return pc.fill_null(pc.index_in(self.flat, value_set=words.cast(self.flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def left(self) -> np.ndarray:
        """How many tokens of its row there are from each token on."""
        return np.repeat(self.ends, np.diff(self.ends, prepend=0)) - np.arange(len(self.flat))


def _bytes(given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after the other, and the place of each row's first, with the end; null is as empty."""
    given = pc.cast(pc.fill_null(given, ""), pa.large_string())
    starts = np.frombuffer(given.buffers()[1], np.int64)[given.offset : given.offset + len(given) + 1]
    held = given.buffers()[2]
    return (np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8))[starts[0] : starts[-1]], starts - starts[0]


class Level:
    """Keys in order, and a bit for each of their hashes, by which most other keys are told without a search."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys, self.seen = np.sort(keys), np.zeros(1 << self.BITS, bool)
        self.seen[self._hash(self.keys)] = True

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are of the level, and their places in it."""
        some = np.flatnonzero(self.seen[self._hash(keys)])
        if not len(some):
            return some, some
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        same = self.keys[at] == keys[some]
        return some[same], at[same]


def _starting(ids: np.ndarray, left: np.ndarray, levels: Sequence[Level], n_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... tokens, the places where one of the level begins, in order, and which. A run's key is the place of
    its head among the runs that are one token shorter, times the number of words, plus its last token."""
    at = np.flatnonzero(ids >= 0)
    run = ids[at]
    yield at, run
    for k, level in enumerate(levels, 2):
        longer = left[at] >= k
        at, run = at[longer], run[longer]
        last = ids[at + k - 1]
        at, keys = at[last >= 0], (run * n_words + last)[last >= 0]
        some, run = level.find(keys)
        at = at[some]
        yield at, run


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n), summed over a task's tokens as long as they are under a million."""
    parts, size, sum_up = [], 0, lambda p: pa.concat_tables(p).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])
    for b in batches:
        counted = Tokens.of(b.column(0)).flat.value_counts()
        parts.append(pa.table({"token": pc.cast(counted.field("values"), pa.string()), "n": counted.field("counts")}))
        size += len(counted)
        if size > SUMMED:
            parts = [sum_up(parts)]
            size = len(parts[0])
            if size > SUMMED // 2:
                yield from parts[0].to_batches(1 << 16)
                parts, size = [], 0
    if parts:
        yield from sum_up(parts).to_batches(1 << 16)


def _run_counter(sent: Broadcast, above: Broadcast, k: int, shares: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the runs of k tokens whose tokens are sent and whose parts are the last of the levels above: SHARES, by the keys'
    remainders, each with the keys in order as bytes, so Spark moves a row for thousands of runs."""

    def shared(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        share = keys % shares
        order = np.argsort(share, kind="stable")
        keys, n, edges = keys[order], n[order], np.searchsorted(share[order], np.arange(shares + 1))
        for i in range(0, shares, 64):
            some = [j for j in range(i, min(i + 64, shares)) if edges[j] < edges[j + 1]]
            packed = [pa.array([x[edges[j] : edges[j + 1]].tobytes() for j in some], pa.binary()) for x in (keys, n)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *packed], names=["share", "keys", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, _), levels, parts, size, known = sent.value, above.value, [], 0, 0
        for b in batches:
            tokens = Tokens.of(b.column(0))
            ids, left = tokens.numbered(words), tokens.left()
            for at, run in _starting(ids, left, levels, len(words)):  # noqa: B007
                pass
            begins = np.zeros(len(ids) + 1, bool)
            begins[at] = True
            both = begins[at + 1] & (left[at] >= k)  # the other part begins at the next token
            at, run = at[both], run[both]
            every = np.sort(run * len(words) + ids[at + k - 1])
            first = np.flatnonzero(np.diff(every, prepend=-1))
            parts.append((every[first], np.diff(first, append=len(every))))
            size += len(first)
            if size > SUMMED + 2 * known:
                parts = [_summed(parts)]
                size = known = len(parts[0][0])
                if size > 2 * SUMMED:
                    yield from shared(*parts[0])
                    parts, size, known = [], 0, 0
        if parts:
            yield from shared(*_summed(parts))

    return count


def _run_adder(floor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, n) of the runs that occur `floor` times, of all SHARES of their keys. What a task holds is bounded by its shares,
    of about SUMMED tokens each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, known = [], 0, 0
        for b in batches:
            parts += [tuple(np.frombuffer(x, np.int64) for x in row) for row in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            size += sum(len(x[0]) for x in parts[-b.num_rows :]) if b.num_rows else 0
            if size > SUMMED + 2 * known:
                parts = [_summed(parts)]
                size = known = len(parts[0][0])
        if parts:
            keys, n = _summed(parts)
            keys, n = keys[n >= floor], n[n >= floor]
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["key", "n"])

    return add


def _run_speller(sent: Broadcast, above: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(compound, n, how often each of its tokens occurs) of (key, n)."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, times), levels = sent.value, above.value
        for b in batches:
            run, tokens = b.column(0).to_numpy(), []
            for level in [*levels[::-1], None]:
                run, last = np.divmod(run, len(words))
                tokens.insert(0, last)
                run = run if level is None else level.keys[run]
            tokens.insert(0, run)
            spelled = pc.binary_join_element_wise(*[words.take(pa.array(t)) for t in tokens], " ")
            each = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(times[np.stack(tokens, 1).ravel()]))
            yield pa.RecordBatch.from_arrays([pc.cast(spelled, pa.string()), b.column(1), each], names=["compound", "n", "times"])

    return spell


class Cutter:
    """Lexicon's cuts over many rows at once, from arrays."""

    def __init__(self, compounds: Sequence[tuple[str, float]]):
        worth: dict[tuple[str, ...], float] = {}
        for compound, w in compounds:
            parts = tuple(compound.split(" "))
            worth[parts] = max(w, worth.get(parts, w))
        worth = {p: w for p, w in worth.items() if len(p) > 1}
        words = sorted({t for p in worth for t in p})
        number = {t: i for i, t in enumerate(words)}
        self.words, self.levels, self.worth = pa.array(words, pa.string()), [], []
        longest = max(map(len, worth), default=1)
        heads = {(t,): number[t] for t in words}
        for k in range(2, longest + 1):
            key = {p: heads[p[:-1]] * len(words) + number[p[-1]] for p in {p[:k] for p in worth if len(p) >= k}}
            heads = {p: i for i, p in enumerate(sorted(key, key=key.__getitem__))}
            self.levels.append(Level(np.array([key[p] for p in heads], np.int64)))
            self.worth.append(np.array([round(worth[p] * 1_000_000) if p in worth else NONE for p in heads], np.int64))

    def joins(self, tokens: Tokens) -> np.ndarray:
        """Of each token, whether it is one piece with the next.

        Between places that no compound spans, each stretch is cut by itself: a token further in all of them at once, and in the
        last few, which are long, one by one.
        """
        n = len(tokens.flat)
        gains: list[np.ndarray] = []  # by length less 2, of the run that ends at a token
        spanned = np.zeros(n + 1, np.int64)
        found = _starting(tokens.numbered(self.words), tokens.left(), self.levels, len(self.words))
        next(found)
        for k, ((at, run), worth) in enumerate(zip(found, self.worth, strict=True), 2):
            at, w = at[worth[run] != NONE], worth[run]
            gains.append(gain := np.full(n, NONE))
            gain[at + k - 1] = w[w != NONE]
            np.add.at(spanned, at, 1)
            np.add.at(spanned, at + k - 1, -1)
        inner = np.concatenate([[False], np.cumsum(spanned[:n]) > 0, [False]])  # between a token and the next
        edges = np.flatnonzero(inner[1:] != inner[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2] + 1
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        worth, pieces, step = np.zeros(n, np.int64), np.ones(n, np.int64), np.ones(n, np.int64)  # as of a stretch's first token
        done, longest = 1, int(sizes[0]) if len(sizes) else 0
        while done < longest and (active := int(np.searchsorted(-sizes, -done, "left"))) >= FEW:
            at = starts[:active] + done
            worth[at], pieces[at] = worth[at - 1], pieces[at - 1] + 1
            for k, gain in enumerate(gains[:done], 2):
                e = at[gain[at] != NONE]
                w, p = (worth[e - k] + gain[e], pieces[e - k] + 1) if done >= k else (gain[e], np.ones(len(e), np.int64))
                better = (w > worth[e]) | (w == worth[e]) & (p <= pieces[e])
                e = e[better]
                worth[e], pieces[e], step[e] = w[better], p[better], k
            done += 1
        longer = int(np.searchsorted(-sizes, -done, "left"))
        for start, size in zip(starts[:longer].tolist(), sizes[:longer].tolist(), strict=True):
            self._along(start, size, done, gains, worth, pieces, step)
        joined = np.zeros(n, bool)
        at, first = starts + sizes - 1, starts
        while len(at) >= FEW:
            by = step[at]
            for k in range(2, len(gains) + 2):
                for back in range(1, k):
                    joined[at[by == k] - back] = True
            at = at - by
            at, first = at[at >= first], first[at >= first]
        for end, start in zip(at.tolist(), first.tolist(), strict=True):
            back = step[start : end + 1].tolist()
            while end >= start:
                by = back[end - start]
                joined[end - by + 1 : end] = True
                end -= by
        return joined

    def _along(self, start: int, size: int, done: int, gains: list[np.ndarray], worth: np.ndarray, pieces: np.ndarray, step: np.ndarray) -> None:
        """The rest of one stretch, of which `done` tokens are known."""
        ending: dict[int, list[tuple[int, int]]] = {}
        for k, gain in enumerate(gains, 2):
            at = done + np.flatnonzero(gain[start + done : start + size] != NONE)
            for i, g in zip(at.tolist(), gain[start + at].tolist(), strict=True):
                ending.setdefault(i, []).append((k, g << PIECES))
        paths = [0, *[(w << PIECES) - p for w, p in zip(worth[start : start + done].tolist(), pieces[start : start + done].tolist(), strict=True)]]
        steps = []
        for i in range(done, size):
            best, by = paths[i] - 1, 1
            for k, g in ending.get(i, ()):
                if (path := paths[i + 1 - k] + g - 1) >= best:
                    best, by = path, k
            paths.append(best)
            steps.append(by)
        step[start + done : start + size] = steps

    def cut(self, texts: pa.Array) -> list[pa.Array]:
        """Of texts of tokens with spaces between, the pieces with spaces between, tokens, pieces and pieces with an underscore."""
        data, starts = _bytes(texts)
        spaces, tokens = np.flatnonzero(data == SPACE), Tokens.of(texts)
        joined, n = self.joins(tokens), np.diff(tokens.ends, prepend=0)
        last = np.zeros(len(joined), bool)
        last[tokens.ends[n > 0] - 1] = True
        out = data.copy()
        out[spaces[joined[~last]]] = UNDERSCORE  # a space follows each token but a row's last
        piece = np.concatenate([[0], np.cumsum(~joined)])  # before each token
        pieces = np.diff(piece[tokens.ends], prepend=0)
        under = np.flatnonzero(out == UNDERSCORE)
        token_of = np.searchsorted(spaces, under) + np.cumsum(np.concatenate([[0], n > 0]))[np.searchsorted(starts, under, "right") - 1]
        of = piece[token_of]
        of = of[np.diff(of, prepend=-1) != 0]
        compound = np.diff(np.searchsorted(of, piece[tokens.ends]), prepend=0)
        null = pc.is_null(texts).to_numpy(zero_copy_only=False)
        whole = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(out.tobytes()))
        return [pc.if_else(pa.array(null), pa.scalar(None, pa.string()), pc.cast(whole, pa.string())), *[pa.array(x.astype(np.int32), mask=null) for x in (n, pieces, compound)]]


def segment_text(rows: DataFrame, text: str, lexicon: DataFrame, most: int = 1 << 18) -> DataFrame:
    """rows with a text of tokens (text.token_text) cut as by segment(), spaces between the pieces, and n_tokens, n_segments
    and n_compounds, the pieces with an underscore; null for null."""
    sent, names, at = _sent(rows, lexicon, most), rows.columns, rows.columns.index(text)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cutter(sent.value)
        for b in batches:
            cut, *numbers = own.cut(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], cut, *b.columns[at + 1 :], *numbers], names=[*names, "n_tokens", "n_segments", "n_compounds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(of_batches, f"{schema}, n_tokens int, n_segments int, n_compounds int")


def _sent(rows: DataFrame, lexicon: DataFrame, most: int) -> Broadcast:
    held = [(r[0], r[1]) for r in lexicon.select("compound", "worth").limit(most + 1).collect()]
    if len(held) > most:
        raise ValueError(f"a lexicon has {most} compounds at most")
    ship(rows.sparkSession)
    return rows.sparkSession.sparkContext.broadcast(held)


def segment(rows: DataFrame, tokens: str, lexicon: DataFrame, most: int = 1 << 18, name: str = "segments") -> DataFrame:
    """All columns of rows and the cut of an array of tokens by a lexicon (compound, worth) of `most` compounds at most, which
    is sent to all tasks; null tokens have no cut, empty ones an empty one."""
    sent, names, at = _sent(rows, lexicon, most), rows.columns, rows.columns.index(tokens)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(sent.value)
        for b in batches:
            cut = [None if t is None else own.cut(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cut, pa.list_(pa.string()))], names=[*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(of_batches, f"{schema}, `{name}` array<string>")


def joined_share(segments: Column | str) -> Column:
    """How much of the pieces are compounds; null for no pieces."""
    s = F.col(segments) if isinstance(segments, str) else segments
    return F.size(F.filter(s, lambda x: x.contains("_"))) / F.nullif(F.size(s), F.lit(0))
