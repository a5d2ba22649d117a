"""Decoding with an injected scorer, and subword encoding by the best path over scored pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sequences import BOS, EOS, PAD, UNK
from corpusloom.runtime import ship

#: scores(sources, tokens): for each row the score of every next token.
Scorer = Callable[[Sequence[Sequence[int]], Sequence[Sequence[int]]], np.ndarray]
#: Fixed value: how a space is written in a piece.
SPACE = "▁"
#: Scores of this many tokens at most are copied and sorted together.
CELLS = 1 << 18


def banned(tokens: Sequence[int], n: int) -> set[int]:
    """Tokens that would end an n-gram which the tokens have already; none for n = 0 or fewer than n - 1 new tokens."""
    if n <= 0 or len(tokens) < n:
        return set()
    head = tuple(tokens[len(tokens) - n + 1 :])
    return {tokens[k + n - 1] for k in range(len(tokens) - n + 1) if tuple(tokens[k : k + n - 1]) == head}


def allowed(scores: np.ndarray, tokens: np.ndarray, least: int, ngram: int) -> np.ndarray:
    """Scores with start and padding ruled out, the end mark before `least` new tokens, and what repeats an n-gram.

    A row of both arrays is a hypothesis; all are of one length, so an n-gram is looked up in all of them at once.
    """
    out, size = scores.astype(float), tokens.shape[1]
    out[:, [BOS, PAD]] = -inf
    if size - 1 < least:
        out[:, EOS] = -inf
    if ngram > 0:
        head = tokens[:, size - ngram + 1 :]
        for k in range(size - ngram + 1):
            hit = np.flatnonzero((tokens[:, k : k + ngram - 1] == head).all(axis=1))
            out[hit, tokens[hit, k + ngram - 1]] = -inf
    return out


def _blocks(scores: Sequence[Sequence[float]]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of scores, so many rows at a time that their copies stay small."""
    rows = max(1, CELLS // max(1, len(scores[0])))
    for k in range(0, len(scores), rows):
        yield k, np.asarray(scores[k : k + rows])


def greedy(scorer: Scorer, sources: Sequence[Sequence[int]], most: int, least: int = 0, ngram: int = 0) -> list[list[int]]:
    """The best allowed token after another for each source, until the end mark or `most` new tokens; ties to smaller ids.

    All unfinished sources are scored together.
    """
    out: list[list[int]] = [[BOS] for _ in sources]
    open_, tokens = list(range(len(sources))), np.full((len(sources), 1), BOS)
    for _ in range(most):
        if not open_:
            break
        scores = scorer([sources[k] for k in open_], tokens.tolist())
        best = np.concatenate([allowed(own, tokens[k : k + len(own)], least, ngram).argmax(axis=1) for k, own in _blocks(scores)])
        for k, token in zip(open_, best.tolist(), strict=True):
            out[k].append(token)
        going = best != EOS
        open_ = [k for k, on in zip(open_, going.tolist(), strict=True) if on]
        tokens = np.column_stack([tokens, best])[going]
    return out


def _grown(scores: np.ndarray, tokens: np.ndarray, width: int, least: int, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, log probabilities) of the `width` likeliest allowed next tokens of every row; what is not allowed is -inf."""
    fit = allowed(scores, tokens, least, ngram)
    most = fit.max(axis=1, keepdims=True)
    shift = np.where(most > -inf, most, 0.0)
    with np.errstate(divide="ignore"):
        total = shift + np.log(np.exp(fit - shift).sum(axis=1, keepdims=True))
    rows, top, best = np.arange(len(fit)), [], []
    for _ in range(min(width, fit.shape[1])):
        top.append(fit.argmax(axis=1))
        best.append(fit[rows, top[-1]])
        fit[rows, top[-1]] = -inf
    gain = np.column_stack(best)
    return np.column_stack(top), np.subtract(gain, total, out=np.full_like(gain, -inf), where=gain > -inf)


def beam(scorer: Scorer, sources: Sequence[Sequence[int]], width: int, most: int, least: int = 0, ngram: int = 0, alpha: float = 1.0) -> list[list[int]]:
    """The best hypothesis of each source by log probability over ((5 + new tokens) / 6) ** alpha.

    Each step grows every open hypothesis by its `width` likeliest allowed tokens and keeps the `width` best open ones of
    a source; of those that the end mark closes the best is kept, and nothing stops the search before `most` new tokens
    but that none is open. The open ones of all sources are scored, grown and ranked together, as rows of arrays. Ties go
    to what was found first, smaller ids before; a source without any hypothesis gives the start and the end mark.
    """
    best, worth = [[BOS, EOS] if most else [BOS] for _ in sources], np.full(len(sources), -inf)
    owner, log, tokens = np.arange(len(sources)), np.zeros(len(sources)), np.full((len(sources), 1), BOS)

    def ranked(own: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
        """The places of the `most` best values of each owner, owners ascending, of equal values the first."""
        order = np.lexsort((-value, own))
        first = np.searchsorted(own[order], own[order])
        return order[np.arange(len(order)) - first < most]

    def close(own: np.ndarray, value: np.ndarray, rows: np.ndarray) -> None:
        """Take rows of tokens that are worth more than what their owners have."""
        for k in ranked(own, value, 1).tolist():
            if value[k] > worth[own[k]]:
                worth[own[k]], best[own[k]] = value[k], rows[k].tolist()

    for _ in range(most):
        if not len(owner):
            break
        scores = scorer([sources[k] for k in owner.tolist()], tokens.tolist())
        parts = [_grown(own, tokens[k : k + len(own)], width, least, ngram) for k, own in _blocks(scores)]
        top, gain = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        row, at = np.nonzero(gain > -inf)
        owner, log, tokens = owner[row], log[row] + gain[row, at], np.column_stack([tokens[row], top[row, at]])
        value = log / ((4 + max(2, tokens.shape[1])) / 6) ** alpha
        ended = tokens[:, -1] == EOS
        close(owner[ended], value[ended], tokens[ended])
        going = np.flatnonzero(~ended)
        kept = going[ranked(owner[going], value[going], width)]
        owner, log, tokens, value = owner[kept], log[kept], tokens[kept], value[kept]
    if most:
        close(owner, value if len(owner) else log, tokens)
    return best


def _decoded(rows: DataFrame, ids: str, name: str, decode: Callable[[list[list[int]]], list[list[int]]]) -> DataFrame:
    """rows with what `decode` gives for their ids, a batch at a time; null ids are an empty source."""
    ship(rows.sparkSession)

    names, at = rows.columns, rows.columns.index(ids)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = decode([x or [] for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(of_batches, f"{schema}, `{name}` array<int>")


def decode_greedily(rows: DataFrame, ids: str, scorer: Scorer, most: int, least: int = 0, ngram: int = 0, name: str = "decoded") -> DataFrame:
    """rows with the tokens that greedy() gives for their ids; null ids are an empty source."""
    return _decoded(rows, ids, name, lambda sources: greedy(scorer, sources, most, least, ngram))


def decode_beams(rows: DataFrame, ids: str, scorer: Scorer, width: int, most: int, least: int = 0, ngram: int = 0, alpha: float = 1.0, name: str = "decoded") -> DataFrame:
    """rows with the tokens that beam() gives for their ids; null ids are an empty source."""
    return _decoded(rows, ids, name, lambda sources: beam(scorer, sources, width, most, least, ngram, alpha))


class Pieces:
    """Scored pieces by id: the best path over a text is that of the greatest sum of log probabilities."""

    def __init__(self, scores: Sequence[tuple[str, float]]):
        self.names = [p for p, _ in scores]
        self.at = {p: (k, s) for k, (p, s) in enumerate(scores) if k not in (PAD, UNK, BOS, EOS)}
        self.longest = max(map(len, self.at), default=1)
        self.unknown = min((s for _, s in self.at.values()), default=0.0) - 10

    def encode(self, text: str | None) -> list[int]:
        """Ids of the best path; a character that no piece covers is UNK, runs of those one. Ties go to longer last pieces."""
        t = "".join(SPACE + w for w in (text or "").split())
        best: list[tuple[float, int, int]] = [(0.0, 0, UNK)]
        for end in range(1, len(t) + 1):
            found = (best[end - 1][0] + self.unknown, end - 1, UNK)
            for start in range(max(0, end - self.longest), end):
                if (own := self.at.get(t[start:end])) is not None and best[start][0] + own[1] > found[0]:
                    found = (best[start][0] + own[1], start, own[0])
            best.append(found)
        out, end = [], len(t)
        while end:
            _, start, token = best[end]
            if not (out and token == UNK == out[-1]):
                out.append(token)
            end = start
        return out[::-1]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; UNK is U+2047, other reserved ids are left out."""
        shown = ("⁇" if i == UNK else "" if i in (PAD, BOS, EOS) else self.names[i] for i in ids)
        return "".join(shown).replace(SPACE, " ").strip()


def encode_pieces(rows: DataFrame, text: str, vocabulary: DataFrame, most: int = 1 << 18, name: str = "ids") -> DataFrame:
    """rows with the ids of their text by a vocabulary (id, piece, score) of `most` pieces at most, ids from 0 without gap;
    null and empty texts have none."""
    held = sorted(tuple(r) for r in vocabulary.select("id", "piece", "score").limit(most + 1).collect())
    if len(held) > most or [i for i, _, _ in held] != list(range(len(held))):
        raise ValueError(f"a vocabulary has ids 0, 1, ... and {most} pieces at most")
    ship(rows.sparkSession)
    pieces = rows.sparkSession.sparkContext.broadcast([(p, s) for _, p, s in held])

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Pieces(pieces.value)
        for b in batches:
            yield b.assign(**{name: [own.encode(None if t is None else str(t)) for t in b[text]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(of_batches, f"{schema}, `{name}` array<int>")


def word_pieces(words: DataFrame, token: str, n: str, most: int) -> DataFrame:
    """(id, piece, score): reserved ids, then the commonest `most` of words and of their characters, alone and after a
    space, scored by log share; ties by piece. A plain vocabulary where none has been trained."""
    from corpusloom.operators.sampling import place

    letters = F.split(F.col(token), "")
    every = F.concat(F.array(F.concat(F.lit(SPACE), F.col(token))), letters, F.transform(letters, lambda c: F.concat(F.lit(SPACE), c)), F.array(F.lit(SPACE)))
    counts = words.select(F.explode(every).alias("piece"), n).where("piece <> ''").groupBy("piece").agg(F.sum(n).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    ranked = place(counts, [-F.col("n"), F.col("piece")]).where(F.col("place") < most).crossJoin(total)
    own = ranked.select((F.col("place") + EOS + 1).cast("int").alias("id"), "piece", F.ln(F.col("n") / F.col("all")).alias("score"))
    reserved = words.sparkSession.createDataFrame([(PAD, "<pad>", 0.0), (UNK, "<unk>", 0.0), (BOS, "<s>", 0.0), (EOS, "</s>", 0.0)], "id int, piece string, score double")
    return reserved.union(own)
