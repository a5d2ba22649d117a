"""Secret scan of whole texts, with the owners of each candidate counted over the corpus."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.bpe import map_texts
from corpusloom.runtime import stored

#: The base patterns; a match counts if its group has as many characters.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
KINDS = [*BASE, "opaque"]
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGIT, ALPHA = re.compile("[0-9]").search, re.compile("[A-Za-z]").search


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in code points: base matches, then opaque runs that touch none of them.

    An opaque run has 20 characters or more, digits and letters, and at least 3 bits a character. Base matches are
    merged to disjoint stretches, so each run looks up one of them.
    """
    out: list[tuple[int, int, int, str]] = []
    if not text:
        return out
    for kind, (pattern, group, least) in enumerate(BASE.values()):
        out += [(kind, *m.span(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b, _ in out):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for m in OPAQUE.finditer(text):
        a, b, s = *m.span(), m[0]
        at = bisect_right(ends, a)
        if (at == len(ends) or starts[at] >= b) and DIGIT(s) and ALPHA(s) and entropy(s) >= 3:
            out.append((3, a, b, s))
    return sorted(out, key=lambda x: (x[1], x[0]))


def digest(value: str) -> str:
    """What stands for a candidate's value in every table."""
    return sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def masked(text: str, spans: Iterable[tuple[int, int]], mask: str = "*") -> str:
    """The text with every character of the spans masked, in one pass; spans may overlap."""
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = max(a, at), max(b, at)
        out += [text[at:a], mask * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def _holders(docs: DataFrame, repo_col: str, owner_col: str) -> list[F.Column]:
    return [F.monotonically_increasing_id().alias("row"), F.col(f"`{repo_col}`").cast("string").alias("repo"), F.col(f"`{owner_col}`").cast("string").alias("owner")]


HITS = "array<struct<kind:int,start:int,end:int,digest:string>>"
HIT = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string())]))


def _shown(found: list[tuple[int, int, int, str]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b, "digest": digest(v)} for k, a, b, v in found]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(row, repo, owner, doc_id, hits) for every row; a hit has kind, start, end and the value's digest, not the value."""
    rows = docs.select(*_holders(docs, repo_col, owner_col), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        return {"hits": pa.array([_shown(candidates(t.as_py())) for t in texts], HIT)}

    return map_texts(rows, "text", f"hits {HITS}", kernel, keep=False)


def ownership(scanned: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(digest, n_repos, n_owners, live): distinct holders of each candidate; null counts as one holder.

    A value is live if at most `max_owners` owners and `max_repos` repositories hold it: one that many owners have, or
    that one owner has all over its repositories, is a copied example. Pairs are made distinct before the shuffle, so a
    value that a third of all rows hold is one row a task.
    """
    hits = scanned.where(F.size("hits") > 0).select(F.explode("hits.digest").alias("digest"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"))
    count = lambda who: hits.select("digest", who).distinct().groupBy("digest").agg(F.count("*").alias(f"n_{who}s"))
    held = count("repo").join(count("owner"), "digest")
    return held.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repos: int = 100) -> DataFrame:
    """One row per row of docs: doc_id and its spans array<struct<start, order, kind, end, n_repos, n_owners, live>>.

    Base matches are always spans. An opaque run is one only if ownership() finds its value live anywhere in the
    corpus. `live` tells the same of every span. Spans are ordered by start, then kind; null and empty texts have none,
    repeated rows each their own, an empty table gives none. Other columns of docs are left behind.
    """
    scanned = stored(scan(docs, id_col, text_col, repo_col, owner_col), "secret-scan")
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    judged = hits.join(ownership(scanned, max_owners, max_repos), "digest").where((F.col("kind") < 3) | F.col("live"))
    span = F.struct("start", F.col("kind").alias("order"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"), "end", "n_repos", "n_owners", "live")
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.expr("array()").cast(spans.schema["spans"].dataType)
    return scanned.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def written(spans: F.Column) -> F.Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repos: int = 100, mask: str = "*") -> DataFrame:
    """docs, all rows and columns, with every character of the spans of find_secrets() masked, so offsets stay.

    The pass that finds candidates masks base matches in the row that it holds, so ids, null or repeated, play no part;
    only rows with opaque runs, which the whole corpus must judge, meet the verdicts, by a key of their own. Null and
    empty texts and texts without secrets are untouched; columns of any name stay as they are.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    rows = docs.select(*_holders(docs, repo_col, owner_col), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        clean, hits = [], []
        for t in texts.to_pylist():
            found = candidates(t)
            clean.append(masked(t, [(a, b) for k, a, b, _ in found if k < 3], mask) if found else t)
            hits.append(_shown(found))
        return {"clean": pa.array(clean, pa.string()), "hits": pa.array(hits, HIT)}

    scanned = stored(map_texts(rows, names[at], f"clean string, hits {HITS}", kernel, keep=False), "secret-texts")
    opaque = F.filter("hits", lambda h: h["kind"] == 3)
    open_ = scanned.where(F.size(opaque) > 0)
    runs = open_.select("row", F.explode(opaque).alias("h")).select("row", "h.*")
    held = ownership(scanned, max_owners, max_repos).where("live").select("digest")
    cuts = runs.join(held, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [masked(t, [(c["start"], c["end"]) for c in cs], mask) if cs else t for t, cs in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))], names=names)

    own = [F.col("clean").alias(n) if k == at else F.col(n) for k, n in enumerate(names)]
    shape = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).schema
    judged = open_.join(cuts, "row", "left").select(*own, "cuts").mapInArrow(cut, shape)
    return scanned.where(F.size(opaque) == 0).select(*own).union(judged).toDF(*docs.columns)
