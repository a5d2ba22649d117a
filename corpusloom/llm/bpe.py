"""Byte-level BPE by prefix-sharing trie traversal, and its decoder."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.pieces import ASCII_WHITE, Memory, as_binary, flat, give_back, windows
from corpusloom.runtime import ship

#: The white space of the tokenizers' pattern (Unicode White_Space).
SPACE = " \\t\\n\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
DEFAULT_VOCABULARY = os.environ.get("CORPUSLOOM_BPE", "byte_bpe_50k.json")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where a tokenizer file is on this machine: a path as it is, a bare name from the installed vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str | None = None) -> int:
    """One more than the largest id of a tokenizer file."""
    model = json.load(open(path or vocabulary_path(), encoding="utf-8"))
    return 1 + max([*model["model"]["vocab"].values(), *(x["id"] for x in model["added_tokens"])])


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class TrieEncoder:
    """Encodings of words through the trie that they form.

    A trie node is a byte prefix; its state is the last token of the prefix's encoding. The encoding of a prefix
    that ends in token t is that of the prefix before t, then t; a token can follow another just if no merge crosses
    the border between them. So a node's state needs the states of its ancestors alone, and words that share a
    prefix share its states. Words are visited in sorted order, which is the trie's depth-first order; the stack
    holds the states of the current path.
    """

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        letters = {c: b for b, c in byte_letters().items()}
        spec = {x["content"] for x in model["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in model["added_tokens"]}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = model["model"]["vocab"]
        self.ids = {as_bytes(s): i for s, i in vocab.items() if s not in spec}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for word, i in self.ids.items():
            self.bytes[i] = word
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.ids[a + b]
            self.merges[self.ids[a], self.ids[b]] = rank, whole
            self.made.setdefault(whole, (rank, self.ids[a], self.ids[b]))
        #: Every end of a token, with the token that it is by itself, or -1. A token that the merges don't reach is none.
        self.tails = dict.fromkeys((w[k:] for w in self.ids for k in range(1, len(w))), -1)
        self.tails |= {w: i if self.merged(w) == [i] else -1 for w, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[int]:
        """The plain merge loop, the definition that the trie's states follow."""
        ids = [self.ids[bytes((b,))] for b in word]
        while len(ids) > 1:
            ranked = [(self.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
            if not ranked:
                break
            _, k = min(ranked)
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that lie at one edge of a token as it is built, each with the rank of the merge that takes it."""
        out, until = [], inf
        while True:
            out.append((token, until))
            if token not in self.made:
                return out[::-1]
            until = self.made[token][0]
            token = self.made[token][side]

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of two adjacent tokens."""
        if (known := self.pairs.get(a << 32 | b)) is not None:
            return known
        left, right, i, j, ok = self._edge(a, 2), self._edge(b, 1), 0, 0, True
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.merges.get((x, y), (inf,))[0]
            if rank < x_ends and rank <= y_ends:
                ok = False
                break
            if x_ends == inf and y_ends == inf:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        if len(self.pairs) > 300_000:
            self.pairs.clear()
        self.pairs[a << 32 | b] = ok
        return ok

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list]:
        """Token ids of distinct words; the states of a shared prefix are found once."""
        out: dict[bytes, list] = {}
        last, before = [-1], b""
        tail_of, known, fits, lengths = self.tails.get, self.pairs.get, self.fits, [len(x) for x in self.bytes]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                while True:
                    token = tail_of(word[start:end])
                    if token >= 0:
                        if not start:
                            break
                        pair = last[start] << 32 | token
                        if known(pair) or known(pair) is None and fits(last[start], token):
                            break
                    start -= 1
                last.append(token)
            at, back = len(word), []
            while at:
                token = last[at]
                back.append(token)
                at -= lengths[token]
            back.reverse()
            out[word] = back
            before = word
        return out


ALNUM = np.zeros(256, bool)
ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
MARK = ~ALNUM & (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)


def _wide_white() -> dict[int, np.ndarray]:
    """By length in bytes, the white characters beyond ASCII as big-endian numbers."""
    found = [m for m in re.findall(f"[{SPACE}]", "".join(map(chr, range(0x80, 0x3001))))]
    return {n: np.array([int.from_bytes(c.encode(), "big") for c in found if len(c.encode()) == n]) for n in (2, 3)}


WIDE_WHITE = _wide_white()


def white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte is of a white character, that character's length in bytes where it begins, else 0)."""
    is_white = ASCII_WHITE[data]
    width = is_white.astype(np.int64)
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if len(lead):
        padded = np.append(data, np.zeros(2, np.uint8)).astype(np.int64)
        two = padded[lead] << 8 | padded[lead + 1]
        for n, code in ((2, two), (3, two << 8 | padded[lead + 2])):
            found = lead[np.isin(code, WIDE_WHITE[n])]
            width[found] = n
            for k in range(n):
                is_white[found + k] = True
    return is_white, width


def cuts(data: np.ndarray, borders: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Where pieces begin that are encoded alike alone and in the text; `spans` are pieces whole.

    The tokenizers' pattern always has a border where white space begins; before the last white character in front of a
    word, and after it unless it is a space; and where a letter or digit meets a mark. The latter is seen in ASCII only.
    """
    n = len(data)
    is_white, width = white(data)
    edge = np.zeros(n + 1, bool)
    edge[borders] = True
    for span in spans:
        edge[list(span)] = True
    out = edge.copy()
    out[1:n] |= is_white[1:] & ~is_white[:-1]
    out[1:n] |= MARK[data[1:]] & ALNUM[data[:-1]]
    first = np.flatnonzero(width)
    after = first + width[first]
    last = ~edge[after] & ~np.append(is_white, False)[after]
    out[first[last]] = True
    out[after[last & (data[first] != 0x20)]] = True
    for a, b in spans:
        out[a + 1 : b] = False
    return np.flatnonzero(out[:n])


class Codec:
    """Columns of texts to ids and back. Pieces are encoded once while they are remembered.

    `engine` "trie" encodes the distinct words of new pieces with TrieEncoder; "library" has the tokenizers library
    encode the new pieces, many at a time as lines. Both give the library's ids of the whole text.
    """

    def __init__(self, path: str, engine: str = "trie", kind: pa.DataType = pa.int32(), remember: int = 500_000):  # noqa: B008
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of a worker's machine are parallel already
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.trie = TrieEncoder(path)
        self.kind = kind
        self.memory = Memory(self._by_library if engine == "library" else self._by_trie, remember)
        self.spelled = pa.array(self.trie.bytes, pa.binary())
        #: Pieces of Latin letters, digits and ASCII marks but the apostrophe, whose words need no pattern of Unicode classes.
        latin, marks = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "!-&(-/:-@\\[-`{-~"
        self.plain = re.compile(f"[ \n]?[{latin}0-9{marks}]+").fullmatch
        self.words = re.compile(f" ?[{latin}]+| ?[0-9]+| ?[{marks}]+|\n").findall
        self.letters = {c: b for b, c in byte_letters().items()}
        self.added = {s.encode(): i for s, i in self.trie.added.items()}
        self.marked = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))).finditer if self.added else None
        self.line_end = self.trie.ids[b"\n"]
        #: An added token with white space might be cut by a window, so texts are then taken whole.
        self.window = 1 << 62 if any(re.search(f"[{SPACE}]", s) for s in self.trie.added) else 4 << 20

    def _words(self, piece: str) -> list[bytes]:
        if self.plain(piece):
            return [w.encode() for w in self.words(piece)]
        return [bytes(self.letters[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def _lists(self, ids: list) -> pa.ListArray:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        values = np.fromiter(chain.from_iterable(ids), self.kind.to_pandas_dtype(), int(sizes.sum()))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, self.kind))

    def _by_trie(self, new: pa.Array) -> pa.ListArray:
        split = [[p] if p in self.added else self._words(p.decode()) for p in new.to_pylist()]
        ids = self.trie.encode_words({w for s in split for w in s if w not in self.added})
        ids.update((w, [i]) for w, i in self.added.items())
        return self._lists([ids[s[0]] if len(s) == 1 else [*chain.from_iterable(ids[w] for w in s)] for s in split])

    def _by_library(self, new: pa.Array) -> pa.ListArray:
        """Words go to the library as lines of short texts: a lone line end is a word and a token of its own before any
        of them, so its ids part theirs. White space and added tokens go alone."""
        data, borders = flat(new)
        line = ~white(data)[0][borders[1:] - 1] if len(data) else np.zeros(0, bool)
        line &= ~pc.is_in(new, value_set=pa.array(self.added, pa.binary())).to_numpy(zero_copy_only=False)
        solid, alone = new.filter(pa.array(line)), new.filter(pa.array(~line))
        borders = np.append(np.arange(0, len(solid), 256), len(solid)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders), solid.cast(pa.string())), "\n").to_pylist() if len(solid) else []
        made = [np.zeros(0, np.int64)]
        for at in range(0, len(lines), 64):
            made += [np.array(e.ids, np.int64) for e in self.library.encode_batch_fast([x + "\n" for x in lines[at : at + 64]], add_special_tokens=False)]
        ids = np.concatenate(made)
        ends = np.flatnonzero(ids == self.line_end) - np.arange(len(solid))
        first = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids[ids != self.line_end], self.kind))
        rest = self._lists([e.ids for e in self.library.encode_batch_fast(alone.cast(pa.string()).to_pylist(), add_special_tokens=False)] if len(alone) else [])
        order = np.empty(len(new), np.int64)
        order[np.append(np.flatnonzero(line), np.flatnonzero(~line))] = np.arange(len(new))
        return pa.concat_arrays([first, rest]).take(pa.array(order))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; null is as empty."""
        data, borders = flat(texts)
        values, counts = [pa.array([], self.kind)], np.zeros(len(texts), np.int64)
        for part, at, first in windows(data, borders, self.window):
            spans = [m.span() for m in self.marked(part)] if self.marked else []
            starts = cuts(part, at, [(a, b) for a, b in spans if not ((at > a) & (at < b)).any()])
            pieces = as_binary(part, starts).dictionary_encode()
            lists = self.memory.of(pieces.dictionary).take(pieces.indices)
            values.append(lists.flatten())
            counts[first : first + len(at) - 1] += np.diff(lists.offsets.to_numpy()[np.searchsorted(starts, at)])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.concat_arrays(values))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids, special tokens kept; bytes that are not UTF-8 become U+FFFD, null is as empty."""
        if ids.null_count:
            ids = pa.array([x or [] for x in ids.to_pylist()], ids.type)
        if not len(ids):
            return pa.array([], pa.string())
        sizes = ids.value_lengths().to_numpy()
        data, borders = flat(self.spelled.take(ids.flatten()))
        ends = borders[np.append(0, np.cumsum(sizes))].astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([x.decode("utf-8", "replace") for x in out.cast(pa.binary()).to_pylist()], pa.string())
        return out


_codecs: dict[tuple, Codec] = {}


def codec(path: str, engine: str = "trie", kind: pa.DataType = pa.int32()) -> Codec:  # noqa: B008
    """One codec for each Python worker."""
    key = (path, engine, str(kind))
    if key not in _codecs:
        _codecs[key] = Codec(path, engine, kind)
    return _codecs[key]


def slices(texts: list, most: int = 2_000_000) -> Iterator[list]:
    """Runs of texts of about `most` characters, so that what a batch expands to stays small."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def map_texts(df: DataFrame, text_col: str, extra: str, kernel: Callable[[pa.Array], dict[str, pa.Array]], keep: bool = True) -> DataFrame:
    """All columns of df (without the text if not `keep`), then those of `extra` that kernel makes of a batch of texts."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    kept = [k for k in range(len(df.columns)) if keep or k != at]
    names = [df.columns[k] for k in kept]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            made = kernel(b.column(at))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *made.values()], names=[*names, *made])

    return df.mapInArrow(of_batches, ", ".join([*(f"`{df.columns[k]}` {df.schema[k].dataType.simpleString()}" for k in kept), extra]))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores added until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """All rows and columns of df with the token ids of the text, array<int>; null and empty give no ids.

    A clashing column of df keeps its name; the ids' name then gets an underscore.
    """
    path, ids_col = path or vocabulary_path(), free_name(df, ids_col)

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        return {ids_col: codec(path).encode(texts)}

    return map_texts(df, text_col, f"`{ids_col}` array<int>", kernel, keep_text)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, text_col: str = "decoded") -> DataFrame:
    """All rows and columns of df with the text of the ids; null ids give an empty text."""
    path, text_col = path or vocabulary_path(), free_name(df, text_col)

    def kernel(ids: pa.Array) -> dict[str, pa.Array]:
        return {text_col: codec(path).decode(ids)}

    return map_texts(df, ids_col, f"`{text_col}` string", kernel)


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """encode() and then decode() of its ids, in one Python worker: all columns of df with `ids` and `decoded`."""
    path, ids_col, out_col = path or vocabulary_path(), free_name(df, "ids"), free_name(df, "decoded")

    def kernel(texts: pa.Array) -> dict[str, pa.Array]:
        ids = codec(path).encode(texts)
        return {ids_col: ids, out_col: codec(path).decode(ids)}

    return map_texts(df, text_col, f"`{ids_col}` array<int>, `{out_col}` string", kernel, keep_text)


def with_digests(encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded") -> list[F.Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    ids = F.col(ids_col)
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(ids.cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col(text_col), "UTF-8"), 256).alias("decoded_sha256"),
    ]
