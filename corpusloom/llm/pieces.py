"""Texts cut on their UTF-8 bytes: whole columns at a time, and work on repeated pieces done once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ASCII_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, borders) of a string column: text k lies between borders k and k + 1; a null text is as empty."""
    column = column.fill_null("") if column.null_count else column
    _, at, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def windows(data: np.ndarray, borders: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, borders, number of the first text): runs of about `most` bytes, so that a long text is worked on in parts.

    A run ends with a text or before ASCII white space that follows another ASCII character.
    """
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + most)
        while end < n:
            if borders[np.searchsorted(borders, end)] == end:
                break
            part = data[end - 1 : end + (1 << 16)]
            found = np.flatnonzero(ASCII_WHITE[part[1:]] & ~ASCII_WHITE[part[:-1]] & (part[:-1] < 0x80))
            if len(found):
                end += int(found[0])
                break
            end = min(n, end + len(part) - 1)
        first = int(np.searchsorted(borders, at, side="right")) - 1
        last = int(np.searchsorted(borders, end, side="left"))
        yield data[at:end], np.clip(borders[first : last + 1], at, end) - at, first
        at = end


def give_back() -> None:
    """Return freed memory to the system: a Python worker serves many stages, and what one has freed is of no use to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def as_binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces of data that begin at each start and end at the next one, or with the data."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class Memory:
    """What was made of each piece, kept by a Python worker while there are at most `most` pieces of `longest` bytes.

    Longer pieces are worked on each time, so the memory is bounded in bytes; beyond `most` pieces it keeps those of
    the last call alone.
    """

    def __init__(self, make: Callable[[pa.Array], pa.Array], most: int = 500_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest
        self.values, self.made = None, None

    def of(self, distinct: pa.Array) -> pa.Array:
        """What is made of each of these distinct pieces."""
        if self.values is None:
            self.values, self.made = distinct.slice(0, 0), self.make(distinct.slice(0, 0))
        at = pc.index_in(distinct, value_set=self.values).fill_null(-1).to_numpy()
        unknown = at < 0
        new = distinct.filter(pa.array(unknown))
        made = self.make(new)
        at = np.where(unknown, len(self.values) + np.cumsum(unknown) - 1, at)
        out = pa.concat_arrays([self.made, made]).take(pa.array(at))
        if len(self.values) + len(new) > self.most:
            self.values, self.made, new, made = new.slice(0, 0), made.slice(0, 0), distinct, out
        short = pc.less_equal(pc.binary_length(new), self.longest)
        self.values = pa.concat_arrays([self.values, new.filter(short)])
        self.made = pa.concat_arrays([self.made, made.filter(short)])
        return out
