"""Vectorised word and window hashing over Arrow string buffers.

Words are maximal runs of bytes that a 256-entry table marks as word bytes;
A-Z hash like a-z.  All words of a buffer are hashed together, 8 bytes at a time.
Work is done in slices of at most ``SLICE`` bytes, whatever the row count or
the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(_U, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_places: dict[str, np.ndarray] = {"factor": np.zeros(0, _U)}


def place_factors(n: int) -> np.ndarray:
    """Random odd factors of the places 0..n-1 of a span (cached)."""
    if len(_places["factor"]) < n:
        size = max(n, 2 * len(_places["factor"]), 1 << 12)
        _places["factor"] = splitmix(np.arange(size, dtype=_U) + _U(0x2545F4914F6CDD1D)) | _U(1)
    return _places["factor"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end] of 64-bit values; equal spans hash alike wherever they stand.

    A multilinear hash: the sum of value times the random factor of its place in the span.  (A
    polynomial modulo 2**64 is not enough: the two Thue-Morse words of 1024 letters collide in
    every base.)  Spans are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, _U)
    sizes = (ends - starts).astype(np.int64)
    lead = int(starts[0])
    held = values[lead:]
    place = np.arange(len(held)) - np.repeat(starts - lead, np.diff(np.append(starts, len(values))))
    total = np.zeros(len(held) + 1, _U)
    # values behind a span do not count, whatever their factor
    np.cumsum(held * place_factors(int(sizes.max())).take(place, mode="clip"), out=total[1:])
    return splitmix((total[ends - lead] - total[starts - lead]) ^ (sizes.astype(_U) * _U(0xD6E8FEB86659FD93)))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
LONG = 512      # bytes of a span above which chunks are summed instead of chained


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end] of bytes, read in chunks of 8 that a nonlinear mix chains.

    Spans of one size up to 8 bytes never collide.  A span above ``LONG`` bytes sums its chunks
    times random factors of their places."""
    if not len(starts):
        return np.zeros(0, _U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))
    at, left = starts, ends - starts
    h = splitmix(left)
    todo = np.flatnonzero(left > LONG)
    for k in todo.tolist():
        lo, hi = int(starts[k]), int(ends[k])
        chunks = at_byte[lo:hi:8].copy()
        chunks[-1] &= _MASK[(hi - lo - 1) % 8 + 1]
        h[k] = splitmix(h[k:k + 1] ^ (chunks * place_factors(len(chunks))[:len(chunks)]).sum(dtype=_U))[0]
    mixed = splitmix(h ^ (at_byte[at] & _MASK[np.minimum(left, 8)]))
    mixed[todo] = h[todo]
    more = np.flatnonzero((left > 8) & (left <= LONG))
    k = 0
    while len(more):
        k += 8
        rest = left[more] - k
        mixed[more] = splitmix(mixed[more] ^ (at_byte[at[more] + k] & _MASK[np.minimum(rest, 8)]))
        more = more[rest > 8]
    return mixed


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(kind: str) -> np.ndarray:
    """``space``: all but space and 0x09-0x0D; ``alnum``: 0-9, a-z, A-Z and bytes from 0x80."""
    t = np.ones(256, bool)
    if kind == "space":
        t[[0x20, 9, 10, 11, 12, 13]] = False
    elif kind == "alnum":
        t[:128] = False
        t[48:58] = t[65:91] = t[97:123] = True
    else:
        raise ValueError(kind)
    return t


def _buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a string column (NULL counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    buf = col.buffers()
    off = np.frombuffer(buf[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    return off, data


def _words(data: np.ndarray, row_starts: np.ndarray, is_word: np.ndarray):
    """(start, end, hash) of the words of ``data``; no word crosses a row start."""
    w = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[row_starts] = True
    first[0] = True
    opened = w.copy()
    opened[1:] &= ~w[:-1] | first[1:len(data)]
    last = np.ones(len(data), bool)
    last[:-1] = ~w[1:] | first[1:len(data)]
    starts, ends = np.flatnonzero(opened), np.flatnonzero(w & last) + 1
    return starts, ends, byte_hashes(LOWER[data], starts, ends)


def _cut(data: np.ndarray, lo: int, hi: int, is_word: np.ndarray) -> int:
    """A place near lo + SLICE, within (lo, hi], at which no word is split."""
    at = lo + SLICE
    while at < hi:
        gaps = np.flatnonzero(~is_word[data[at:min(hi, at + SLICE)]])
        if len(gaps):
            return at + int(gaps[0])
        at += SLICE
    return hi


def word_slices(col, is_word: np.ndarray):
    """Yield (first row, row after the last, words per row, starts, ends, hashes, data).

    ``starts``/``ends`` are byte places in ``data``.  A row longer than ``SLICE``
    comes alone; its words are found piece by piece.
    """
    off, data = _buffers(col)
    n, row = len(off) - 1, 0
    while row < n:
        stop = int(np.searchsorted(off, off[row] + SLICE, "right")) - 1
        stop = min(n, max(stop, row + 1))
        lo, hi = int(off[row]), int(off[stop])
        if stop == row + 1 and hi - lo > SLICE:
            parts, at = [], lo
            while at < hi:
                end = _cut(data, at, hi, is_word) if hi - at > SLICE else hi
                s, e, h = _words(data[at:end], np.zeros(0, np.int64), is_word)
                parts.append((s + (at - lo), e + (at - lo), h))
                at = end
            s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            counts = np.array([len(s)])
        elif hi == lo:
            s = e = np.zeros(0, np.int64)
            h, counts = np.zeros(0, _U), np.zeros(stop - row, np.int64)
        else:
            s, e, h = _words(data[lo:hi], off[row:stop] - lo, is_word)
            counts = np.diff(np.searchsorted(s, off[row:stop + 1] - lo))
        yield row, stop, counts, s, e, h, data[lo:hi]
        row = stop


_WINDOW = splitmix(np.arange(1001, 1001 + 64, dtype=_U)) | _U(1)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of hashes[i:i+n] for every i with n words left (order and length matter)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    total = np.full(m, n, _U)
    for k in range(n):
        total += hashes[k:k + m] * _WINDOW[k]
    return splitmix(total)
