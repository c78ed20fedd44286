"""Character n-grams of many texts at once, hashed to buckets.

Texts are lower-cased; letters (and, if asked, digits) stay, every other run of
characters is one space.  An n-gram lies inside a word with the space before
and behind it.  Texts longer than ``CHUNK`` are cut at a space, which changes no
n-gram.
"""

from __future__ import annotations

import numpy as np

from limnos.llm.textops import splitmix

CHUNK = 1 << 18
_tables: dict[bool, np.ndarray] = {}


def _kept(digits: bool) -> np.ndarray:
    if digits not in _tables:
        test = str.isalnum if digits else str.isalpha
        _tables[digits] = np.array([test(chr(c)) for c in range(0x110000)])
    return _tables[digits]


def _pieces(text: str):
    lo = 0
    while len(text) - lo > CHUNK:
        at = text.find(" ", lo + CHUNK)
        if at < 0:
            break
        yield text[lo:at]
        lo = at
    yield text[lo:]


def groups(texts):
    """Yield (rows, pieces): consecutive pieces of texts of about ``CHUNK`` characters in all."""
    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        for piece in _pieces(text.lower()):
            rows.append(row)
            held.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


class Chars:
    """Normalised characters of a group of pieces: ``code`` (32: space), ``piece`` and ``word`` of each
    character that is kept; ``word`` counts from 0 in each piece."""

    def __init__(self, pieces, digits: bool = False):
        joined = " " + " ".join(pieces) + " "
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.array([len(p) + 1 for p in pieces]))      # place of the space behind each piece
        inside = _kept(digits)[cp]
        keep = inside.copy()
        keep[1:] |= ~inside[1:] & inside[:-1]
        keep[0] = True
        place = np.flatnonzero(keep)
        self.code = np.where(inside[place], cp[place], 32).astype(np.uint32)
        self.space = ~inside[place]
        self.piece = np.searchsorted(ends, place)
        opens = np.zeros(len(place), bool)
        opens[1:] = ~self.space[1:] & self.space[:-1]
        count = np.cumsum(opens)
        at_first = np.searchsorted(self.piece, np.arange(len(pieces)))
        base = np.append(count, count[-1] if len(count) else 0)[np.maximum(at_first - 1, 0)]
        base[at_first == 0] = 0
        self.word = count - 1 - base[np.minimum(self.piece, len(pieces) - 1)]
        self.opens = opens

    def grams(self, n: int):
        """(bucket source hash, place of the first kept letter) of every n-gram."""
        m = len(self.code) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        good = np.ones(m, bool)
        for k in range(1, n - 1):
            good &= ~self.space[k:k + m]
        if n == 1:
            good &= ~self.space[:m]
        h = np.full(m, (0x9E3779B1 * n) & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ self.code[k:k + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        at = np.flatnonzero(good)
        return h[at], at + self.space[at]

    def words(self):
        """(hash, place of the first letter) of every word."""
        first = np.flatnonzero(self.opens)
        if not len(first):
            return np.zeros(0, np.uint32), first
        end = np.flatnonzero(self.space[1:] & ~self.space[:-1]) + 1
        h = _run_hashes(splitmix(self.code.astype(np.uint64)), first, end)
        return (h >> np.uint64(32)).astype(np.uint32), first


_BASE = 0x9E6C63D0876A9A47 | 1


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each values[start:end]; only names feature buckets, in which words meet anyway."""
    powers = [np.full(len(values) + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    for p in powers:
        p[0] = 1
    up, down = map(np.multiply.accumulate, powers)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return splitmix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)).astype(np.int64)
