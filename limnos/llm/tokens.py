"""Token ids of many texts with a vocabulary file of the ``tokenizers`` library.

Both public BPE files encode each pre-token (piece) on its own, and a corpus
repeats its pieces.  Pieces are found and hashed with numpy over a slice of
texts at a time, each distinct piece is encoded once per Python worker by the
library and kept in a table of bounded size, and the ids of a text are
gathered from there.  A slice tells its pieces apart by 64-bit hashes (up to 4
characters without collision); a piece met again in the table is compared with
the stored one, and a text for which that fails goes through the library whole.
So do texts with characters outside the plain ranges below,
or with a special token's string, and every text when the file has another
pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from limnos.llm.textops import byte_hashes  # noqa: E402

CHUNK = 1 << 18          # characters handled at once
MAX_PIECES = 400_000   # distinct pieces kept per worker
_TOP = 0x250
LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 4, 5
#: Fixed value: the word pattern of the word-level file (whitespace is dropped before it applies).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _classes() -> np.ndarray:
    """Class of each plain character; 0 = handled by the library itself."""
    t = np.zeros(_TOP + 1, np.uint8)
    for c in range(_TOP):
        kind = unicodedata.category(chr(c))
        if chr(c) in " \t\n\r\x0b\x0c":
            t[c] = SPACE
        elif kind[0] == "C" or c == 0xA0 or c == 0x130:
            t[c] = 0
        elif kind[0] == "L":
            t[c] = LETTER
        elif kind[0] == "N":
            t[c] = NUMBER
        else:
            t[c] = OTHER
    t[0] = END
    return t


def _shown() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


_CLASS, _SHOWN = _classes(), _shown()


def read_tokenizer(path: str) -> str:
    """The vocabulary file's JSON text (a few MB, sent to the workers with the job)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _style(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
        return "byte"
    steps = pre.get("pretokenizers", [])
    if len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN and not steps[1].get("use_regex"):
        kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        if kinds == ["NFC", "Replace", "Lowercase"]:
            return "word"
    return "plain"


def _put(table: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``values`` written at ``at``; the table doubles where it is too short."""
    if at + len(values) > len(table):
        grown = np.zeros(max(2 * len(table), at + len(values)), table.dtype)
        grown[:at] = table[:at]
        table = grown
    table[at:at + len(values)] = values
    return table


class TextEncoder:
    """encode(texts) -> (all ids in order, ids per text)."""

    def __init__(self, spec_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(spec_json)
        self.tok = Tokenizer.from_str(spec_json)
        self.model = self.tok.model
        self.style = _style(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)      # sorted
        self.slot = np.zeros(0, np.int64)       # place of each key in the three below, filled in the order of arrival
        self.at = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.piece = np.zeros(1 << 12, object)
        self.store = np.zeros(1 << 16, np.uint32)
        self.used = 0

    # ------------------------------------------------------------ public

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], np.zeros(len(texts), np.int64)
        group, rows, size = [], [], 0
        for r, text in enumerate(texts):
            for part in self._parts(text or ""):
                group.append(part)
                rows.append(r)
                size += len(part)
                if size >= CHUNK:
                    self._flush(group, rows, ids, counts)
                    group, rows, size = [], [], 0
        self._flush(group, rows, ids, counts)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), counts

    def _flush(self, group, rows, ids, counts) -> None:
        if group:
            flat, n = self._encode_group(group)
            ids.append(flat)
            np.add.at(counts, rows, n)

    @staticmethod
    def _parts(text: str):
        """Cut a very long text before single spaces, where a piece always starts."""
        lo = 0
        while len(text) - lo > CHUNK:
            at = text.find(" ", lo + CHUNK)
            while at > 0 and (text[at - 1].isspace() or at + 1 >= len(text) or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if at <= 0:
                break
            yield text[lo:at]
            lo = at
        if lo < len(text):
            yield text[lo:]

    def _plain(self, texts) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    # ------------------------------------------------------------ pieces

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces of plain characters (none holds a NUL), straight from the file's BPE model."""
        if self.style == "word":
            pieces = [x.lower() for x in pieces]
        shown = "\x00".join(pieces).encode().decode("latin-1").translate(_SHOWN).split(chr(_SHOWN[0]))
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(x)] for x in shown]

    def _encode_group(self, group) -> tuple[np.ndarray, np.ndarray]:
        if self.style == "plain":
            out = self._plain(group)
            return np.concatenate(out), np.array([len(x) for x in out])
        whole = [("\x00" in t) or any(s in t for s in self.special) for t in group]
        joined = "\x00".join("" if w else t for t, w in zip(group, whole, strict=True)) + "\x00"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cp = np.minimum(cp, _TOP)
        cls = _CLASS[cp]
        seg_end = np.flatnonzero(cls == END)
        odd = np.searchsorted(seg_end, np.flatnonzero(cls == 0))
        for k in np.unique(odd):
            whole[k] = True
        whole = np.array(whole)

        start = self._starts(cp, cls)
        pos = np.flatnonzero(start)
        end = np.append(pos[1:], len(cp))
        kind = cls[pos]
        seg = np.searchsorted(seg_end, pos)
        keep = (kind != END) & ~whole[np.minimum(seg, len(whole) - 1)]
        if self.style == "word":
            keep &= kind != SPACE
        pos, end, seg = pos[keep], end[keep], seg[keep]
        n = np.zeros(len(group), np.int64)
        flat = np.zeros(0, np.uint32)
        if len(pos):
            key = byte_hashes(cp.astype("<u2").view(np.uint8), 2 * pos, 2 * end)
            uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
            other = self._learn(joined, uniq, pos[first], end[first])
            if len(other):
                whole[seg[np.isin(back, other)]] = True
                keep = ~whole[seg]
                back, seg = back[keep], seg[keep]
            at = self.slot[np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)][back]
            size, begin = self.size[at], self.at[at]
            n = np.bincount(seg, weights=size, minlength=len(group)).astype(np.int64)
            shift = np.cumsum(size) - size
            flat = self.store[np.repeat(begin - shift, size) + np.arange(int(size.sum()))]
        if whole.any():
            todo = np.flatnonzero(whole)
            own = dict(zip(todo.tolist(), self._plain([group[k] for k in todo]), strict=True))
            cuts = np.concatenate([[0], np.cumsum(n)])
            parts = [own.get(k, flat[cuts[k]:cuts[k + 1]]) for k in range(len(group))]
            flat, n = np.concatenate(parts), np.array([len(x) for x in parts])
        return flat, n

    def _starts(self, cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """True where a piece starts.  A NUL ends each text."""
        prev = np.empty_like(cls)
        prev[0], prev[1:] = END, cls[:-1]
        nxt = np.empty_like(cls)
        nxt[-1], nxt[:-1] = END, cls[1:]
        space, turn = cls == SPACE, cls != prev
        if self.style == "word":
            start = turn | (cls == NUMBER)
        else:
            after_blank = np.zeros(len(cp), bool)
            after_blank[1:] = cp[:-1] == 32
            start = turn & (space | (cls == END) | ~after_blank)
            # the last of several white-space characters stands alone or joins the next piece
            start |= space & (prev == SPACE) & (nxt != SPACE) & (nxt != END)
        start |= cls == END
        self._contractions(cp, cls, start)
        return start

    def _contractions(self, cp, cls, start) -> None:
        """'s 't 'm 'd 're 've 'll split off where the apostrophe starts a piece."""
        quote = np.flatnonzero((cp == 39) & start)
        quote = quote[quote + 2 < len(cp)]
        if not len(quote):
            return
        a, b = cp[quote + 1], cp[quote + 2]
        if self.style == "word":
            a, b = (np.where((x >= 65) & (x <= 90), x + 32, x) for x in (a, b))
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            start[q + 1] = False
            tail = q + 1 + size
            start[tail[cls[tail] == LETTER]] = True

    def _learn(self, joined: str, uniq, first, last) -> np.ndarray:
        """Encode pieces not seen before and merge them into the sorted table; returns the places of
        those whose key belongs to another piece there."""
        if len(self.keys) + len(uniq) > MAX_PIECES:
            self._reset()
        at = np.searchsorted(self.keys, uniq)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == uniq[known]
        old, new = np.flatnonzero(known), np.flatnonzero(~known)
        met = [joined[a:b] for a, b in zip(first[old].tolist(), last[old].tolist(), strict=True)]
        held = self.piece[self.slot[at[old]]].tolist()
        other = old[[x != y for x, y in zip(met, held, strict=True)]] if met else old
        if not len(new):
            return other
        pieces = [joined[a:b] for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)]
        ids = self._pieces(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        begin = self.used + np.cumsum(size) - size
        self.store = _put(self.store, self.used, flat)
        self.used += len(flat)
        count = len(self.keys)
        added = np.empty(len(pieces), object)
        added[:] = pieces
        self.at, self.size, self.piece = (_put(t, count, v) for t, v in (
            (self.at, begin), (self.size, size), (self.piece, added)))
        self.keys = np.insert(self.keys, at[new], uniq[new])
        self.slot = np.insert(self.slot, at[new], count + np.arange(len(new)))
        return other


_encoders: dict[int, TextEncoder] = {}


def encoder(spec_json: str) -> TextEncoder:
    """One encoder per worker and file, so its table serves all the worker's tasks."""
    key = zlib.crc32(spec_json.encode())
    if key not in _encoders:
        _encoders[key] = TextEncoder(spec_json)
    return _encoders[key]
