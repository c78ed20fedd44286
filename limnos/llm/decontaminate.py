"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters.  A test
item gives every window of ``n`` consecutive words; an item with fewer words,
but some, is one window of all its words.  The windows' hashes are broadcast in
blocks of at most ``max_windows`` (a fixed bound; a larger benchmark gives more
blocks, each scanned in its own pass over the corpus).  A scan hashes every
word window of a text, looks it up, and verifies each hit by comparing words.

Defined results: NULL and empty texts have no words and no hits; an item
without words matches nothing; equal windows of several items hit all of them;
a NULL item_id reads ``null``; repeated documents each get a row; an empty
benchmark flags nothing; other columns are ignored by ``scan`` and kept by
``remove_documents``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.runtime import cut_lineage, ship
from limnos.llm.textops import window_hashes, word_slices, word_table

N, MAX_WINDOWS = 10, 1_000_000
SEEN = "doc_id long, text string, n_words long, hits array<struct<start:long,words:long,item:string>>, kept "
RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
          "contaminated boolean, spans array<struct<start:long,end:long>>, clean_text string, kept ")


def _plain(data: np.ndarray) -> bytes:
    return data.tobytes().lower()


def _joined(data, starts, ends, lo, hi) -> bytes:
    """Words lo..hi-1, lower-cased and joined by a space."""
    return b" ".join(_plain(data[starts[k]:ends[k]]) for k in range(lo, hi))


def item_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, words, window, item) of every window of every item, distinct."""
    ship(benchmark.sparkSession)

    def run(batches):
        is_word = word_table("alnum")
        for batch in batches:
            items = batch.column(0).to_pylist()
            for row, _, counts, s, e, h, data in word_slices(batch.column(1), is_word):
                out, at = [], 0
                for k, count in enumerate(counts.tolist()):
                    size = min(n, count)
                    if size:
                        hashes = window_hashes(h[at:at + count], size).view(np.int64)
                        out += [(int(x), size, _joined(data, s, e, at + i, at + i + size), items[row + k])
                                for i, x in enumerate(hashes)]
                    at += count
                if out:
                    a, b, c, d = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary()),
                         pa.array(d, pa.string())], names=["hash", "words", "window", "item"])

    narrow = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("null")).alias("item"),
                              benchmark[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, "hash long, words int, window binary, item string").distinct()


def _blocks(windows: DataFrame, max_windows: int):
    """The windows as lists of at most about ``max_windows`` rows, split by hash."""
    total = windows.count()
    parts = max(1, -(-2 * total // max_windows)) if total > max_windows else 1
    for k in range(parts):
        block = windows.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == k) if parts > 1 else windows
        yield block.collect()   # bounded by max_windows


def _match(words_by_size, table, counts, s, e, h, data):
    """(row, first word, words, item) of every verified hit in a slice."""
    row_of = np.repeat(np.arange(len(counts)), counts)
    out = []
    for size, known in words_by_size:
        w = window_hashes(h, size).view(np.int64)
        if not len(w):
            continue
        at = np.minimum(np.searchsorted(known, w), len(known) - 1)
        for i in np.flatnonzero((known[at] == w) & (row_of[:len(w)] == row_of[size - 1:])).tolist():
            found = _joined(data, s, e, i, i + size)
            out += [(int(row_of[i]), i, size, item) for window, item in table[(size, int(w[i]))] if window == found]
    return out


def _scan_pass(docs: DataFrame, block) -> DataFrame:
    """One pass over (doc_id, text, n_words, hits, kept): adds the block's hits."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast([(r["hash"], r["words"], bytes(r["window"]), r["item"]) for r in block])

    def run(batches):
        is_word, table = word_table("alnum"), {}
        for x, size, window, item in shared.value:
            table.setdefault((size, x), []).append((window, item))
        sizes = sorted({size for size, _ in table})
        known = [(z, np.array(sorted(x for size, x in table if size == z), np.int64)) for z in sizes]
        for batch in batches:
            hits = [list(x or []) for x in batch.column(3).to_pylist()]
            n_words = np.zeros(batch.num_rows, np.int64)
            for row, stop, counts, s, e, h, data in word_slices(batch.column(1), is_word):
                n_words[row:stop] = counts
                first = np.cumsum(counts) - counts
                for k, i, size, item in _match(known, table, counts, s, e, h, data):
                    hits[row + k].append({"start": int(i - first[k]), "words": size, "item": item})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words), pa.array(hits, HITS), batch.column(4)],
                names=["doc_id", "text", "n_words", "hits", "kept"])

    return docs.mapInArrow(run, SEEN + docs.schema["kept"].dataType.simpleString())


HITS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item", pa.string())]))


def _summary(docs: DataFrame, with_text: bool) -> DataFrame:
    """Hits -> counts, items, hit spans (code points) and the text without them."""

    def run(batches):
        is_word = word_table("alnum")
        for batch in batches:
            hits = batch.column(3).to_pylist()
            rows = []
            texts = batch.column(1)
            for k, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = hits[k]
                if not found:
                    rows.append((doc, n, 0, 0, [], EMPTY, False, [], texts[k].as_py() if with_text else None))
                    continue
                _, _, _, s, e, _, data = next(word_slices(texts.slice(k, 1), is_word))
                mark = np.zeros(n + 1, np.int64)
                for x in found:
                    mark[x["start"]] += 1
                    mark[x["start"] + x["words"]] -= 1
                covered = np.cumsum(mark[:n]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                cuts = [(int(s[a]), int(e[b - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                spans = [{"start": int(point[a]), "end": int(point[b])} for a, b in cuts]
                text = None
                if with_text:
                    bounds = [0, *(x for c in cuts for x in c), len(data)]
                    text = b"".join(data[a:b].tobytes() for a, b in zip(bounds[::2], bounds[1::2], strict=True)).decode()
                items = sorted({x["item"] for x in found})
                digest = hashlib.sha256(",".join(items).encode()).hexdigest()
                rows.append((doc, n, int(covered.sum()), len(items), items, digest, True, spans, text))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), batch.column(4)],
                names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.mapInArrow(run, RESULT + docs.schema["kept"].dataType.simpleString())


EMPTY = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per document: n_words, n_hit (words inside a hit window), n_items, items and
    their digest, contaminated, hit spans, ``clean_text`` (the text without the spans, if
    asked) and ``kept`` (a struct of the columns named in ``keep``)."""
    windows = cut_lineage(item_windows(benchmark, n, item_col, item_text_col))
    kept = F.struct(*(docs[c] for c in keep)) if keep else F.lit(None).cast("int")
    state = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                        F.lit(0).cast("long").alias("n_words"),
                        F.lit(None).cast("array<struct<start:long,words:long,item:string>>").alias("hits"),
                        kept.alias("kept"))
    for block in _blocks(windows, max_windows):
        state = _scan_pass(state, block)
    return _summary(state, with_text)


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     **options) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    others = [c for c in docs.columns if c != text_col]
    found = scan(docs, benchmark, id_col=id_col, text_col=text_col, with_text=True, keep=others, **options)
    return found.where(~F.col("contaminated")).select(
        *(F.col("clean_text" if c == text_col else f"kept.`{c}`").alias(c) for c in docs.columns))
