"""Removal of repeated passages by hashing normalised lines, paragraphs or sentences.

A text is cut into units: ``line`` (at line feeds), ``paragraph`` (at empty
lines) or ``sentence`` (lines cut again behind a word that ends in . ! or ?).
A unit is normalised to its words, A-Z lower-cased, white space collapsed, and
hashed to 128 bits.  What is compared is the passage that begins with a unit: the
shortest run of whole units of at least ``min_words`` words (or ``min_bytes``
bytes of words, for text without white space).  With ``min_words=1`` that is the
unit itself.  A short unit such as 'The.' recurs by chance; in this way it goes with
the passage around it and stays elsewhere.

Over the whole corpus the earliest passage of a digest, by (doc_id, text hash,
start), is kept; every later one is marked with its original place in code points.
A marked passage takes in up to ``TAIL`` more units behind it if the kept one goes on
with the same, so the end of a longer passage, too short to begin one of its own, goes
too.  Marked passages of a text may overlap.

One scan, one shuffle: passages go to their digest's task in the order of their
place, and stream past the first one.  A digest that repeats within a batch
of documents sends only its earliest row there; the others are dealt by their place, and
meet the earliest one in a join afterwards, which a common line does not make uneven.

Defined results: NULL and empty texts have no units; NULL doc_ids rank first;
rows that share doc_id and text are the same passages, so a repeated row is not
removed by itself; rows that share a doc_id but not the text are documents of their own;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.runtime import cut_lineage, ship
from limnos.llm.textops import _buffers, span_hashes, splitmix, word_slices, word_table

MIN_WORDS, BYTES_PER_WORD = 15, 10
TAIL = 2
HOT = 8                 # rows of one digest in one batch above which all but the earliest go aside
PLAIN, LEAD, ASIDE = range(3)
PASSAGES = "kind int, h1 long, h2 long, doc_id long, hash long, place long, t1 long, t2 long"
_LOW = (1 << 32) - 1


def _unit_breaks(kind: str, data, s, e, first_of_row) -> np.ndarray:
    """True for each word that opens a unit."""
    n = len(s)
    opens = np.zeros(n, bool)
    opens[first_of_row] = True
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    gap = np.zeros(n, np.int64)
    gap[1:] = feeds[s[1:]] - feeds[e[:-1]]
    if kind == "paragraph":
        return opens | (gap > 1)
    opens |= gap > 0
    if kind == "sentence":
        opens[1:] |= np.isin(data[e[:-1] - 1], [33, 46, 63])
    return opens


def _digests(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each run of word hashes."""
    return tuple(span_hashes(splitmix(h ^ salt), starts, ends)
                 for salt in (np.uint64(0), np.uint64(0xA24BAED4963EE407)))


def _passage_ends(row: np.ndarray, words: np.ndarray, size: np.ndarray, min_words: int, min_bytes: int) -> np.ndarray:
    """Last unit of the passage that begins with each unit; -1 if its row ends before."""
    n = len(row)
    last_of_row = np.searchsorted(row, row, "right") - 1
    end = np.full(n, n)
    for amount, least in ((words, min_words), (size, min_bytes)):
        total = np.concatenate([[0], np.cumsum(amount)])
        end = np.minimum(end, np.searchsorted(total, total[:-1] + least, "left") - 1)
    return np.where(end <= last_of_row, end, -1)


def _combined(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run of unit digests, in order."""
    out = splitmix((last - first).astype(np.uint64))
    todo, k = np.arange(len(first)), 0
    while len(todo):
        out[todo] = splitmix(out[todo] ^ h[first[todo] + k])
        k += 1
        todo = todo[first[todo] + k <= last[todo]]
    return out


def passages(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, min_bytes: int | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every passage of every text: its digest (h1, h2), document, place (start << 32 | end, code points) and,
    for the units behind it, t1 and t2 (32 bits of the digest << 32 | end; 0: none)."""
    ship(docs.sparkSession)
    min_bytes = min_bytes or BYTES_PER_WORD * min_words
    tails = TAIL if min_words > 1 else 0

    def found(col, is_word):
        """(row, h1, h2, place, t1, t2) of a column's passages, slice by slice."""
        for row, stop, counts, s, e, h, data in word_slices(col, is_word):
            if not len(s):
                continue
            begin = np.cumsum(counts) - counts
            u = np.flatnonzero(_unit_breaks(kind, data, s, e, begin[counts > 0]))
            v = np.append(u[1:], len(s))
            d1, d2 = _digests(h, u, v)
            of_row = np.repeat(np.arange(stop - row), counts)[u]
            size = np.concatenate([[0], np.cumsum(e - s)])
            end = _passage_ends(of_row, v - u, size[v] - size[u], min_words, min_bytes)
            a = np.flatnonzero(end >= 0)
            b = end[a]
            # places in code points, from the row's first byte
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            base = point[_row_bytes(col, row, stop)][of_row]
            closes = point[e[v - 1]] - base
            tail = np.zeros((2, len(a)), np.int64)
            for k in range(tails):
                nxt = np.minimum(b + 1 + k, len(u) - 1)
                goes_on = (b + 1 + k < len(u)) & (of_row[nxt] == of_row[a])
                tail[k] = np.where(goes_on, (d1[nxt] >> np.uint64(33)).astype(np.int64) << 32 | closes[nxt], 0)
            yield (row + of_row[a], _combined(d1, a, b).view(np.int64), _combined(d2, a, b).view(np.int64),
                   (point[s[u[a]]] - base[a]) << 32 | closes[b], tail[0], tail[1])

    def run(batches):
        is_word = word_table("space")
        for batch in batches:
            parts = list(found(batch.column(1), is_word))
            if not parts:
                continue
            row, h1, h2, place, t1, t2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, texts = batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row))
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(_set_aside(h1, h2, ids, texts.to_numpy(), place)), "h1": pa.array(h1), "h2": pa.array(h2),
                "doc_id": ids, "hash": texts, "place": pa.array(place), "t1": pa.array(t1), "t2": pa.array(t2)})

    text = docs[text_col].cast("string")
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    return narrow.mapInArrow(run, PASSAGES)


def _row_bytes(col, row: int, stop: int) -> np.ndarray:
    off, _ = _buffers(col)
    return off[row:stop] - off[row]


def _set_aside(h1, h2, ids, texts, place) -> np.ndarray:
    """Kind of a batch's rows: of a digest met more than ``HOT`` times the earliest leads, the others go aside."""
    kind = np.zeros(len(h1), np.int32)
    _, back, count = np.unique(h1, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[back] > HOT)
    if len(often):
        known, doc = _ids(ids)
        order = often[np.lexsort((place[often], texts[often], doc[often], known[often], h2[often], h1[often]))]
        lead = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
        kind[order] = np.where(lead, LEAD, ASIDE)
    return kind


def _ids(col) -> tuple[np.ndarray, np.ndarray]:
    """(is not NULL, value) of a column of ids."""
    return pc.is_valid(col).to_numpy(zero_copy_only=False), pc.fill_null(col, 0).to_numpy(zero_copy_only=False)


RESOLVED = PASSAGES + ", kept_doc_id long, kept_start long"


def _extended(place, t1, t2, first_t1, first_t2):
    """``place`` with its end moved over the following units that are the first one's too."""
    one = (t1 != 0) & (t1 >> 32 == first_t1 >> 32)
    two = one & (t2 != 0) & (t2 >> 32 == first_t2 >> 32)
    end = np.where(two, t2 & _LOW, np.where(one, t1 & _LOW, place & _LOW))
    return place >> 32 << 32 | end


def _resolve(batches):
    """Rows of a partition by digest and place: later passages with the kept one, the earliest of digests
    that have rows aside (as often as a batch had them), and the rows aside as they are."""
    names = ["h1", "h2", "known", "doc", "hash", "place", "t1", "t2"]
    held = None             # the earliest row of the digest that the last batch ended in
    for batch in batches:
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        kind = cols["kind"].to_numpy()
        aside = batch.filter(pa.array(kind == ASIDE))
        if aside.num_rows:
            none = pa.nulls(aside.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*aside.columns, none, none], names=[*aside.schema.names, "kept_doc_id", "kept_start"])
        here = np.flatnonzero(kind != ASIDE)
        if not len(here):
            continue
        known, doc = _ids(cols["doc_id"])
        x = {"known": known, "doc": doc} | {c: cols[c].to_numpy() for c in names if c not in ("known", "doc")}
        x = {c: x[c][here] for c in names}
        lead = kind[here] == LEAD
        if held is not None:
            x = {c: np.concatenate([held[c], x[c]]) for c in names}
            lead = np.append(False, lead)
        new = np.append(True, (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        held = {c: x[c][first[-1]:first[-1] + 1] for c in names}
        f = {c: x[c][first] for c in names}
        same = np.logical_and.reduce([x[c] == f[c] for c in ("known", "doc", "hash", "place")])
        later = np.flatnonzero(~same)
        if len(later):
            none = pa.nulls(len(later), pa.int64())
            place = _extended(*(x[c][later] for c in ("place", "t1", "t2")), f["t1"][later], f["t2"][later])
            yield _resolved(PLAIN, later, none, none, x, place, none, none,
                            pa.array(f["doc"][later], mask=~f["known"][later]), pa.array(f["place"][later] >> 32))
        lead = np.unique(first[lead])
        if len(lead):
            none = pa.nulls(len(lead), pa.int64())
            yield _resolved(LEAD, lead, pa.array(x["h1"][lead]), pa.array(x["h2"][lead]), x, x["place"][lead],
                            pa.array(x["t1"][lead]), pa.array(x["t2"][lead]), none, none)


def _resolved(kind, rows, h1, h2, x, place, t1, t2, kept_id, kept_start) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(np.full(len(rows), kind, np.int32)), "h1": h1, "h2": h2,
        "doc_id": pa.array(x["doc"][rows], mask=~x["known"][rows]), "hash": pa.array(x["hash"][rows]),
        "place": pa.array(place), "t1": t1, "t2": t2, "kept_doc_id": kept_id, "kept_start": kept_start})


def repeated_units(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, min_bytes: int | None = None,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage to remove: doc_id, text_hash, start, end, kept_doc_id and kept_start of the earliest."""
    rows = passages(docs, kind, min_words, min_bytes, id_col, text_col)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, F.when(F.col("kind") == ASIDE, F.xxhash64("hash", "place")).otherwise(F.col("h1")))
    found = cut_lineage(dealt.sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_first(), "hash", "place")
                        .mapInArrow(_resolve, RESOLVED))
    first = cut_lineage(found.where(F.col("kind") == LEAD).select("h1", "h2", *(
        F.col(c).alias(f"_{c}") for c in ("doc_id", "hash", "place", "t1", "t2"))).distinct())
    aside = found.where(F.col("kind") == ASIDE).join(first, ["h1", "h2"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("hash") == F.col("_hash")) & (F.col("place") == F.col("_place"))))

    def goes_on(t):
        return (F.col(t) != 0) & (F.shiftright(t, 32) == F.shiftright(f"_{t}", 32))

    def low(c):
        return F.col(c).bitwiseAND(F.lit(_LOW))

    end = F.when(goes_on("t1") & goes_on("t2"), low("t2")).when(goes_on("t1"), low("t1")).otherwise(low("place"))
    columns = ["doc_id", "text_hash", "start", "end", "kept_doc_id", "kept_start"]
    plain = found.where(F.col("kind") == PLAIN).select("doc_id", F.col("hash").alias("text_hash"), F.shiftright("place", 32).alias(
        "start"), low("place").alias("end"), "kept_doc_id", "kept_start")
    return plain.union(aside.select(
        "doc_id", F.col("hash").alias("text_hash"), F.shiftright("place", 32).alias("start"), end.alias("end"),
        F.col("_doc_id").alias("kept_doc_id"), F.shiftright("_place", 32).alias("kept_start"))).select(*columns)


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans (doc_id, text_hash, start, end) cut out of the text; all columns stay.

    Spans may overlap.  A row is known by its doc_id and its text's hash, so no other row of the id is cut."""
    cuts = spans.groupBy(F.col("doc_id").alias("_cut_id"), F.col("text_hash").alias("_cut_hash")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))))
        .alias("_cuts"))
    text, spots = docs[text_col].cast("string"), cuts["_cuts"]
    # walk over the spans in order, keeping (end of what is cut so far, pieces between)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))
    walked = F.aggregate(spots, zero, lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] > acc["at"], F.concat(acc["pieces"], F.array(F.substr(
            text, acc["at"] + 1, x["start"] - acc["at"])))).otherwise(acc["pieces"]).alias("pieces")))
    clean = F.concat(F.array_join(walked["pieces"], ""), F.substr(text, walked["at"] + 1))
    same = docs[id_col].cast("long").eqNullSafe(cuts["_cut_id"]) & (F.xxhash64(text) == cuts["_cut_hash"])
    return docs.join(cuts, same, "left").select(
        *(F.when(spots.isNull(), docs[c]).otherwise(clean).alias(c) if c == text_col else docs[c] for c in docs.columns))
