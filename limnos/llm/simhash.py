"""SimHash fingerprints of texts, and their neighbours within a Hamming radius.

A text's terms are its distinct words (runs without white space, A-Z lower-cased).
A term weighs round(8 * log2(1 + its count)) * min(its bytes, 8), so long words
tell more than 'the', and its 128-bit hash votes with that weight for each bit that
is set and against each that is not.  A bit of the fingerprint is set where the
votes are positive.  A run of more than ``LONG_RUN`` bytes (text without white
space, such as Chinese or Thai) counts as its windows of 4 characters.  Votes are
whole numbers, so a fingerprint depends on the text alone.

Search: the 128 bits are cut into radius + 2 blocks.  Two fingerprints within the
radius agree on 2 blocks at least, so they meet in one of the permuted tables that
each take 2 blocks as key (radius 5: 21 tables of about 36 bits).  Equal
fingerprints are one row before.  A key's rows are searched in one task by walking
from each fingerprint to those not yet reached, which emits no pairs: a group of
near copies is left after a few steps.  Beyond ``bucket`` rows, a key's rows are
dealt into pairs of parts, each searched alone; no link is lost.

Defined results: a NULL text is an empty one, whose fingerprint has no bit set; equal
texts have equal fingerprints; rows that repeat are rows of their own; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.components import connected_components
from limnos.llm.runtime import cut_lineage, ship
from limnos.llm.textops import splitmix, window_hashes, word_slices, word_table

BITS = 128
RADIUS = 5
LONG_RUN = 48
BUCKET = 65_536         # fingerprints of one key searched by one task
_SALTS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xA0761D6478BD642F))


# ------------------------------------------------------------ fingerprints

def _run_terms(run: bytes) -> np.ndarray:
    """Hashes of the 4-character windows of a run without white space."""
    cp = np.frombuffer(run.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return window_hashes(splitmix(cp.astype(np.uint64)), 4)


def _terms(counts, s, e, h, data):
    """(row within the slice, hash, weight) of the distinct terms of a slice's rows."""
    row, size = np.repeat(np.arange(len(counts)), counts), e - s
    long = np.flatnonzero(size > LONG_RUN)
    if len(long):
        parts = [_run_terms(data[s[k]:e[k]].tobytes()) for k in long.tolist()]
        short = np.flatnonzero(size <= LONG_RUN)
        row = np.concatenate([row[short], np.repeat(row[long], [len(p) for p in parts])])
        h = np.concatenate([h[short], *parts])
        size = np.concatenate([size[short], np.full(len(row) - len(short), 4)])
    order = np.lexsort((h, row))
    row, h, size = row[order], h[order], size[order]
    opens = np.ones(len(h), bool)
    opens[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(opens)
    tf = np.diff(np.append(at, len(h)))
    weight = np.rint(8 * np.log2(1 + tf)).astype(np.int64) * np.minimum(size[at], 8)
    return row[at], h[at], weight


def _vote(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The fingerprint (2 words of 64 bits) of one text's terms."""
    exact = np.float32 if int(weight.sum()) < 1 << 24 else np.float64
    out = np.empty(2, np.uint64)
    for k, salt in enumerate(_SALTS):
        half = np.zeros(64)
        for lo in range(0, len(h), 4096):
            bits = np.unpackbits(splitmix(h[lo:lo + 4096] ^ salt).view(np.uint8)).reshape(-1, 64)
            half += weight[lo:lo + 4096].astype(exact) @ bits.astype(exact)
        out[k] = np.packbits(2 * half > weight.sum()).view(np.uint64)[0]
    return out


def signatures(col) -> np.ndarray:
    """Fingerprints of a string column: an array of (rows, 2) words."""
    out = np.zeros((len(col), 2), np.uint64)
    for first, _, counts, s, e, h, data in word_slices(col, word_table("space")):
        if not len(s):
            continue
        row, h, weight = _terms(counts, s, e, h, data)
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(row)], strict=True):
            out[first + row[lo]] = _vote(h[lo:hi], weight[lo:hi])
    return out


def hexes(prints: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in np.ascontiguousarray(prints)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / float(BITS)


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_chars, fingerprint, near_id) of every row: fingerprints and their classes."""
    rows = cut_lineage(fingerprint(docs, id_col, text_col))
    return rows.join(near_classes(rows, radius), "fingerprint").select("doc_id", "n_chars", "fingerprint", "near_id")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row; one scan, no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = pa.array([x or "" for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_chars": pa.array([len(x) for x in texts.to_pylist()], pa.int64()),
                "fingerprint": pa.array(hexes(signatures(texts)), pa.string())})

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


# ------------------------------------------------------------ each text with the next one

def _place(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` with the columns of their order (descending doc_id, NULL last; then hash and text) and a
    bucket that grows in that order.  Quantiles of the ids bound the buckets; an id that fills several
    is dealt over them by the hash."""
    step = [k / buckets for k in range(1, buckets)] or [0.5]
    falling = F.bitwise_not("doc_id")          # orders as -doc_id, without overflow
    n, nulls, found = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()),
                               F.percentile_approx(falling, step, 20 * buckets)).first()
    bounds = sorted(found or [])
    hot = {b: m for b, m in Counter(bounds).items() if m > 1}
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k:k + width] for k in range(0, len(bounds), width)]

    def literal(values):
        return F.array(*map(F.lit, values)).cast("array<bigint>")

    def below(values):
        return F.size(F.filter(values, lambda b: b < F.col("_key")))

    if rows:
        coarse = below(literal([r[0] for r in rows]))
        fine = F.array(*map(literal, rows))
        base = F.when(coarse == 0, F.lit(0)).otherwise(
            (coarse - 1) * width + below(F.element_at(fine, F.greatest(coarse, F.lit(1)))))
    else:
        base = F.lit(0)
    ways = F.lit(1)
    if hot:
        spread = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
        ways = F.coalesce(F.element_at(spread, F.col("_key")), F.lit(1))
    ways = F.when(F.col("_key").isNull(), 1 + (nulls or 0) * buckets // max(n, 1)).otherwise(ways)
    base = F.when(F.col("_key").isNull(), len(bounds) + 1).otherwise(base)
    return (docs.withColumns({"_key": falling, "_mix": F.pmod(F.xxhash64("text"), F.lit(1 << 16))})
            .withColumn("_bucket", (base + F.floor(F.col("_mix") * ways / (1 << 16))).cast("int")))


def _stream(batches):
    """Rows in order, each bucket closed by the first row of the next one -> a row per document."""
    pending, sig = None, None          # (bucket, id, text) that waits for the text behind it
    for batch in batches:
        where, halo = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids, texts = batch.column(2).to_pylist(), [x or "" for x in batch.column(3).to_pylist()]
        prints = signatures(pa.array(texts, pa.string()))
        done = []
        for k, text in enumerate(texts):
            if pending is not None and where[k] == pending[0]:
                n = len(pending[2])
                done.append((pending[1], n, pending[2][:n - n // 2] + text[:n // 2], sig, prints[k]))
                pending = None
            if not halo[k]:
                pending, sig = (where[k], ids[k], text), prints[k]
        if done:
            own, behind = (np.array([d[c] for d in done]) for c in (3, 4))
            edited = [d[2] for d in done]
            changed = signatures(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d[0] for d in done], pa.int64()),
                "n_chars": pa.array([d[1] for d in done], pa.int64()),
                "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited],
                "fingerprint": hexes(own), "edited_fingerprint": hexes(changed),
                "near_edited": likeness(own, changed), "near_next": likeness(own, behind)})


EDITS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  buckets: int | None = None) -> DataFrame:
    """How far fingerprints follow an edit: each text, the same with its second half taken from the
    start of the next document's, and the likeness to that and to the next document.

    Documents follow each other by descending doc_id, NULL last, rows of one id by hash and text;
    the first follows the last.  Texts are shuffled once, to buckets bounded by quantiles of the ids; the
    first row of each goes to the bucket before it too.  A task reads its rows in order and
    holds one batch of them."""
    spark = docs.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _place(_narrow(docs, id_col, text_col), buckets or 2 * tasks)
    order = ["_key", "_mix"]
    # one row per bucket, whatever the table
    first = placed.groupBy("_bucket").agg(F.min(F.struct(F.col("_key").isNull(), *order)).alias("f")).collect()
    first = sorted((r["_bucket"], r["f"]["_key"], r["f"]["_mix"]) for r in first)
    heads = [(*row, first[k - 1][0]) for k, row in enumerate(first)]
    head = F.broadcast(spark.createDataFrame(heads, "b int, k long, m long, target int"))
    known = placed.join(head, (placed["_bucket"] == head["b"]) & placed["_key"].eqNullSafe(head["k"])
                        & (placed["_mix"] == head["m"]), "left")
    own = F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("halo"))
    halo = F.struct(F.col("target").alias("at"), F.lit(True).alias("halo"))
    dealt = known.withColumn("_to", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(
        F.array(own, halo))))
    rows = (dealt.select("_to.at", "_to.halo", "doc_id", "text", *order).repartition(tasks, "at")
            .sortWithinPartitions("at", "halo", F.col("_key").asc_nulls_last(), "_mix", "text"))
    return rows.select("at", "halo", "doc_id", "text").mapInArrow(_stream, EDITS)


# ------------------------------------------------------------ permuted block tables

def _masks(radius: int) -> np.ndarray:
    """The bits of each table's key: 2 of radius + 2 blocks."""
    edge = [BITS * k // (radius + 2) for k in range(radius + 3)]
    whole = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(radius + 2)]
    both = [a | b for a, b in combinations(whole, 2)]
    return np.array([[m & (1 << 64) - 1, m >> 64] for m in both], np.uint64)


def _keys(hi: np.ndarray, lo: np.ndarray, masks: np.ndarray, table: int) -> np.ndarray:
    a, b = hi & masks[table, 0], lo & masks[table, 1]
    return splitmix(splitmix(a + np.uint64(table)) ^ b).view(np.int64)


def reached(prints: np.ndarray, radius: int) -> np.ndarray:
    """Component (smallest position) of each fingerprint, walking only to those not yet reached."""
    n = len(prints)
    root, left = np.full(n, -1), np.arange(n)
    while len(left):
        seed = left[0]
        front, left = left[:1], left[1:]
        root[seed] = seed
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            step = max(1, (1 << 20) // len(left))
            taken, front = front[:step], front[step:]
            gap = prints[taken, None] ^ prints[None, left]
            near = (np.bitwise_count(gap).sum(axis=2) <= radius).any(axis=0)
            hit = left[near]
            root[hit] = seed
            front, left = np.concatenate([front, hit]), left[~near]
    return root


def _links(prints: np.ndarray, radius: int):
    """(smaller position, position) of a forest over the linked rows of one key."""
    root = reached(prints, radius)
    far = np.flatnonzero(root != np.arange(len(root)))
    return root[far], far


def _runs(batches, names):
    """Rows of consecutive equal keys: (key, rows as arrays), whole groups only."""
    held = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        key = cols[0]
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None and len(held[0]):
        yield held


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Forest (a, b) of row ids that joins all fingerprints within ``radius`` of each other.

    ``prints``: distinct fingerprints (id, hi, lo).  Keys with more than ``bucket`` of them are found by a
    count and dealt into pairs of parts first."""
    ship(prints.sparkSession)
    masks = _masks(radius)

    def dealt(batches):
        for batch in batches:
            ids, hi, lo = (batch.column(k).to_numpy() for k in range(3))
            h, l = hi.view(np.uint64), lo.view(np.uint64)
            for t in range(len(masks)):
                yield pa.RecordBatch.from_pydict({"key": _keys(h, l, masks, t), "id": ids, "hi": hi, "lo": lo})

    def search(batches):
        for key, ids, hi, lo in _runs(batches, ("key", "id", "hi", "lo")):
            p = np.stack([hi.view(np.uint64), lo.view(np.uint64)], axis=1)
            opens = np.append(True, key[1:] != key[:-1])
            at = np.flatnonzero(opens)
            size = np.diff(np.append(at, len(key)))
            a, b = [], []
            pair = at[size == 2]
            near = np.bitwise_count(p[pair] ^ p[pair + 1]).sum(axis=1) <= radius if len(pair) else pair.astype(bool)
            a.append(pair[near])
            b.append(pair[near] + 1)
            for k in np.flatnonzero(size > 2).tolist():
                x, y = _links(p[at[k]:at[k] + size[k]], radius)
                a.append(x + at[k])
                b.append(y + at[k])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": ids[a], "b": ids[b]})

    rows = prints.select("id", "hi", "lo").mapInArrow(dealt, "key long, id long, hi long, lo long")
    count = rows.groupBy("key").count()      # sums before the shuffle: a hot key is a row per task here
    large = cut_lineage(count.where(F.col("count") > bucket).select("key", (F.ceil(
        2 * F.col("count") / bucket)).cast("int").alias("parts")))
    if large.limit(1).count():
        own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("int"))).otherwise(
            F.sequence(F.lit(0), F.col("parts") - 1)))
        split = rows.join(large, "key", "left").withColumn("_own", own).withColumn("_other", other)
        pair = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
        rows = split.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(pair).alias("key"), "id", "hi", "lo")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")


def near_classes(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fingerprint, near_id): the smallest doc_id reachable over fingerprints within ``radius``.

    ``prints`` holds doc_id and fingerprint; NULL ids name a class only if it has no other."""
    half = [F.conv(F.substring("fingerprint", 1 + 16 * k, 16), 16, -10).cast("long") for k in range(2)]
    own = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
                      .select("fingerprint", "rep", half[0].alias("hi"), half[1].alias("lo"),
                              F.monotonically_increasing_id().alias("id")))      # written, so it stays
    found = connected_components(near_links(own, radius, bucket))
    named = own.join(found, own["id"] == found["node"], "left").select(
        "fingerprint", "rep", F.coalesce("label", "id").alias("label"))
    named = cut_lineage(named)
    least = named.groupBy("label").agg(F.min("rep").alias("near_id"))
    return named.join(least, "label").select("fingerprint", "near_id")
