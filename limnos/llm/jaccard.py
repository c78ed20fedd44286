"""Exact similarity join on word shingles by T-occurrence search (DivideSkip).

A document's set holds the hashes (64 bits) of its distinct ``WORDS``-word
shingles, or one of the whole sequence if it has fewer words.  Documents link
when 5 * |x & y| >= 4 * |x | y| (Jaccard 0.8).

1. A scan gives each document its set's size and digest; equal sets become one
   (hot groups of exact copies end here).  The same scan counts shingles in a
   sketch of fixed size, whose sums order shingles from rare to common.
2. A linked pair of sets shares one of the n - ceil(0.8 n) + 1 rarest shingles
   of each.  These lists are dealt by shingle; sets that share a list within
   the size ratio are joined to candidate groups (a superset of all links).  A
   shingle whose sketch count is large is dealt to several tasks, which pass on
   one row per run of sizes.
3. Inside a candidate group T-occurrence search finds the links: the query's
   longest lists are set aside, the short ones are heap-merged, and a candidate
   that occurs often enough is probed in the long ones by binary search.  A
   search needs one link into each component, so copies of copies do not cost
   all their pairs.
4. A group above ``block`` shingles, mostly documents that share passages and do not
   link, is first split by its sets' min-hashes: sets stay together if one of 40 bands
   of two values agrees, directly or over others.  A linked pair is parted with a
   probability below 0.36**40, 2e-18, as rare as equal hashes of different shingles.
   ``exact=True`` leaves this step out, at several times the disk.
5. A group still above ``block`` is cut into blocks, by the class of its sets' sizes
   (steps of a quarter, so links stay within a class or join neighbours) and by hash.
   Each block is searched alone; then one member of each component is searched
   in the other blocks whose class its links can reach, and, if several components are
   left, every other member outside the largest one.  No link is lost and no group is
   gathered in one task.

A row is known by its doc_id and the 64-bit hash of its text, so rows that share an
id (or have none) are told apart in every join.

Defined results: NULL or empty texts have size 0, link with nothing and are
their own component; a NULL doc_id never names a component that has another;
rows sharing a doc_id (or NULL) but not the text are documents of their own; repeated
rows are copies; other columns are ignored; an empty table gives no rows.
``keep_one`` leaves exactly one row of each component, that of the smallest doc_id (NULL
last; then the smallest text hash; any one of rows that repeat), and every row without
words.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.components import connected_components, local_roots
from limnos.llm.runtime import cut_lineage, ship, sum_parts, vector_parts
from limnos.llm.textops import splitmix, window_hashes, word_slices, word_table

WORDS = 5
SKETCH_BITS, SKETCH_PARTS = 18, 16
HOT_LIST = 50_000        # postings of one shingle handled by one task
TASK_POSTINGS = 1_000_000
BLOCK = 1_500_000        # shingles of a group searched by one task
BROADCAST_ROWS = 1_000_000      # (id, hash) rows of dropped documents sent to every executor at most
HEAP_ENTRIES = 512       # longer merges count by numpy, in one pass over the same lists


# ------------------------------------------------------------ sets

def shingle_sets(col, words: int = WORDS):
    """Yield (row, sorted distinct shingle hashes) for every row of a string column."""
    is_word = word_table("space")
    for row, _, counts, _, _, h, _ in word_slices(col, is_word):
        full = window_hashes(h, words)
        at = 0
        for k, n in enumerate(counts.tolist()):
            if n >= words:
                s = np.sort(full[at:at + n - words + 1])
                yield row + k, s[np.append(True, s[1:] != s[:-1])]
            elif n:
                yield row + k, window_hashes(h[at:at + n], n)
            else:
                yield row + k, np.zeros(0, np.uint64)
            at += n


def set_id(s: np.ndarray) -> int:
    """64-bit digest of a set; used together with its size."""
    mixed = splitmix(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(splitmix(np.array([mixed.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(s) if len(s) else 0],
                                 np.uint64)).view(np.int64)[0])


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))


PROFILE = "doc_id long, hash long, n long, sid long, part int, counts binary"


def profile(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """A row per document (doc_id, hash, n, sid) and, per task, its sketch in parts."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, sid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            held, size = [], 0
            for row, s in shingle_sets(batch.column(1), words):
                n[row], sid[row] = len(s), set_id(s)
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    counts += _bucket_counts(held)
                    held, size = [], 0
            if held:
                counts += _bucket_counts(held)
            yield _profile_batch(batch.column(0), batch.column(2), n, sid)
        if counts.any():
            none = [pa.nulls(SKETCH_PARTS, pa.int64())] * 4
            sums = vector_parts(counts, SKETCH_PARTS)
            yield pa.RecordBatch.from_arrays([*none, *sums.columns], names=["doc_id", "hash", "n", "sid", "part", "counts"])

    return docs.mapInArrow(run, PROFILE)


def _bucket_counts(sets) -> np.ndarray:
    return np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                       minlength=1 << SKETCH_BITS)


def _profile_batch(ids, hashes, n, sid) -> pa.RecordBatch:
    m = len(n)
    return pa.RecordBatch.from_pydict({"doc_id": ids, "hash": hashes, "n": pa.array(n), "sid": pa.array(sid),
                                       "part": pa.nulls(m, pa.int32()), "counts": pa.nulls(m, pa.binary())})


# ------------------------------------------------------------ candidate groups

POSTING = "h long, sid long, lo int, hi int, deal int, hot boolean"


def rare_prefix(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The n - ceil(0.8 n) + 1 rarest shingles of a set (more if places tie)."""
    size = len(s) - (4 * len(s) + 4) // 5 + 1
    place = (level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(48)) | (s >> np.uint64(16))
    return s[place <= np.partition(place, size - 1)[size - 1]]


def rare_postings(docs: DataFrame, sums: np.ndarray, words: int = WORDS, hot_list: int = HOT_LIST) -> DataFrame:
    """(shingle, set, size) of each set's rarest shingles; a task gives a set once."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(sums)   # fixed size

    def run(batches):
        total = shared.value
        level = np.minimum(total * 256.0 / max(total.mean(), 1e-9), 65535).astype(np.uint64)
        seen: set[int] = set()
        for batch in batches:
            out, size = [], 0
            for _, s in shingle_sets(batch.column(1), words):
                sid = set_id(s)
                if not len(s) or sid in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
                out.append((rare_prefix(s, level), sid, len(s)))
                size += len(out[-1][0])
                if size > 1 << 17:
                    yield _posting_batch(out, total, hot_list)
                    out, size = [], 0
            if out:
                yield _posting_batch(out, total, hot_list)

    return docs.mapInArrow(run, POSTING)


def _posting_batch(out, total, hot_list) -> pa.RecordBatch:
    m = np.array([len(x[0]) for x in out])
    h = np.concatenate([x[0] for x in out])
    sid = np.repeat(np.array([x[1] for x in out], np.int64), m)
    n = np.repeat(np.array([x[2] for x in out], np.int32), m)
    ways = 1 + total[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // hot_list
    return pa.RecordBatch.from_pydict({"h": h.view(np.int64), "sid": sid, "lo": n, "hi": n,
                                       "deal": (sid % ways).astype(np.int32), "hot": ways > 1})


def _runs(h, lo, hi):
    """Sort rows by (shingle, size) and number the runs in which sizes stay within the ratio."""
    order = np.lexsort((lo, h))
    h, lo, hi = h[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    new_list = np.ones(len(h), bool)
    new_list[1:] = h[1:] != h[:-1]
    base = np.cumsum(new_list) << 32
    top = np.maximum.accumulate(base + hi) - base
    opens = new_list.copy()
    opens[1:] |= 5 * top[:-1] < 4 * lo[1:]
    return order, h, lo, top, opens


EDGE = "a long, b long, h long, lo int, hi int"


def list_edges(batches):
    """Rows of whole lists (or dealt parts of hot ones) -> edges within the partition, and one
    row per run of a hot list's part."""
    cols = [[], [], [], [], []]
    for batch in batches:
        for c, name in zip(cols, ("h", "sid", "lo", "hi", "hot"), strict=True):
            c.append(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False))
    if not cols[0]:
        return
    h, sid, lo, hi, hot = (np.concatenate(c) for c in cols)
    order, h, lo, top, opens = _runs(h, lo, hi)
    sid, hot = sid[order], hot[order]
    first = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    a, b = sid[first][run], sid
    differ = a != b
    if differ.any():
        node, root = local_roots(a[differ], b[differ])
        keep = node != root
        node, root = node[keep], root[keep]
        if len(node):
            yield _edge_batch(root, node)
    ends = np.append(first[1:], len(h)) - 1
    part = hot[first]
    if part.any():
        f, e = first[part], ends[part]
        yield _edge_batch(sid[f], sid[f], h[f], lo[f], top[e])


def _edge_batch(a, b, h=None, lo=None, hi=None) -> pa.RecordBatch:
    none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32())]
    more = none if h is None else [pa.array(h), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *more], names=["a", "b", "h", "lo", "hi"])


def candidate_groups(docs: DataFrame, sums: np.ndarray, postings: int, words: int = WORDS,
                     hot_list: int = HOT_LIST) -> DataFrame:
    """(node, label) of sets that may have links; a link lies inside one label."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings // TASK_POSTINGS))
    found = cut_lineage(rare_postings(docs, sums, words, hot_list).repartition(tasks, "h", "deal")
                        .mapInArrow(list_edges, EDGE))
    again = (found.where("h IS NOT NULL")
             .select("h", F.col("a").alias("sid"), "lo", "hi", F.lit(False).alias("hot"))
             .repartition(tasks, "h").mapInArrow(list_edges, EDGE))
    return connected_components(found.where("h IS NULL").select("a", "b").union(again.select("a", "b")))


# ------------------------------------------------------------ search inside a group

def enough(n: int, m: int) -> int:
    """Smallest overlap of linked sets of n and m shingles."""
    return -(-4 * (n + m) // 9)


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def heap_merge_counts(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids occurring in at least ``least`` of the sorted lists."""
    out = {}
    for key, group in groupby(heapq.merge(*lists)):
        n = sum(1 for _ in group)
        if n >= least:
            out[key] = n
    return out


class Index:
    """Inverted lists over sets ordered by size; answers T-occurrence searches."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.docs = doc[order]
        flat = flat[order]
        opens = np.ones(len(flat), bool)
        opens[1:] = flat[1:] != flat[:-1]
        self.at = np.flatnonzero(opens)
        self.tokens = flat[self.at]
        self.length = np.diff(np.append(self.at, len(flat)))

    def candidates(self, query: np.ndarray, before: int | None = None):
        """Yield (set, overlap in the short lists, tokens of the long lists), most shared first.
        Only sets within the size ratio, and before ``before`` if given."""
        n = len(query)
        lo = int(np.searchsorted(self.sizes, (4 * n + 4) // 5))
        hi = int(np.searchsorted(self.sizes, 5 * n // 4, "right"))
        hi = hi if before is None else min(hi, before)
        if lo >= hi or not n:
            return
        k = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        present = self.tokens[k] == query
        k = k[present]
        least = enough(n, int(self.sizes[lo]))
        if len(k) < least:
            return
        k = k[np.argsort(self.length[k], kind="stable")]
        longest = max(int(self.length[k[-1]]), 2)
        aside = min(least - 1, int(least / (0.0085 * np.log2(longest) + 1)))
        short, long = k[:len(k) - aside], k[len(k) - aside:]
        total = int(self.length[short].sum())
        if total <= HEAP_ENTRIES:
            lists = []
            for t in short.tolist():
                entries = self.docs[self.at[t]:self.at[t] + self.length[t]]
                if len(entries) > 1 or before is None:
                    lists.append(entries[np.searchsorted(entries, lo):np.searchsorted(entries, hi)].tolist())
            counts = heap_merge_counts(lists, least - aside)
        else:
            size = self.length[short]
            shift = np.cumsum(size) - size
            entries = self.docs[np.repeat(self.at[short] - shift, size) + np.arange(total)]
            entries = entries[(entries >= lo) & (entries < hi)]
            c = np.bincount(entries - lo, minlength=1)
            often = np.flatnonzero(c >= least - aside)
            counts = dict(zip((often + lo).tolist(), c[often].tolist(), strict=True))
        probe = self.tokens[long]
        for c in sorted(counts, key=counts.get, reverse=True):
            yield c, counts[c], probe

    def linked(self, query: np.ndarray, c: int, short: int, probe: np.ndarray) -> bool:
        """Binary-probe the long lists' tokens for set ``c``."""
        need = enough(len(query), int(self.sizes[c]))
        if short + len(probe) < need:
            return False
        s = self.sets[c]
        k = np.minimum(np.searchsorted(s, probe), len(s) - 1)
        return short + int((s[k] == probe).sum()) >= need


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    k = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[k] == x).sum())


def link_group(sets: list[np.ndarray]) -> list[int]:
    """Component (position of one member) of each set; ``sets`` ordered by size."""
    parent, apart = list(range(len(sets))), 0
    index = Index(sets)
    for q, s in enumerate(sets):
        apart += 1          # components among the sets up to this one
        before = sets[q - 1] if q else None
        if q and 5 * len(before) >= 4 * len(s) and overlap(s, before) >= enough(len(s), len(before)):
            parent[q] = _find(parent, q - 1)
            apart -= 1
        if apart == 1:
            continue        # nothing left to join
        for c, short, probe in index.candidates(s, q):
            a, b = _find(parent, q), _find(parent, c)
            if a != b and index.linked(s, c, short, probe):
                parent[max(a, b)] = min(a, b)
                apart -= 1
    return [_find(parent, x) for x in range(len(sets))]


BANDS = 40
_MULTIPLY = splitmix(np.arange(3001, 3001 + 2 * BANDS, dtype=np.uint64)) | np.uint64(1)
_ADD = splitmix(np.arange(5001, 5001 + 2 * BANDS, dtype=np.uint64))


def band_values(s: np.ndarray) -> np.ndarray:
    """One value per band of two min-hashes of a set."""
    least = np.array([(s * a + b).min() for a, b in zip(_MULTIPLY, _ADD, strict=True)], np.uint64)
    return splitmix(least[0::2] * np.uint64(0x9E3779B97F4A7C15) ^ least[1::2]).view(np.int64)


def _band_rows(batches):
    for batch in batches:
        label, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows, values = [], []
        for row, s in shingle_sets(batch.column(2)):
            rows.append(row)
            values.append(band_values(s))
        if rows:
            yield pa.RecordBatch.from_pydict({
                "label": np.repeat(label[rows], BANDS), "sid": np.repeat(sid[rows], BANDS),
                "band": np.tile(np.arange(BANDS, dtype=np.int32), len(rows)), "value": np.concatenate(values)})


def split_groups(texts: DataFrame) -> DataFrame:
    """(sid, part): the members of candidate groups that share min-hash bands, by their smallest set.
    Members without a partner have no row."""
    bands = texts.select("label", "sid", "text").mapInArrow(_band_rows, "label long, sid long, band int, value long")
    bands = cut_lineage(bands)
    key = ["label", "band", "value"]
    first = bands.groupBy(*key).agg(F.min("sid").alias("a"), F.max("sid").alias("last")).where("a < last")
    edges = bands.join(first.drop("last"), key).select("a", F.col("sid").alias("b")).distinct()
    found = connected_components(edges)
    return found.select(F.col("node").alias("sid"), F.col("label").alias("part"))


MEMBER = "label long, block int, sid long, root long"


def _grouped(batches):
    """Consecutive rows of equal (label, block): yields (label, block, {sid: set})."""
    key, held = None, {}
    for batch in batches:
        label, block, want = (batch.column(k).to_pylist() for k in range(3))
        for row, s in shingle_sets(batch.column(3)):
            if (label[row], block[row]) != key:
                if held:
                    yield (*key, held)
                key, held = (label[row], block[row]), {}
            held[want[row]] = s
    if held:
        yield (*key, held)


def search_blocks(batches):
    for label, block, held in _grouped(batches):
        sids = sorted(held, key=lambda x: (len(held[x]), x))
        roots = link_group([held[x] for x in sids])
        yield pa.RecordBatch.from_pydict({
            "label": pa.array([label] * len(sids), pa.int64()), "block": pa.array([block] * len(sids), pa.int32()),
            "sid": pa.array(sids, pa.int64()), "root": pa.array([sids[r] for r in roots], pa.int64())})


def _search_across(key, queries, index):
    """Links from queries to the sets of another block: (root, root) pairs, one per component."""
    import pandas as pd

    def sets(frame):
        col = pa.array(frame["text"].tolist(), pa.string())
        out = {}
        for row, s in shingle_sets(col):
            out[int(frame["sid"].iat[row])] = (s, int(frame["root"].iat[row]))
        return out

    known, asked = sets(index), sets(queries)
    order = sorted(known, key=lambda x: (len(known[x][0]), x))
    found, own = set(), Index([known[x][0] for x in order])
    for s, root in asked.values():
        met = {root}
        for c, short, probe in own.candidates(s):
            other = known[order[c]][1]
            if other not in met and own.linked(s, c, short, probe):
                met.add(other)
                found.add((root, other))
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def _merge_roots(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` with roots joined by ``edges`` replaced by the smallest of them."""
    merged = connected_components(edges).select(F.col("node").alias("root"), F.col("label").alias("to"))
    same = [c for c in members.columns if c != "root"]
    return members.join(merged, "root", "left").select(*same, F.coalesce("to", "root").alias("root"))


def _across(queries: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """Search ``queries`` in every other block of their label that a link can reach."""
    blocks = members.select("label", F.col("block").alias("target"), F.col("class").alias("near")).distinct()
    reach = queries.join(blocks, "label").where("target <> block AND abs(class - near) <= 1")
    per = cut_lineage(reach.groupBy("label", "target").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("ways")))
    dealt = (reach.join(per, ["label", "target"])
             .withColumn("way", F.pmod(F.xxhash64("sid"), F.col("ways")).cast("int"))
             .select("label", "target", "way", "sid", "root", "text"))
    targets = (members.join(per.withColumnRenamed("target", "block"), ["label", "block"])
               .withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
               .select(*(F.col(c).alias(n) for c, n in (("label", "label"), ("block", "target"), ("way", "way"),
                                                        ("sid", "sid"), ("root", "root"), ("text", "text")))))
    keys = ["label", "target", "way"]
    return dealt.groupBy(*keys).cogroup(targets.groupBy(*keys)).applyInPandas(_search_across, "a long, b long")


def join_blocks(members: DataFrame, block: int) -> DataFrame:
    """Complete the components of labels that have several blocks."""
    ship(members.sparkSession)
    members = cut_lineage(members.withColumn("asked", F.expr("sid = root")))
    members = cut_lineage(_merge_roots(members, _across(members.where("asked"), members, block)))
    size = members.groupBy("label", "root").agg(F.count("*").alias("m"))
    main = size.groupBy("label").agg(F.max(F.struct("m", "root")).alias("main"), F.count("*").alias("roots"))
    rest = members.join(main.where("roots > 1"), "label").where(
        "root <> main.root AND NOT asked").select(*members.columns)
    return _merge_roots(members, _across(rest, members, block))


# ------------------------------------------------------------ the operator

SIZE_CLASS = "cast(floor(ln(n) / ln(1.25) + 1e-9) as int)"     # linked sizes differ by a quarter at most


def _linked_sets(narrow: DataFrame, hot_list: int, block: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, n, sid) of every row and (sid, n, root) of every set, root one member of its component."""
    profiled = cut_lineage(profile(narrow))
    rows = profiled.where("part IS NULL").select("doc_id", "hash", "n", "sid")
    sums = sum_parts(profiled.where("part IS NOT NULL"), SKETCH_PARTS, 1 << SKETCH_BITS)
    groups = candidate_groups(narrow, sums, int(sums.sum()) // 5 + 1, hot_list=hot_list)

    # one row stands for its set, and brings the text
    sets = rows.where("n > 0").groupBy("sid", "n").agg(F.min(F.struct("doc_id", "hash")).alias("rep"))
    wanted = groups.join(sets, groups["node"] == sets["sid"]).select("label", "sid", "n", "rep")
    texts = wanted.join(narrow, wanted["rep.doc_id"].eqNullSafe(narrow["doc_id"])
                        & (wanted["rep.hash"] == narrow["hash"])).select("label", "sid", "n", "text")
    if rows.where("n > 0").groupBy("doc_id", "hash").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["sid", "n"])       # rows repeat whole
    texts = cut_lineage(texts)
    weight = texts.groupBy("label").agg(F.sum("n").alias("weight"))
    large = cut_lineage(weight.where(F.col("weight") > block).select("label"))
    placed = texts.join(large, "label", "left_anti").withColumns({"class": F.lit(0), "ways": F.lit(0), "block": F.lit(0)})
    if large.limit(1).count():
        many = texts.join(large, "label", "left_semi")
        if not exact:
            many = many.drop("label").join(split_groups(many), "sid").withColumnRenamed("part", "label")
        many = cut_lineage(many.select("label", "sid", "n", "text"))
        total = many.groupBy("label").agg((F.sum("n") > block).alias("_cut"))
        many = many.join(total, "label").withColumn("class", F.when(F.col("_cut"), F.expr(SIZE_CLASS)).otherwise(0))
        size = many.groupBy("label", "class").agg(
            F.max(F.when(F.col("_cut"), 1).otherwise(0)).alias("_cut"), F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("_ways"))
        size = size.select("label", "class", (F.col("_cut") * F.col("_ways")).alias("ways"))
        placed = placed.unionByName(many.drop("_cut").join(size, ["label", "class"]).withColumn("block", F.when(
            F.col("ways") == 0, 0).otherwise(F.hash("class", F.pmod(F.xxhash64("sid"), F.greatest("ways", F.lit(1)))))))
    roots = cut_lineage(placed.select("label", "block", "sid", "text").repartition("label", "block")
                        .sortWithinPartitions("label", "block").mapInArrow(search_blocks, MEMBER))
    if placed.where("ways > 0").limit(1).count():
        many = placed.where("ways > 0").join(roots.select("sid", "root"), "sid").select(
            "label", "class", "block", "sid", "n", "root", "text")
        joined = cut_lineage(join_blocks(many, block).select("sid", "root").distinct())
        roots = roots.join(joined, "sid", "left_anti").select("sid", "root").union(joined)
    linked = sets.join(roots.select(F.col("sid").alias("member"), "root"), sets["sid"] == F.col("member"), "left")
    return rows, cut_lineage(linked.select("sid", "n", "rep", F.coalesce("root", "sid").alias("root")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_list: int = HOT_LIST,
                       block: int = BLOCK, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    ship(docs.sparkSession)
    rows, linked = _linked_sets(_narrow(docs, id_col, text_col), hot_list, block, exact)
    least = rows.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("least"))
    linked = linked.join(least, ["sid", "n"])
    name = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(name, "root").select("sid", "n", "component_id")
    return rows.join(named, ["sid", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_list: int = HOT_LIST,
             block: int = BLOCK, exact: bool = False) -> DataFrame:
    """``docs`` (all columns) with one row of each component, and every row without words."""
    spark = docs.sparkSession
    ship(spark)
    narrow = _narrow(docs, id_col, text_col)
    rows, linked = _linked_sets(narrow, hot_list, block, exact)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    first = rows.where("n > 0").groupBy("sid", "n").agg(F.min(row).alias("first"))
    linked = linked.select("sid", "n", "root").join(first, ["sid", "n"])
    stays = cut_lineage(linked.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.hash"))
    worded = rows.where("n > 0").select("doc_id", "hash")
    same = worded["doc_id"].eqNullSafe(stays["doc_id"]) & (worded["hash"] == stays["hash"])
    gone = cut_lineage(worded.join(stays, same, "left_anti").distinct().select(
        F.col("doc_id").alias("_gone"), F.col("hash").alias("_gone_hash")))     # written, so the plan knows its size
    text_hash = F.xxhash64(docs[text_col].cast("string"))

    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)        # else the texts are shuffled and sorted

    def known(keys: DataFrame):
        return docs[id_col].cast("long").eqNullSafe(keys["_gone"]) & (text_hash == keys["_gone_hash"])

    kept = docs.join(gone, known(gone), "left_anti")
    twice = cut_lineage(worded.join(stays, same, "left_semi").groupBy("doc_id", "hash").count().where("count > 1").select(
        F.col("doc_id").alias("_gone"), F.col("hash").alias("_gone_hash")))
    if not twice.limit(1).count():
        return kept
    # rows that repeat whole: written with a number each, so that the same one stays in every run
    copies = cut_lineage(docs.join(twice, known(twice), "left_semi").select(
        F.struct(*docs.columns).alias("_row"), docs[id_col].cast("long").alias("_id"), text_hash.alias("_hash"),
        F.monotonically_increasing_id().alias("_number")))
    number = copies.groupBy("_id", "_hash").agg(F.min("_number").alias("_number")).select("_number")
    return kept.join(twice, known(twice), "left_anti").union(copies.join(number, "_number", "left_semi").select("_row.*"))
