"""Minimax contiguous partition of atomic groups into shards.

Rows with equal texts form one atomic group.  Groups stand in the order of
their text's digest; the smallest capacity at which a greedy sweep over that
order needs at most ``shards`` shards is found by binary search, and the order
is cut there.  The sweep asks one question, "the last group boundary at or
below x", so it only needs running sums near the cuts.  The driver holds the
boundaries of at most ``grid`` cells: cells in which some cut may still lie are
split again until each such cell holds one boundary, then the search is exact.
Each round's cells come from one aggregate over the group table.

Defined results: NULL texts are one group of their own (8 bytes a row); empty
texts are another; repeated rows (also equal doc_ids) each take a slot; an
empty table gives an empty result; shards may stay empty when there are fewer
groups than shards; other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.runtime import cut_lineage

ROW_BYTES = 8
BUCKET_DIGITS = 3     # 16**3 buckets of the digest order, each a window partition
GRID = 65536
SLOT_ROWS = 20_000    # rows numbered by one window partition, on average


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the group's key (digest of the text; empty for NULL)."""
    text = docs[text_col].cast("string")
    raw = text.cast("binary")
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(F.coalesce(raw, F.lit(b""))).cast("long").alias("text_crc32"),
                       F.coalesce(F.md5(raw), F.lit("")).alias("key"))


def group_table(rows: DataFrame) -> DataFrame:
    """key, bytes and ``upto``: bytes of all groups up to and with this one, in key order."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn(
        "bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = groups.groupBy("bucket").agg(F.sum("bytes").alias("bucket_bytes"))
    offsets = sums.select("bucket", (F.sum("bucket_bytes").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    running = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("key"))
    # offsets: one row per bucket, at most 16**BUCKET_DIGITS + 1
    return groups.join(F.broadcast(offsets), "bucket").select(
        "key", "bytes", (F.coalesce("before", F.lit(0)) + running).alias("upto"))


def greedy_cuts(boundaries: list[int], capacity: int, shards: int, base: int = 0) -> list[int]:
    """The sweep over known boundaries from ``base`` on: the end of each of ``shards`` shards."""
    cuts = []
    for _ in range(shards):
        at = bisect.bisect_right(boundaries, base + capacity)
        base = boundaries[at - 1] if at and boundaries[at - 1] > base else base
        cuts.append(base)
    return cuts


def smallest_capacity(boundaries: list[int], low: int, high: int, shards: int) -> int:
    """Binary search; ``high`` is feasible."""
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(boundaries, mid, shards)[-1] >= boundaries[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def _cells(groups: DataFrame, gaps: list[tuple[int, int]], grid: int) -> list[tuple[int, int, int]]:
    """(smallest boundary, largest, boundaries) of each cell of the open gaps: about ``grid``
    cells, at least two for each gap."""
    per = max(2, grid // len(gaps))
    cut = F.array(*(F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"),
                             F.lit(max(1, -(-(hi - lo) // per))).cast("long").alias("width")) for lo, hi in gaps))
    own = F.get(F.filter(cut, lambda x: (x["lo"] < F.col("upto")) & (F.col("upto") < x["hi"])), F.lit(0))
    found = (groups.select("upto", own.alias("own")).where("own IS NOT NULL")
             .groupBy(F.col("own.lo").alias("lo"), F.expr("(upto - own.lo) div own.width").alias("cell"))
             .agg(F.min("upto").alias("first"), F.max("upto").alias("last"), F.count("*").alias("n")).collect())
    return [(r["first"], r["last"], r["n"]) for r in found]


def minimax_cuts(groups: DataFrame, shards: int, grid: int = GRID) -> tuple[int, list[int]]:
    """(smallest capacity, the running sum at which each shard ends)."""
    total, largest = groups.agg(F.max("upto"), F.max("bytes")).first()
    if not total:
        return 0, [0] * shards
    low = max(largest, -(-total // shards))
    # boundaries known so far, and the gaps between two of them that hold others
    known, gaps, asked = {0, total}, {(0, total)}, [(0, total)]
    while True:
        gaps -= set(asked)
        for first, last, n in _cells(groups, asked, grid):
            known |= {first, last}
            if n > 2:
                gaps.add((first, last))
        edges = sorted(known)
        # a partition along known boundaries is feasible for the groups too
        high = smallest_capacity(edges, low, total, shards)
        near, furthest, nearest = [], 0, 0
        for _ in range(shards):
            # whatever the capacity from low to high, this cut lies in [nearest, furthest]
            nearest = edges[bisect.bisect_right(edges, nearest + low) - 1]
            furthest = min(total, furthest + high)
            near.append((nearest, furthest))
        asked = sorted(g for g in gaps if any(g[0] < b and g[1] > a for a, b in near))[:512]
        if not asked:
            return high, level_cuts(edges, high, shards)


def level_cuts(edges: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of the shards at the found capacity: each cut at the boundary nearest to an equal
    share of what is left, if the rest then still fits; else where the sweep would cut."""
    def fits(base: int, left: int) -> bool:
        rest = edges[bisect.bisect_right(edges, base):]
        return not rest or (left > 0 and greedy_cuts([base, *rest], capacity, left, base)[-1] >= rest[-1])

    cuts, base, total = [], 0, edges[-1]
    for left in range(shards, 0, -1):
        share = -(-(total - base) // left)
        at = bisect.bisect_right(edges, base + share)
        under = edges[at - 1] if at and edges[at - 1] > base else base
        over = edges[at] if at < len(edges) else total
        furthest = greedy_cuts(edges, capacity, 1, base)[0]
        options = [x for x in (under, over) if base < x <= base + capacity]
        options.sort(key=lambda x: abs(x - base - share))
        base = next((x for x in options if fits(x, left - 1)), furthest)
        cuts.append(base)
    return cuts


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   grid: int = GRID) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    rows = cut_lineage(digest_rows(docs, id_col, text_col).withColumn("number", F.monotonically_increasing_id()))
    groups = cut_lineage(group_table(rows))
    _, cuts = minimax_cuts(groups, shards, grid)
    # the last key of each shard; shards - 1 of them at most
    ends = sorted(set(cuts[:-1]))
    last = {r["upto"]: r["key"] for r in groups.where(F.col("upto").isin(ends)).select("upto", "key").collect()}
    shard = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        shard = F.when(F.col("key") <= last[cuts[k]], F.lit(k)).otherwise(shard) if cuts[k] else shard
    placed = rows.withColumn("shard", shard.cast("int"))
    return number_slots(placed, shards)


def number_slots(placed: DataFrame, shards: int) -> DataFrame:
    """``slot``: 0, 1, ... in each shard.  Rows are numbered in cells of a shard dealt by the
    ``number`` each row was written with, so neither a shard nor a group of copies, nor of rows that
    repeat whole, is numbered by one task."""
    n = placed.count()
    cells = max(64, -(-n // (shards * SLOT_ROWS)))
    dealt = placed.withColumn("cell", F.pmod(F.xxhash64("number"), F.lit(cells)).cast("int"))
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key", "number")) - 1
    numbered = dealt.withColumn("own", own.cast("long"))
    return numbered.join(before, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).alias("slot"))
