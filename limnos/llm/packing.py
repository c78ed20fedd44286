"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized and end with ``end_id``.  A document of at least
``capacity`` ids gives full windows first.  What is left is cut into pieces of
at most ``piece`` ids; the pieces of ``block`` documents are dealt to windows
by multiway differencing: every piece starts as a partial partition (one
window holds it, the others are empty), the two partial partitions with the
largest imbalance merge by setting the fullest window of one against the
emptiest of the other, until one partition is left.  The number of windows
starts at ceil(ids / capacity) and rises whenever a window exceeds the
capacity.  Blocks are consecutive documents of one partition, so nothing is
shuffled and a task holds one block.

Defined results: NULL text counts as empty (one piece: the end id); a NULL or
repeated doc_id is carried as it is, each row being its own document; other
columns are ignored; an empty table gives an empty result.  A re-run task
deals the same blocks again, since blocks follow the order of its rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from limnos.llm.runtime import release_memory, ship
from limnos.llm.tokens import encoder, read_tokenizer

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, ids binary")


def difference_partition(sizes: list[int], windows: int) -> np.ndarray:
    """Window of each size, by Karmarkar-Karp differencing over ``windows`` windows."""
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    heap, nodes = [], []
    for k, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        nodes.append((k,))
        heap.append((-size, k, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        total = left + right[::-1]
        order = np.argsort(total, kind="stable")
        total = total[order]
        total -= total[0]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(total[-1]), len(nodes) - 1, total))
    out = np.zeros(n, np.int64)
    stack = [(heap[0][1], np.arange(windows))]
    while stack:
        k, label = stack.pop()          # label[slot]: window of the slot-th smallest sum
        node = nodes[k]
        if len(node) == 1:
            out[node[0]] = label[-1]
            continue
        a, b, order = node
        placed = np.empty(windows, np.int64)
        placed[order] = label
        stack.append((a, placed))
        stack.append((b, placed[::-1]))
    return out


def fit_windows(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows); no window exceeds the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        where = difference_partition(sizes, windows)
        if not sizes or np.bincount(where, weights=sizes).max() <= capacity:
            return where, windows
        windows += 1


def _pack_block(block, capacity: int, piece: int, first_sequence: int):
    """Rows of one block of (doc_id, ids) and the number of sequences used."""
    rows, rest, sequence = [], [], first_sequence
    for doc, ids in block:
        n, at = len(ids), 0
        while n - at >= capacity:
            rows.append((doc, at, capacity, n, sequence, 0, capacity, ids[at:at + capacity]))
            at += capacity
            sequence += 1
        while at < n:
            size = min(piece, n - at)
            rest.append((doc, at, size, n, ids[at:at + size]))
            at += size
    where, windows = fit_windows([r[2] for r in rest], capacity)
    fill = np.zeros(windows, np.int64)
    total = np.bincount(where, weights=[r[2] for r in rest], minlength=windows).astype(np.int64)
    for (doc, at, size, n, ids), w in zip(rest, where.tolist(), strict=True):
        rows.append((doc, at, size, n, sequence + w, int(fill[w]), int(total[w]), ids))
        fill[w] += size
    return rows, sequence + (windows if rest else 0) - first_sequence


def _to_batch(rows) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length"]
    cols = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
    arrays.append(pa.array([x.astype("<u4").tobytes() for x in cols[7]], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "ids"])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, piece: int = 256,
         block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document's id, ``start`` in the document's ids, ``length``,
    ``doc_tokens`` (with the end id), its sequence, ``offset`` there, the sequence's filled
    length and the ids (little-endian unsigned 32-bit).  Every id lies in exactly one piece."""
    ship(docs.sparkSession)
    spec = read_tokenizer(tokenizer_path)

    def run(batches):
        from pyspark import TaskContext

        release_memory()
        enc = encoder(spec)
        sequence = TaskContext.get().partitionId() << 33
        held = []
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                keys = part.column(0).to_pylist()
                flat, counts = enc.encode(part.column(1).to_pylist())
                ends = np.cumsum(counts)
                for k, key in enumerate(keys):
                    ids = np.append(flat[ends[k] - counts[k]:ends[k]], np.uint32(end_id))
                    held.append((key, ids))
                    if len(held) == block:
                        rows, used = _pack_block(held, capacity, piece, sequence)
                        sequence, held = sequence + used, []
                        yield _to_batch(rows)
        if held:
            rows, _ = _pack_block(held, capacity, piece, sequence)
            yield _to_batch(rows)

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
